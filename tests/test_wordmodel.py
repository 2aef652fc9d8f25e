"""The learned text scorer against a plain fit with numpy."""

from __future__ import annotations

import contextlib
import hashlib
import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewake.operators import wordmodel

GOOD, BAD, ANY = ["calm", "profit", "steady"], ["crash", "panic", "ruin"], ["the", "market", "today", "bank"]


def documents(n=60, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [str(w) for w in rng.choice(ANY, 6)] + [str(w) for w in rng.choice(GOOD if i % 3 else BAD, 2)]
        out.append((i, " ".join(rng.permutation(words)).capitalize() + ".", bool(i % 3)))
    return [*out, (100, "calm " * 5000, None), (101, None, True), (102, "", False), (103, "Bullish rally", None),
            (104, " \n", None), (None, "plunge", None), (105, "zzz qqq", None)]


def marked(text):
    words = [w for w in re.split("[^a-z]+", (text or "").lower()) if w]
    return [
        ("not_" if set(words[max(0, i - wordmodel.REACH) : i]) & set(wordmodel.NEGATIONS) else "") + w
        for i, w in enumerate(words)
    ]


def slots(text):
    return {int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % wordmodel.SLOTS for w in marked(text)}


def plain(docs, rounds, least, penalty):
    """Rounds on dense arrays, and the loss after each."""
    known = [(slots(t), int(y)) for _, t, y in docs if y is not None]
    held = {}
    for s, _ in known:
        for j in s:
            held[j] = held.get(j, 0) + 1
    names = sorted(j for j, k in held.items() if k >= least)
    x = np.array([[float(j in s) for j in names] for s, _ in known])
    y = np.array([v for _, v in known])
    c = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    some = x.sum(1) > 0
    x, y, c = x[some], y[some], c[some]
    x /= np.sqrt(x.sum(1, keepdims=True))
    curve = (c[:, None] * (x > 0)).sum(0) / 4 + penalty
    w, losses = np.zeros(len(names)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        losses.append(-(c * np.log(np.where(y == 1, p, 1 - p))).sum() + penalty / 2 * w @ w)
        w = w + (x.T @ (c * (y - p)) - penalty * w) / curve
    return dict(zip(names, w, strict=True)), losses


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(documents(), "id long, text string, positive boolean")
    return docs, wordmodel.fit(docs, "id", rounds=8, least=3, penalty=0.1)


def test_marks_behind_negations(spark):
    texts = ["Not good, not at all bad today", "no", "", None, "never a x y z", "gain" * 3, "without no loss"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["m"] for r in rows.select("id", wordmodel.marked_words(F.col("text")).alias("m")).collect()}
    assert got == {i: marked(t) for i, t in enumerate(texts)}
    assert got[4] == ["never", "not_a", "not_x", "not_y", "z"]


def test_weights_agree_with_numpy_and_the_loss_falls(fitted):
    want, losses = plain(documents(), 8, 3, 0.1)
    got = {r["slot"]: r["weight"] for r in fitted[1].collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[j] - want[j]) for j in want) < 1e-9
    assert all(b <= a for a, b in zip(losses, losses[1:], strict=False))


def test_scores_follow_the_weights_and_fall_back_on_the_list(fitted):
    docs, weights = fitted
    w = {r["slot"]: r["weight"] for r in weights.collect()}
    rows = wordmodel.learned_sentiment(docs, weights, "id").collect()
    assert len(rows) == docs.count()
    by = {r["id"]: r for r in rows}
    for i, text, _ in documents():
        known = [w[j] for j in slots(text) if j in w]
        if known and i is not None:
            p = 1 / (1 + np.exp(-sum(known) / np.sqrt(len(known))))
            assert abs(by[i]["positive"] - (p if p > 0.5 else p / 2)) < 1e-9
    assert by[100]["polarity"] > 0 and by[103]["polarity"] > 0 > by[None]["polarity"]
    assert by[101]["neutral"] == by[102]["neutral"] == by[104]["neutral"] == by[105]["neutral"] == 1.0


def test_held_out_texts_are_told_apart(spark, fitted):
    fresh = spark.createDataFrame([r for r in documents(60, seed=9) if r[2] is not None and r[1]], fitted[0].schema)
    rows = fresh.join(wordmodel.chances(fresh, fitted[1], "id"), "id").collect()
    assert len(rows) == 60 and all((r["chance"] > 0.5) == r["positive"] for r in rows)


def test_no_labels(spark, fitted):
    docs = fitted[0].withColumn("positive", F.lit(None).cast("boolean"))
    weights = wordmodel.fit(docs, "id", rounds=1)
    assert weights.count() == 0
    assert wordmodel.learned_sentiment(docs.limit(0), weights, "id").count() == 0
    by = {r["id"]: r["polarity"] for r in wordmodel.learned_sentiment(docs, weights, "id").collect()}
    assert by[103] > 0 > by[None]


def test_words_are_exchanged_once_and_rounds_leave_documents_in_place(fitted, monkeypatch):
    docs, weights = fitted
    with contextlib.redirect_stdout(io.StringIO()) as out:
        wordmodel.chances(docs, weights, "id").explain()
    assert out.getvalue().count("Exchange hashpartitioning") == 1
    sent, pull = [], wordmodel._pull

    def watched(rows, *rest):
        sent.append(rows.count())
        return pull(rows, *rest)

    monkeypatch.setattr(wordmodel, "_pull", watched)
    wordmodel.fit(docs, "id", rounds=2, least=3)
    assert sent == [60, 60]  # one row for each labelled document with a word


def test_repeated_and_missing_keys(spark, fitted):
    """A row of a key that comes twice weighs twice; rows without a key are one document of the word counts."""
    rows = [(i, t, y) for i, t, y in documents(20) if y is not None]
    twice = spark.createDataFrame([*rows, *rows], fitted[0].schema)
    a = {r["slot"]: r["weight"] for r in wordmodel.fit(twice, "id", rounds=1, least=3, penalty=0.0).collect()}
    b = {r["slot"]: r["weight"] for r in wordmodel.fit(spark.createDataFrame(rows, fitted[0].schema), "id", rounds=1, least=3, penalty=0.0).collect()}
    assert a.keys() == b.keys() and all(abs(a[j] - b[j] / np.sqrt(2)) < 1e-9 for j in a)
    none = [(None, "lonely calm", True), (None, "lonely other", True), (500, "lonely", False)]
    got = {r["slot"] for r in wordmodel.fit(spark.createDataFrame([*rows, *none], fitted[0].schema), "id", rounds=1, least=2).collect()}
    assert slots("lonely") <= got and not slots("other") & got
    assert wordmodel.fit(spark.createDataFrame(none[:2], fitted[0].schema), "id", rounds=1, least=1).count() == 0
