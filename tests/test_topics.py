"""Topic tables against a plain fit with numpy."""

from __future__ import annotations

import contextlib
import hashlib
import io
import math
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewake.functions.text import topic_tokens
from candlewake.operators import sentiment, topics
from candlewake.plans import validation_queries

WORDS = {"metal": ["gold", "silver", "copper"], "grain": ["wheat", "maize", "barley"]}


def documents(n=24, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        own = WORDS["metal" if i % 2 else "grain"]
        words = [str(w) for w in rng.choice(own, 12)]
        words += [str(rng.choice(WORDS["metal"] + WORDS["grain"])), "common"]
        out.append((i, words))
    return [*out, (100, ["gold"] * 40 + ["rare"]), (101, []), (102, None), (103, ["", None, "wheat"])]


def digamma(x):
    """By the recurrence up to 60, where two terms of the series are enough."""
    out = 0.0
    while x < 60:
        out, x = out - 1 / x, x + 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x * x)


def plain(docs, k, rounds, steps, least, share, seed):
    bags = {i: [w for w in ws or [] if w] for i, ws in docs}
    held = {}
    for ws in bags.values():
        for w in set(ws):
            held[w] = held.get(w, 0) + 1
    vocab = sorted(w for w, d in held.items() if least <= d <= share * len(docs))
    at = {w: j for j, w in enumerate(vocab)}
    n = np.zeros((len(docs), len(vocab)))
    for row, ws in enumerate(bags.values()):
        for w in ws:
            if w in at:
                n[row, at[w]] += 1
    u = lambda t, w: (int(hashlib.md5(f"{seed}:{t}:{w}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    lam = np.array([[1 / k - math.log(u(t, w)) for w in vocab] for t in range(k)])
    psi = np.vectorize(digamma)

    def shares(lam):
        w = np.exp(psi(lam) - psi(lam.sum(1, keepdims=True)))
        g = np.full((len(docs), k), 1 / k) + n.sum(1, keepdims=True) / k
        for _ in range(steps):
            e = np.exp(psi(g))
            g = 1 / k + e * ((n / (e @ w)) @ w.T)
        return g, w

    for _ in range(rounds):
        g, w = shares(lam)
        e = np.exp(psi(g))
        lam = 1 / k + w * (e.T @ (n / (e @ w)))
    g, _ = shares(lam)
    return vocab, lam, dict(zip(bags, g / g.sum(1, keepdims=True), strict=True))


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(documents(), "id long, tokens array<string>")
    return docs, topics.fit(docs, "id", topics=2, rounds=6, least=2, share=0.6, seed=3)


def test_weights_and_shares_agree_with_numpy(fitted):
    docs, weights = fitted
    vocab, lam, want = plain(documents(), 2, 6, topics.STEPS, 2, 0.6, 3)
    got = {r["word"]: (r["l0"], r["l1"]) for r in weights.collect()}
    assert sorted(got) == vocab and "rare" not in got and "common" not in got
    np.testing.assert_allclose([got[w] for w in vocab], lam.T, atol=1e-6)
    shares = {r["id"]: r["topics"] for r in topics.shares(docs, weights, "id").collect()}
    assert set(shares) == set(want)
    for i, row in want.items():
        np.testing.assert_allclose(shares[i], row, atol=1e-6)
    assert shares[101] == [0.5, 0.5] == shares[102]


def test_topics_part_the_two_vocabularies(fitted):
    docs, weights = fitted
    best = {r["word"]: int(r["l1"] > r["l0"]) for r in weights.collect()}
    assert len({best[w] for w in WORDS["metal"]}) == len({best[w] for w in WORDS["grain"]}) == 1
    assert best["gold"] != best["wheat"]
    total = topics.word_chances(weights).groupBy("topic").sum("weight").collect()
    assert all(abs(r[1] - 1) < 1e-9 for r in total)


def test_partitions_and_copies_do_not_matter(spark, fitted, monkeypatch):
    docs, weights = fitted
    monkeypatch.setattr(topics, "COPIES", 3)
    again = topics.fit(docs.repartition(7), "id", topics=2, rounds=6, least=2, share=0.6, seed=3)
    a, b = ({r["word"]: r["l0"] for r in t.collect()} for t in (weights, again))
    assert a.keys() == b.keys() and all(abs(a[w] - b[w]) < 1e-9 for w in a)


def test_no_documents_and_no_known_words(spark):
    for rows in ([], [(1, ["once"]), (2, None)]):
        docs = spark.createDataFrame(rows, "id long, tokens array<string>")
        weights = topics.fit(docs, "id", topics=2, rounds=1, least=2)
        assert weights.count() == 0 and topics.word_chances(weights).count() == 0
        assert [r["topics"] for r in topics.shares(docs, weights, "id").collect()] == [[0.5, 0.5]] * len(rows)


def test_a_round_is_a_short_plan_and_sends_a_word_once_for_each_group(spark, monkeypatch):
    plans, write = [], topics.stage

    def watched(df, name, **how):
        if name == "topic-weights":
            with contextlib.redirect_stdout(io.StringIO()) as out:
                df.explain()
            plans.append(out.getvalue())
        return write(df, name, **how)

    monkeypatch.setattr(topics, "stage", watched)
    docs = spark.createDataFrame(documents(), "id long, tokens array<string>")
    topics.fit(docs, "id", rounds=1, least=2, share=0.6)
    assert len(plans[-1]) < 20_000
    monkeypatch.setattr(topics, "COPIES", 3)
    for n in (200, 400):
        many = spark.createDataFrame(documents(n), "id long, tokens array<string>")
        _, words, rows = topics._tallied(many, "id", "tokens")
        kept = topics.vocabulary(words, rows, 2, 0.6)
        assert topics._places(words, kept).count() == 3 * kept.count() == 3 * 6


@pytest.mark.parametrize("size", [1, 50])
def test_groups_and_slices_do_not_matter(spark, fitted, monkeypatch, size):
    """Rows of one key are one document, and rows without a key count once in the vocabulary."""
    rows = [*documents(), (0, ["gold", "wheat"]), (None, ["gold", "odd"]), (None, ["odd"]), (200, ["odd"]), (201, ["lone"])]
    merged = {}
    for i, ws in rows:
        merged.setdefault(i, []).extend(ws or [])
    monkeypatch.setattr(topics, "GROUP_WORDS", size)
    monkeypatch.setattr(topics, "SLICE", size)
    monkeypatch.setattr(topics, "CELLS", size)
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    held = topics.vocabulary(topics._tallied(docs, "id", "tokens")[1], len(rows), 2, 0.6)
    assert {r["word"]: r["docs"] for r in held.collect()}["odd"] == 2
    got = topics.shares(docs, fitted[1], "id").collect()
    want = topics.shares(spark.createDataFrame(list(merged.items()), docs.schema), fitted[1], "id").collect()
    want = {r["id"]: r["topics"] for r in want}
    assert len(got) == len(rows) and all(np.allclose(r["topics"], want[r["id"]], atol=1e-12) for r in got)
    assert want[None] == [0.5, 0.5]


def news(spark, tmp_path):
    texts = [" ".join(words) + " Gold, gold! wheat-42 common" for _, words in documents()[:24]]
    rows = [*enumerate(texts), (24, None), (25, "")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), [i for i, _ in rows]


@pytest.mark.parametrize("query", ["topic_shares", "top_topics_of_news"])
def test_a_query_of_shares_reads_and_counts_the_texts_once(spark, tmp_path, monkeypatch, query):
    staged, write = [], topics.stage
    monkeypatch.setattr(topics, "stage", lambda df, name, **how: staged.append(name) or write(df, name, **how))
    monkeypatch.setattr(validation_queries, "TOPIC_ROUNDS", 1)
    sf, ids = news(spark, tmp_path)
    got = getattr(validation_queries, query)(spark, sf).collect()
    assert staged.count("topic-words") == staged.count("topic-counts") == 1
    assert {r["doc_id"] for r in got} == set(ids)


def test_counts_at_hand_give_the_same_shares(spark, fitted):
    docs, weights = fitted
    counts = topics.counted(docs, "id")
    again = topics.fit(docs, "id", topics=2, rounds=6, least=2, share=0.6, seed=3, counts=counts)
    a, b = ({r["word"]: r["l0"] for r in t.collect()} for t in (weights, again))
    assert a.keys() == b.keys() and all(abs(a[w] - b[w]) < 1e-9 for w in a)
    a, b = ({r["id"]: r["topics"] for r in topics.shares(docs, weights, "id", **c).collect()} for c in ({}, {"counts": counts}))
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-12) for i in a)


def test_tokens_are_runs_of_ascii_letters(spark):
    texts = [
        "Don\'t STOP", "caf\u00e9s na\u00efve", "a\tbcde\x0bfghi\x0cjklm\rnopq\n", "x\u00a0yzab", "\u212aelvin \u0130stanbul", "wheat-42 these",
        "two  spaces", "", None, "\U0001f600gold", "\u2028line\u2028break", "A" * 3 + " " + "B" * 4,
    ]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in docs.select(topic_tokens(F.col("text"), sentiment.STOP_WORDS)).collect()]
    keep = set(string.ascii_lowercase + " \t\n\x0b\x0c\r")
    words = lambda t: "".join(c for c in t.lower() if c in keep).split()
    want = [None if t is None else [w for w in words(t) if len(w) > 3 and w not in sentiment.STOP_WORDS] for t in texts]
    assert got == want


@pytest.mark.parametrize("lens", [[1], [1, 1, 1], [1, 2, 3, 50], [5] * 100 + [7], [3, 100_000, 100_001]])
def test_blocks_hold_every_document_once(monkeypatch, lens):
    monkeypatch.setattr(topics, "CELLS", 40)
    found = list(topics._blocks(np.array(lens)))
    assert [i for b in found for i in range(b.start, b.stop)] == list(range(len(lens)))
    assert all(b.stop - b.start == 1 or (b.stop - b.start) * lens[b.stop - 1] <= 40 for b in found)
