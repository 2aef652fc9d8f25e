"""Marginals against enumeration, switched languages, held-out accuracy."""

import itertools

import duckdb
import numpy as np
import pytest

from candlewake.llm import language_crf as L
from candlewake.llm.queries import R

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("block", [2, 3, 100])
def test_marginals_equal_enumeration(block):
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 1, 7, 4])
    scores, steps = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    got, moves = L.marginals(scores, lengths, steps, 100, pairs=True)
    if block != 100:
        assert np.allclose(L.marginals(scores, lengths, steps, block), got)
    want, want_moves, at = np.zeros_like(scores), np.zeros((3, 3)), 0
    for n in lengths:
        total, local, pairs = 0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n) if n else ():
            w = np.exp(sum(scores[at + i, c] for i, c in enumerate(path)) + sum(steps[a, b] for a, b in itertools.pairwise(path)))
            starts = np.exp(steps[:, path[0]])
            total += w * starts.sum()
            local[np.arange(n), path] += w * starts.sum()
            pairs[:, path[0]] += w * starts
            for a, b in itertools.pairwise(path):
                pairs[a, b] += w * starts.sum()
        if n:
            want[at : at + n] = local / total
            want_moves += pairs / total
        at += n
    assert np.allclose(got, want) and np.allclose(moves, want_moves)


def test_words_of_a_switched_text_get_their_own_language():
    a, b = [f"qua{x}z" for x in "abcdefghij"], [f"th{x}ing" for x in "abcdefghij"]
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(w, 60)) for w in (a, b) * 40]
    field = L.fit(texts, ["aa", "bb"] * 40)
    words = ["quakz"] * 6 + ["thking"] * 6
    chance = L.marginals(field.scores([w.encode() for w in words]), np.array([12]), field.steps)
    assert (chance.argmax(axis=1) == [0] * 6 + [1] * 6).all()
    assert field.steps[0, 0] > field.steps[0, 1]


def test_held_out_languages(spark):
    truth = dict(duckdb.execute(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    got = R.queries["op9_language_crf"](spark, SF).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.97


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !? 34", "en"), (3, "ab cd", None), (None, "ab " * 9000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.identify(docs).collect()
    assert len(got) == 5 and sum(r.lang_pred == "und" for r in got) >= 3
    assert L.identify(docs.limit(0)).collect() == []
