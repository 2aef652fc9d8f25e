"""Removed bytes against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from candlewake.llm import substring_dedup as D
from candlewake.llm.queries import R

SF = "/root/testdata/sf0.001"


def brute(texts):
    n = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_query_equals_all_windows(spark):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = dict(zip([d for d, _ in rows], brute([(t or "").encode() for _, t in rows]), strict=True))
    got = {r.doc_id: tuple(r)[1:] for r in R.queries["op10_substring_dedup"](spark, SF).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0


def random_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé \x00") for _ in range(rng.randrange(1, 9)))
    passages = ["".join(word() for _ in range(n)) for n in (20, 48, 52, 55, 90, 200)] + ["ab" * 130, "x" * 199, "y" * 201, "z" * 420]
    texts = []
    for _ in range(60):
        texts.append("".join(rng.choice(passages) if rng.random() < 0.4 else word() for _ in range(rng.randrange(0, 60))))
    return [*texts, texts[0], "", "q" * 199, "q" * 200, "w" * 200]


@pytest.mark.parametrize("crowd", [1, 4, 1000])
def test_passages_edges_and_periods(spark, monkeypatch, crowd):
    monkeypatch.setattr(D, "CROWD", crowd)
    texts = random_texts(crowd)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "bucket")
    got = {r.bucket: tuple(r)[1:] for r in D.without_repeats(docs, key="bucket").collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts])


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 1000)
    texts = random_texts(9)
    texts.append("".join(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute([t.encode() for t in texts])
    names, found = [], {}
    for data, ends, offsets, ids in D._pieces(list(range(len(texts))), [t.encode() for t in texts]):
        _, _, low, high = D.runs(data, ends)
        text = np.searchsorted(ends, low, side="right")
        for t, a, b in zip(text, low, high, strict=True):
            start = offsets[t] + a - (ends[t - 1] if t else 0)
            found.setdefault(ids[t], []).extend(range(start, start + b - a + 1))
    for i, t in enumerate(texts):
        assert sorted(found.get(i, [])) == list(range(max(0, len(t.encode()) - 199)))
    assert docs.count() == len(want) and names == []


def test_odd_rows(spark):
    rows = [(1, "p" * 300), (1, "k" * 250), (None, "k" * 250), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in D.without_repeats(docs).collect())
    assert got == [(0, 0, 0, 0), (0, 250, 250, 1), (1, 250, 250, 1), (1, 300, 300, 1), (3, 0, 0, 0), (3, 0, 0, 0)]
    assert D.without_repeats(docs.limit(0)).collect() == []
