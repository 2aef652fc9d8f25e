"""Scores against sums over all segmentations and plain counts."""

import itertools
import math
import zlib
from collections import Counter

import duckdb
import pytest

from candlewake.llm import lattice_lm as L
from candlewake.llm.queries import R

SF = "/root/testdata/sf0.001"


def test_a_word_sums_all_its_segmentations():
    pieces = {"▁": 0.1, "▁a": 0.2, "a": 0.05, "b": 0.1, "ab": 0.2, "ba": 0.03, "▁ab": 0.07}
    by_byte = [0.001] * 256
    lattice = L.Lattice({k: math.log(p) for k, p in pieces.items()}, [math.log(p) for p in by_byte])
    for word in ("", "a", "ab", "abab", "aéb", "bbaab"):
        text, total = "▁" + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
            parts = [text[a:b] for a, b in zip([0, *ends], ends)]
            p = 1.0
            for x in parts:
                p *= pieces.get(x, 0.001 ** len(x.encode()) if len(x) == 1 else 0.0)
            total += p
        assert lattice.word(word) == pytest.approx(math.log(total))
    assert math.isfinite(lattice.word("x" * 50_000))


@pytest.mark.parametrize("head", [0, 50, L.HEAD])
def test_base_scores_equal_counts(spark, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD", head)
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    tokens = {d: (t or "").encode().lower().split() + [None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    count = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n = sum(count.values())
    below = n + 0.5 * (len(count) + 1)
    got = R.queries["op5_lattice_lm"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ws), n)
        assert r.n_known == sum(count[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / below) for w in ws))
        assert math.isfinite(r.score) and r.score < 0
    held_bits = [(-r.score / r.n_tokens) for r in got if r.held_out]
    assert sum(held_bits) / len(held_bits) < 6


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (5, "q" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", L.F.lit(1))
    got = L.score(docs).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 2, 3, 3]
    assert L.score(docs.limit(0)).collect() == []


def test_every_row_comes_back_after_a_shuffle(spark, monkeypatch):
    """Small partitions that adaptive execution puts together by their own sizes; scores are sums over words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    asked = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in asked}
    want = {r.id: r for r in L.score(docs).collect()}
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        ways = (docs.repartition("doc_id"), docs.orderBy("doc_id"), docs.join(docs.select("doc_id").distinct(), "doc_id"))
        for way in ways:
            got = L.score(way).collect()
            assert len(got) == len(want)
            for r in got:
                assert (r.held_out, r.n_tokens, r.n_known) == (want[r.id].held_out, len(words[r.id]) + 1, want[r.id].n_known)
                assert r.score == pytest.approx(want[r.id].score) and r.base_score == pytest.approx(want[r.id].base_score)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_text_scores_are_sums_of_word_scores(spark, monkeypatch):
    """``score`` against the lattice of each token, fitted as the query fits it."""
    made = []
    fit = L.lattice_of
    monkeypatch.setattr(L, "lattice_of", lambda *a: made.append(fit(*a)) or made[-1])
    rows = [(i, f"some words {i} Übung x{i % 3}" * (i % 4)) for i in range(30)] + [(40, None), (None, "no key")]
    got = {r.id: r.score for r in L.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lattice, end = made[0]
    for d, t in rows:
        tokens = [w.decode() for w in (t or "").encode().lower().split()]
        assert got[d] == pytest.approx((sum(lattice.word(w) for w in tokens) + end) / math.log(10))
