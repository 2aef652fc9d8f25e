"""Ranks against scoring every document, on texts with ties, frequent words and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from candlewake.llm import lexical_search as L


def terms(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(L.TERM, folded)


def brute(docs, items, places=L.TOP):
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    bags = [b for b in bags if b[2]]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in set(items):
        rows = []
        for d, bag, size in bags:
            m = 75 + (25 * size * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t in terms(text) if bag[t]
            )
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:places])]
    return sorted(out, key=str)


def corpus(seed, size):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 12, 60])))) for i in range(size)]
    docs += [(1000 + i, "The SAME text, again; w1 w2") for i in range(40)]
    docs += [(7, "w5 w5 ÄÖ größe"), (7, "w5 w5 ÄÖ größe"), (None, "w5 w9 unicode-größe"), (2000, None), (2001, ""), (2002, " -- "), (2003, "w3 " * 50000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 25, 90])))) for i in range(25)]
    items += [(50, "the same text"), (51, None), (52, ""), (53, "nowhere"), (54, "größe Größe W5"), (54, "w5"), (54, "w5"), (None, "again")]
    return docs, items


@pytest.mark.parametrize("block", [16, 1 << 14])
def test_search_equals_scoring_all(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "FIRST", 4)
    monkeypatch.setattr(L, "ITEM_BYTES", 1 << (12 if block == 16 else 22))
    docs, items = corpus(block, 400)
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, n string").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, id int")
    got = sorted([(r.item_id, r.rank, r.id, r.score) for r in L.search(d, i).collect()], key=str)
    assert got == brute(docs, items)
    assert L.search(d.limit(0), i).collect() == [] and L.search(d, i.limit(0)).collect() == []


def test_text_keys(spark):
    docs, items = [("b", "x y"), ("a", "x y"), (None, "x y"), ("ä", "x"), ("c", "z")], [("i", "x")]
    got = L.search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.rank)] == ["ä", "a", "b", None]


@pytest.mark.parametrize("terms_", [1, 8, 9, 70, 200])
def test_groups_are_the_distinct_masks(terms_):
    rng = np.random.RandomState(terms_)
    present = rng.rand(terms_, 500) < 0.02
    masks, group = L.grouped(present)
    assert (masks[group] == present.T).all()
    assert len(np.unique(masks, axis=0)) == len(masks)


def test_low_bounds_are_never_scored():
    """Documents with one frequent term are left once all places are taken by those with both."""
    n = np.full(4000, 10)
    docs = np.concatenate([np.arange(4000), np.arange(0, 4000, 100)])
    which = np.concatenate([np.zeros(4000, int), np.ones(40, int)])
    block = L.Block(n, docs, which, np.ones(4040, int), 2, 4000, 40000)
    seen = []
    score = block.scores
    block.scores = lambda d, *a: seen.append(len(d)) or score(d, *a)
    found, _ = block.best(np.array([0, 1]), np.array([1, 5000]), 0, 20)
    assert sum(seen) == L.FIRST and set(found) == set(range(0, 4000, 100))
