"""Groups against all pairs of sets."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from candlewake.llm import near_dedup as N
from candlewake.llm.queries import R

SF = "/root/testdata/sf0.001"


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {d: sets_of(t) for d, t in rows}
    having = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    common = defaultdict(int)
    for ds in having.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] += 1
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_query_equals_all_pairs(spark):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in R.queries["op7_near_dedup"](spark, SF).collect()}
    assert got == brute(rows)


def test_chains_copies_and_odd_rows(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows, words = [], list(base)
    for i in range(30):  # each a little further from the first
        rows.append((i, " ".join(words)))
        words[(7 * i) % 120] = f"x{i}"
    rows += [(100 + i, "Same text for all of these rows here") for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "two words"), (204, "Two  words"), (205, "other two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in N.groups(docs).collect()}
    assert got == brute(rows)
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "c d")], "doc_id long, text string")
    assert sorted((r.id or 0, r.component_id or 0, r.kept) for r in N.groups(odd).collect()) == [
        (0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True)
    ]
    assert N.groups(docs.limit(0)).collect() == []
    assert N.one_of_each(docs.withColumnRenamed("text", "signature"), text="signature").count() == len(
        {c for _, c in brute(rows).values()}
    )


def test_null_and_repeated_keys_lose_no_text(spark):
    near = " ".join(f"w{i}" for i in range(100))
    rows = [
        (None, "alone without a key", 1), (None, "another one without a key", 2), (None, None, 3), (None, near, 4),
        (7, "one text of this key", 5), (7, "quite unlike the other text", 6), (7, near + " x", 7), (9, near, 8),
        (0, "met twice", 9), (0, "met twice", 9), (None, "no key twice", 10), (None, "no key twice", 10),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    assert sorted(tuple(r)[2] for r in N.one_of_each(docs).collect()) == [1, 2, 3, 5, 6, 7, 9, 10]
    names = docs.withColumn("doc_id", N.F.concat(N.F.lit("d"), "doc_id"))
    assert sorted(r.id for r in N.one_of_each(names).collect()) == [1, 2, 3, 5, 6, 7, 9, 10]


def test_a_crowd_of_copies_around_an_original(spark):
    """Copies are near the original, which has no small id, but seldom near each other."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(500, " ".join(base))]
    for i in range(250):
        words = list(base)
        for j in rng.sample(range(80), 8):
            words[5 * j] = f"c{i}x{j}"
        rows.append((i if i < 125 else 1000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: (r.n_shingles, r.component_id) for r in N.groups(docs).collect()} == brute(rows)


def edited(n, seed=3):
    """Texts of 120 words with three edits each: similar, but most pairs are under the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for j in rng.sample(range(120), 3):
            words[j] = f"e{i}x{j}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [40, 1024])
def test_a_crowd_under_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    sent = {}
    for n in (100, 200):
        rows = edited(n)
        monkeypatch.setattr(N, "_surviving", watched := watch(N._surviving))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = N.groups(docs).collect()
        assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
        sent[n] = watched.rows
        monkeypatch.undo()
        monkeypatch.setattr(N, "BLOCK", block)
    assert sent[200] <= 3 * sent[100]


def watch(fn):
    def run(pairs, nodes):
        out = fn(pairs, nodes)
        run.rows += out.count()
        return out

    run.rows = 0
    return run


def test_counts_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for size in (1, 5, 60, 3000):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**64, size, np.uint64))
            keep = rng.random(len(a)) < rng.choice([0.7, 0.86, 0.95])
            b = np.unique(np.concatenate([a[keep], rng.integers(0, 2**64, int((~keep).sum()) // 2, np.uint64)]))
            if len(b) and N.linked(a, b):
                assert N.may_link(len(a), N.cell_counts(a), len(b), N.cell_counts(b))


def test_posterior_bound_follows_the_beta_distribution():
    rng = np.random.default_rng(1)
    for n, least in zip(range(16, 129, 16), N.least_matches(75, 1e-3), strict=True):
        chance = lambda m: (rng.beta(m + 1, n - m + 1, 200_000) >= 0.75).mean()  # noqa: B023, E731
        assert chance(least) > 5e-4 and (least == 0 or chance(least - 1) < 2e-3)
