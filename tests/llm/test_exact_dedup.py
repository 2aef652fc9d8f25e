"""Filters against plain counts; groups against a dictionary, also where fingerprints collide."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewake.llm import common
from candlewake.llm import exact_dedup as E


def counted(values):
    keys, counts = np.unique(np.array(values, np.uint64), return_counts=True)
    return keys, counts


@pytest.mark.parametrize("tail", [8, 20, 63])
def test_filters_give_back_and_add_up_their_counts(tail):
    rng = random.Random(tail)
    parts, total = [], Counter()
    for size in (0, 1, 2, 50, 400):
        values = [rng.randrange(1 << tail) >> rng.choice([0, 0, tail // 2]) for _ in range(size)]
        values += values[:3] * rng.choice([0, 1, 300, 70000])
        keys, counts = counted(values)
        data = E.pack(keys, counts, tail)
        back = E.unpack(data, tail)
        assert (back[0] == keys).all() and (back[1] == counts).all()
        parts.append(data)
        total.update(values)
    keys, counts = E.unpack(E.combine(parts, tail), tail)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == total
    # Merging in any order and grouping gives the same bytes.
    assert E.combine(parts, tail) == E.combine([E.combine(parts[3:], tail), E.combine(parts[:3], tail)], tail)


def test_large_counters():
    keys, counts = np.array([0, 5, 2**62], np.uint64), np.array([2**40, 2, 2**55], np.int64)
    back = E.unpack(E.pack(keys, counts, 63), 63)
    assert (back[0] == keys).all() and (back[1] == counts).all()


ROWS = [(i, f"text {i % 7}" + " \t" * (i % 3) + "end") for i in range(60)]
ROWS += [(100 + i, "copied many  times") for i in range(80)] + [(99, "copied many times"), (99, "copied many\ntimes")]
ROWS += [(200, None), (201, ""), (202, " "), (203, "\n\n"), (None, "only without id"), (None, "text 0 end"), (300, "x" * 300000)]


def brute(rows):
    of = defaultdict(list)
    for d, t in rows:
        of[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for t, ds in of.items():
        keep = min((d for d in ds if d is not None), default=None)
        out += [(d, keep, len(ds), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ds]
    return sorted(out, key=str)


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_groups(spark, monkeypatch, collide, small):
    if collide:
        monkeypatch.setattr(F, "xxhash64", lambda *c: F.length(c[0]).cast("long") if c == ("body",) else F.hash(*c).cast("long"))
    if not small:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in ROWS], "doc_id long, text string, n int, body string").repartition(5)
    got = E.groups(docs).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=str) == brute(ROWS)
    assert E.groups(docs.limit(0)).collect() == []


def test_one_of_each_keeps_all_columns_and_one_row_a_text(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, fp int")
    got = E.one_of_each(docs)
    assert got.columns == docs.columns
    want = Counter((keep, sha) for _, keep, _, _, sha in set(brute(ROWS)))
    assert len(got.collect()) == len(want)
    assert {r.doc_id for r in got.collect()} == {keep for keep, _ in want}


def test_corpora_counted_apart_merge(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "fp long") for v in ([1, 2, 2, -5], [2, -5, 7]))
    both = E.merged(E.build(a, 1).union(E.build(b, 1)), 1)
    assert {(r.fp, r.n) for r in E.counted(both, 1, least=1).collect()} == {(1, 1), (2, 3), (-5, 2), (7, 1)}
