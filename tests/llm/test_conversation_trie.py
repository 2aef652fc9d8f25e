"""Nodes against a trie of rebuilt turn lists."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from candlewake.llm import common
from candlewake.llm import conversation_trie as T


def rebuilt(rows, base, head):
    own = defaultdict(list)
    for c, k, role, text in rows:
        if c is not None:
            own[c].append((k is not None, k or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    return {c: own.get(base(c), [])[: head(c)] + v[head(c) :] for c, v in own.items()}


def brute(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    out = []
    for node, ms in members.items():
        todo, leaves, saved = [node], 0, 0
        while todo:
            x = todo.pop()
            leaves += not children[x]
            saved += (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
            todo += children[x]
        ends = ",".join(str(c) for c in sorted(ms) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ms), len(node), parent, len(ms), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df):
    assert df.columns[-1] == "ref"
    return sorted([tuple(r)[:-1] for r in df.collect()], key=str)


def five(c):
    return c - c % 5


def crc(c):
    return zlib.crc32(str(c).encode()) % 9


def ways():
    return F.col("conv") - F.col("conv") % 5, F.crc32(F.col("conv").cast("string").cast("binary")) % 9


def turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(10**6), n // 2) + list(range(n // 2)):
        rows += [(c, k if rng.random() < 0.95 else k + 100, rng.choice(["user", "bot"]), f"t{rng.choice([0, 0, 1])} é{k % 3}") for k in range(rng.randrange(1, 14))]
    rows += [(7000 + c, k, "user", f"copy {k}") for c in range(40) for k in range(6)]
    rows += [(9, None, None, None), (None, 3, "user", "lost"), (11, 5, "user", None), (33, 1, "", "x" * 100000)]
    rows += [(5000, 0, "user", "t0 é0")] * 3
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_rebuilt_conversations(spark, monkeypatch, small):
    if small:
        for name, value in (("CELL", 1), ("BLOCK", 1), ("PIECE", 2)):
            monkeypatch.setattr(T, name, value)
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common, "PARTS", 4)
    rows = turns(small, 60)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, conv int, d string")
    got = T.trie(df, *ways())
    assert nodes(got) == brute(rebuilt(rows, five, crc))
    assert T.trie(df.limit(0), *ways()).collect() == []


def test_stored_conversations_deep_nesting_and_references(spark, monkeypatch):
    """Each conversation leaves the one before one turn later; one is very long."""
    monkeypatch.setattr(T, "BLOCK", 3)
    rows = [(c, k, "u", "same" if k < c else f"own {c}") for c in range(12) for k in range(c + 2)]
    rows += [(50, k, "u", f"long {k % 7}") for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
    got = T.trie(df)
    convs = rebuilt(rows, lambda c: c, lambda c: 0)
    assert nodes(got) == brute(convs)
    for r in got.filter("depth > 0").collect():
        assert convs[r.ref.conv][r.ref.pos - 1] == convs[r.conv_id][r.depth - 1]


def test_colliding_fingerprints_are_found_and_drawn_anew(spark, monkeypatch):
    """The first try takes primes so small that unlike turns and prefixes share their remainders."""
    make, large, tried = T._nodes, T.PRIMES, []

    def attempt(*a):
        monkeypatch.setattr(T, "PRIMES", (3, 5) if a[-1] == 0 else large)
        tried.append(make(*a))
        return tried[-1]

    monkeypatch.setattr(T, "_nodes", attempt)
    rows = [(c, k, "u", f"{(c * k) % 19}") for c in range(1, 7) for k in range(1, 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes(T.trie(df)) == brute(rebuilt(rows, lambda c: c, lambda c: 0))
    assert len(tried) == 2 and tried[0] is None
