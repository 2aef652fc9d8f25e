"""The prefix trie of conversations that are rebuilt from parts of stored ones.

A rebuilt conversation is the head of its base followed by its own turns from there on. Neither
its texts nor its list of turns is ever put together. The fingerprint of a sequence of turns is an
element of a monoid: t(1) B + t(2) B^2 + ... modulo two primes, with t the hash of a turn. Sums of a
stored conversation's prefixes are worked out once. The prefix of a rebuilt one is then head times
suffix: its own sum, less that of the turns left out, shifted by a power of B, plus the base's sum.

Rebuilt prefixes of one length and fingerprint are a node. Each carries the reference (conversation,
position) of the stored turn at its end, whose hash stands for it. Equality is verified from there:
the hash of each stored turn belongs to one role and text, compared in full where it occurs twice, and
all members of a node end with the same hash. A sum less its last term is the parent's sum, so members of
a node are equal turn by turn. If either check fails, all is done again with another seed.

A node is named by its smallest member, so the nodes of one name are a chain: a path from where the
conversation leaves its smaller relatives to its end. Sums over subtrees are sums along a chain plus
those of the chains that leave it; each chain sends its total to all chains on its own path, so no
round per level is needed.

No step groups rows by conversation alone but in sums that combine before the shuffle: turns are ordered
in cells of ``CELL`` turn numbers, chains in blocks of ``BLOCK`` depths, lists of members in ranges of ids.

Null roles and texts count as empty; null turn numbers come first; turns of one number are ordered by
their hash. Equal rows are turns of their own. Rows without a conversation belong to none and are left
out. Conversation and turn numbers are whole numbers. An empty table gives no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewake.llm.common import spread_join
from candlewake.session import scratch, stage

#: The two largest primes below 2^31: products of two remainders fit a long.
PRIMES = (2147483647, 2147483629)
#: Turn numbers that are ordered together, as a power of two.
CELL = 8
#: Depths whose sums along a chain are added together, as a power of two.
BLOCK = 12
#: Most turns a head may have.
MOST_HEAD = 8
#: Ids of members that are written as one piece, about.
PIECE = 1024


class Sums:
    """Fingerprints modulo one prime."""

    def __init__(self, prime: int, seed: int) -> None:
        self.prime = prime
        self.base = int(hashlib.sha256(f"{prime} {seed}".encode()).hexdigest(), 16) % (prime - 2) + 2
        back = pow(self.base, -1, prime)
        array = lambda values: F.expr(f"array({', '.join(f'{v}L' for v in values)})")
        self.inverse = array(pow(back, i, prime) for i in range(MOST_HEAD + 1))
        self.digits = [array(pow(self.base, i << (6 * k), prime) for i in range(64)) for k in range(6)]

    def power(self, i: Column) -> Column:
        """The base to the power of ``i`` (below 2^36)."""
        out = F.lit(1).cast("long")
        for k, digit in enumerate(self.digits):
            out = self.times(out, digit[F.shiftright(i, 6 * k).bitwiseAND(63).cast("int")])
        return out

    def times(self, a: Column, b: Column) -> Column:
        return F.pmod(a * b, F.lit(self.prime))

    def plus(self, a: Column, b: Column) -> Column:
        return F.pmod(a + b, F.lit(self.prime))


def _both(make) -> Column:
    """Two remainders as one number."""
    return F.shiftleft(make(0), 31).bitwiseOR(make(1))


def _half(both: Column, k: int) -> Column:
    return F.shiftright(both, 31) if k == 0 else both.bitwiseAND((1 << 31) - 1)


def _map2(sums: list[Sums], body) -> Column:
    return _both(lambda k: body(sums[k], lambda both: _half(both, k)))


def stored_prefixes(turns: DataFrame, sums: list[Sums]) -> DataFrame:
    """``conv, pos, t, size, f`` of each stored turn: its place, hash, bytes, and the fingerprint up to it.

    ``turns`` is staged: conv, turn, t, size.
    """
    place = Window.partitionBy("conv", "cell").orderBy(F.asc_nulls_first("turn"), "t")
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("cell", F.shiftright("turn", CELL)).withColumn("i", F.row_number().over(place).cast("long"))
    for k, s in enumerate(sums):
        rows = rows.withColumn(f"s{k}", s.times(_half(F.col("t"), k), s.power(F.col("i"))))
        rows = rows.withColumn(f"s{k}", F.pmod(F.sum(f"s{k}").over(upto), F.lit(s.prime)))
    rows = stage(rows.withColumn("cell", F.coalesce("cell", F.lit(-(1 << 62)))), "trie-cells")
    ends = rows.groupBy("conv", "cell").agg(F.max(F.struct("i", "s0", "s1")).alias("end"))
    before = Window.partitionBy("conv").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("off", F.coalesce(F.sum("end.i").over(before), F.lit(0)))
    for k, s in enumerate(sums):
        ends = ends.withColumn(f"f{k}", s.times(F.col(f"end.s{k}"), s.power(F.col("off"))))
        ends = ends.withColumn(f"f{k}", F.pmod(F.coalesce(F.sum(f"f{k}").over(before), F.lit(0)), F.lit(s.prime)))
    whole = rows.join(ends.drop("end"), ["conv", "cell"])
    f = _both(lambda k: sums[k].plus(F.col(f"f{k}"), sums[k].times(F.col(f"s{k}"), sums[k].power(F.col("off")))))
    return whole.select("conv", (F.col("off") + F.col("i")).alias("pos"), "t", "size", f.alias("f"))


def rebuilt_prefixes(stored: DataFrame, sums: list[Sums], base: Column, head: Column, total: int) -> DataFrame:
    """``conv, d, f, t, size, ref, last`` of each prefix of each rebuilt conversation, the empty one included.

    ``base`` and ``head`` are expressions of ``conv``; ``ref`` is the stored turn at the prefix's end.
    """
    short = F.col("pos") <= MOST_HEAD
    entry = F.when(short, F.struct("pos", "t", "size", "f"))
    convs = stored.groupBy("conv").agg(F.max("pos").alias("len"), F.array_sort(F.collect_list(entry)).alias("own"))
    convs = stage(convs.withColumn("base", base).withColumn("h", head.cast("long")), "trie-convs")
    heads = convs.select(F.col("conv").alias("base"), F.col("own").alias("of_base"))
    at = lambda entries, n: F.coalesce(F.try_element_at(entries, n.cast("int"))["f"], F.lit(0))
    held = F.when(F.col("of_base").isNull(), 0).otherwise(F.size("of_base")).cast("long")
    info = convs.join(heads, "base", "left").withColumn("k", F.least(F.col("h"), held))
    info = info.withColumn("left_out", F.when((F.col("h") > 0) & (F.col("len") > F.col("h")), at(F.col("own"), F.col("h"))).otherwise(0))
    info = info.withColumn("given", F.when(F.col("k") > 0, at(F.col("of_base"), F.col("k"))).otherwise(0))
    info = info.withColumn("depth", F.col("k") + F.greatest(F.col("len") - F.col("h"), F.lit(0)))
    info = stage(info.select("conv", "base", "h", "k", "len", "left_out", "given", "depth", F.slice("of_base", F.lit(1), F.col("k").cast("int")).alias("head")), "trie-info")
    no_ref = F.lit(None).cast("struct<conv:long,pos:long>")
    roots = info.select("conv", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("size"), no_ref.alias("ref"), (F.col("depth") == 0).alias("last"))
    given = info.select("conv", "base", "depth", F.explode("head").alias("e")).select(
        "conv", F.col("e.pos").alias("d"), "e.f", "e.t", "e.size", F.struct(F.col("base").alias("conv"), F.col("e.pos").alias("pos")).alias("ref"), (F.col("e.pos") == F.col("depth")).alias("last")
    )
    ways = info.select("conv", "h", "k", "len", "left_out", "given", "depth")
    own = spread_join(stored.withColumn("__h", head).filter("pos > __h").drop("__h"), ways, ["conv"], "len", total, F.xxhash64("pos"))
    shifted = _map2(
        sums,
        lambda s, half: s.plus(
            half(F.col("given")),
            s.times(s.plus(half(F.col("f")), -half(F.col("left_out"))), s.inverse[(F.col("h") - F.col("k")).cast("int")]),
        ),
    )
    d = F.col("pos") - F.col("h") + F.col("k")
    own = own.select("conv", d.alias("d"), shifted.alias("f"), "t", "size", F.struct("conv", "pos").alias("ref"), (d == F.col("depth")).alias("last"))
    return roots.union(given).union(own)


def ambiguous_hashes(turns: DataFrame, contents: DataFrame, total: int) -> bool:
    """Whether a hash ``t`` stands for two different roles or texts; only those that occur twice are compared."""
    twice = stage(turns.groupBy("t").agg(F.count("*").alias("n")).filter("n > 1"), "trie-twice")
    alike = spread_join(contents, twice, ["t"], "n", total, F.xxhash64("conv")).select("t", "role", "text").distinct()
    return not alike.groupBy("t").count().filter("count > 1").isEmpty()


def members_sha256(ends: DataFrame) -> DataFrame:
    """``d, f, ends_sha256``: of the ids ``conv`` of each node, ascending and joined by commas.

    Ranges of ids are written as pieces in parallel; one digest then runs over a node's pieces in order.
    """
    lo, hi, n = ends.agg(F.min("conv"), F.max("conv"), F.count("*")).first()
    width = max(1, (hi - lo + 1) // max(1, n // PIECE)) if n else 1
    piece = F.expr(f"CAST((CAST(conv AS DECIMAL(20, 0)) - {lo or 0}) AS DECIMAL(20, 0)) div {width}")
    pieces = ends.groupBy("d", "f", piece.alias("piece")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    pieces = pieces.select("d", "f", "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for d, f, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if node != (d, f):
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (d, f), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield rows(done)
        if node is not None:
            yield rows([(*node, digest.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], ["d", "f", "ends_sha256"])

    dealt = pieces.repartition("d", "f").sortWithinPartitions("d", "f", "piece").select("d", "f", "ids")
    return dealt.mapInArrow(run, "d long, f long, ends_sha256 string")


def along_chains(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``nodes`` (m, d, ...) with each of ``names`` summed over the node and those below it in its chain."""
    rows = stage(nodes.withColumn("block", F.shiftright("d", BLOCK)), "trie-nodes")
    blocks = rows.groupBy("m", "block").agg(*[F.sum(c).alias(f"{c}_below") for c in names])
    below = Window.partitionBy("m").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("m", "block", *[F.coalesce(F.sum(f"{c}_below").over(below), F.lit(0)).alias(f"{c}_below") for c in names])
    inside = Window.partitionBy("m", "block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.join(blocks, ["m", "block"])
    return whole.withColumns({c: F.sum(c).over(inside) + F.col(f"{c}_below") for c in names})


def trie(
    turns: DataFrame,
    base: Column | None = None,
    head: Column | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, ref``.

    ``base`` and ``head`` are expressions of ``conv``: whose first ``head`` turns (at most ``MOST_HEAD``) go before the
    conversation's own turns from that place on. By default a conversation is its own base and so rebuilt as it is.
    ``ref`` names the stored turn (conversation, position) at the node's end.
    """
    base, head = F.col("conv") if base is None else base, F.lit(0) if head is None else head
    found = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    with scratch(turns.sparkSession):
        seed = 0
        while True:
            made = _nodes(found, base, head, seed)
            if made is not None:
                return stage(_measured(*made), "trie", keep=True)
            seed += 1


def _nodes(found: DataFrame, base: Column, head: Column, seed: int) -> tuple[DataFrame, DataFrame, int] | None:
    """Rebuilt prefixes, verified nodes and the number of prefixes; nothing if two unlike prefixes share a node."""
    sums = [Sums(p, seed) for p in PRIMES]
    hashed = _both(lambda k: F.pmod(F.xxhash64(F.lit(2 * seed + k), "role", "text"), F.lit(PRIMES[k])))
    contents = found.withColumn("t", hashed)
    turns = stage(contents.select("conv", "turn", "t", F.octet_length("text").cast("long").alias("size")), "trie-turns")
    total = turns.count()
    if ambiguous_hashes(turns, contents, total):
        return None
    stored = stage(stored_prefixes(turns, sums), "trie-stored")
    rebuilt = stage(rebuilt_prefixes(stored, sums, base, head, total), "trie-rebuilt")
    nodes = rebuilt.groupBy("d", "f").agg(
        F.min("conv").alias("m"), F.count("*").alias("n"), F.max("size").alias("size"), F.min("t").alias("t"), F.max("t").alias("t_most"), F.min("ref").alias("ref")
    )
    nodes = stage(nodes, "trie-groups")
    if not nodes.filter("t <> t_most").isEmpty():
        return None
    return rebuilt, nodes.drop("t", "t_most"), rebuilt.count()


def _measured(rebuilt: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    chains = nodes.groupBy("m").agg(
        F.min("d").alias("from"), F.max("d").alias("to"), F.sum((F.col("n") - 1) * F.col("size")).alias("w")
    )
    chains = stage(chains, "trie-chains")
    shared = stage(nodes.filter("n > 1").select("d", "f", "m", "n"), "trie-shared")
    paths = spread_join(rebuilt.select("conv", "d", "f"), shared, ["d", "f"], "n", total, F.xxhash64("conv"))
    paths = paths.filter("m < conv").groupBy("conv", "m").agg(F.max("d").alias("d"))
    # Only chains have totals to send; a conversation that names no node has none.
    paths = paths.join(chains.select(F.col("m").alias("conv"), "from", "w"), "conv")
    paths = stage(paths.withColumn("direct", (F.col("d") == F.col("from") - 1).cast("long")), "trie-paths")
    forks = paths.filter("direct = 1").groupBy("m", "d").agg(F.count("*").alias("k"))
    leaves = stage(chains.join(forks.withColumnRenamed("d", "to"), ["m", "to"], "left_anti").select("m", "to"), "trie-leaves")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    marks = (
        paths.select("m", "d", "w", zero.alias("leaf"), F.col("direct").alias("k"), none.alias("parent"))
        .union(paths.join(leaves.select(F.col("m").alias("conv")), "conv").select("m", "d", zero, zero + 1, zero, none))
        .union(leaves.select("m", "to", zero, zero + 1, zero, none))
        .union(paths.filter("direct = 1").select("conv", "from", zero, zero, zero, "m"))
    )
    marks = marks.groupBy("m", "d").agg(
        F.sum("w").alias("w"), F.sum("leaf").alias("leaf"), F.sum("k").alias("k"), F.max("parent").alias("parent")
    )
    ends = members_sha256(rebuilt.filter("last").select("d", "f", "conv"))
    none_ends = hashlib.sha256(b"").hexdigest()
    every = nodes.join(marks, ["m", "d"], "left").join(ends, ["d", "f"], "left").select(
        "m",
        "d",
        "n",
        "ref",
        (F.coalesce("w", zero) + (F.col("n") - 1) * F.col("size")).alias("saved"),
        F.coalesce("leaf", zero).alias("leaves"),
        F.lit(1).alias("nodes"),
        F.coalesce("k", zero).alias("k"),
        "parent",
        F.coalesce("ends_sha256", F.lit(none_ends)).alias("ends_sha256"),
    )
    every = along_chains(every, ["saved", "leaves", "nodes"])
    return every.select(
        F.col("m").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") > 0, F.coalesce("parent", "m")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (F.col("k") + (F.col("nodes") > 1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
        "ref",
    )
