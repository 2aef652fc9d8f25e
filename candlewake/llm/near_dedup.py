"""Near-duplicate groups by MinHash bands and sequential Bayesian verification.

A document is the set of its five-word shingles. Texts with equal sets are one node.
Signatures cut into bands give candidate pairs; a pair's signatures are compared in
batches, and the pair is dropped as soon as the posterior chance that its similarity
reaches the threshold falls below ``MISS``. What survives is verified on the whole sets.

A bucket of m nodes gives m - 1 pairs, each node with the smallest. Nodes that are in one
group after that need no further comparison. Nodes of buckets that still hold several
groups are compared across groups by their rarest shingles: sets this similar share one
early in the order of rarity. Shingles that few such nodes have early give pairs. The nodes
of a crowded one are cut into blocks and compared block against block inside a task, which
puts out a spanning forest of the links it has verified and never the pairs. Before signatures and
sets are looked at, counts of the shingles in 256 cells rule out most pairs: what they differ by is
the least that the sets differ by. So large groups of copies cost a star, and no link between
different groups is left out. What stays quadratic is the comparison of such counts (about a million
pairs a second and core) within a crowd of unlinked texts that share a rare passage.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewake.llm.common import row_id, sized, spread_join
from candlewake.session import scratch, stage

SHINGLE = 5
#: Similarity of linked documents, in hundredths.
PERCENT = 75
#: 32 bands of 4 hashes: a pair at the threshold is missed with a chance of 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared at a time, and the posterior chance below which a pair is given up.
BATCH = 16
MISS = 1e-6
#: Cells in which shingles are counted.
CELLS = 256
#: Nodes with one shingle early that are still paired; more are compared in blocks.
FEW = 64
#: Nodes, and bytes of their sets, of a block.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = np.random.RandomState(7).randint(1, 1 << 62, (2, HASHES)).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows; words are lower-cased for A-Z and split at white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    seen: dict[bytes, int] = {}
    hashed = np.fromiter(
        (seen.get(w) or seen.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words)
    )
    n = max(1, len(words) - size + 1)
    total = np.full(n, np.uint64(min(len(words), size)))
    for i in range(min(size, len(words))):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + n])
    return np.unique(total)


def signature(items: np.ndarray) -> np.ndarray:
    """``HASHES`` minima, 32 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(items), 2048):
        part = items[at : at + 2048, None] * (_SEEDS[0] | np.uint64(1)) + _SEEDS[1]
        np.minimum(least, (part >> np.uint64(32)).astype(np.uint32).min(axis=0), out=least)
    return least


def cell_counts(items: np.ndarray) -> np.ndarray:
    """How many of the shingles fall into each cell, up to 255."""
    return np.minimum(np.bincount((items >> np.uint64(56)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8)


def may_link(n_a: np.ndarray, counts_a: np.ndarray, n_b: np.ndarray, counts_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs can be similar enough by their sizes and what their counts differ by, the least the sets do."""
    apart = np.abs(counts_a.astype(np.int16) - counts_b).sum(axis=-1, dtype=np.int64)
    return (100 + percent) * apart <= (100 - percent) * (n_a + n_b)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each batch, the matches among the hashes so far that keep a pair alive.

    The prior of the similarity is uniform; after m of n matches the chance that it
    is at least t is that of at most m successes in n + 1 draws of chance t.
    """
    t, least = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
        least.append(m)
    return least


def alive(a: np.ndarray, b: np.ndarray, least_of: list[int]) -> np.ndarray:
    """Which rows of two signature matrices survive all batches, with ``least_of`` from :func:`least_matches`."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k, least in enumerate(least_of):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[left] += (a[left, part] == b[left, part]).sum(axis=1)
        left = left[matches[left] >= least]
    keep = np.zeros(len(a), bool)
    keep[left] = True
    return keep


def _sets(docs: DataFrame, what: str) -> DataFrame:
    """``id, n`` with, for ``what``: ``marks``: print, signature, counts; ``items``: the whole set; ``both``: own, signature, counts, items."""
    kinds = {"own": pa.int64()} | dict.fromkeys(["print", "signature", "counts", "items"], pa.binary())
    names = {"marks": ["print", "signature", "counts"], "items": ["items"], "both": ["own", "signature", "counts", "items"]}[what]
    make = {
        "print": lambda s: hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None,
        "own": own_hash,
        "signature": lambda s: signature(s).tobytes() if len(s) else None,
        "counts": lambda s: cell_counts(s).tobytes(),
        "items": lambda s: s.tobytes(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingles(t or b"") for t in part.column(1).to_pylist()]
                cells = [part.column(0), pa.array([len(s) for s in sets], pa.int64())]
                cells += [pa.array([make[c](s) for s in sets], kinds[c]) for c in names]
                yield pa.RecordBatch.from_arrays(cells, ["id", "n", *names])

    return docs.mapInArrow(run, ", ".join(["id long, n long", *[f"{c} {'long' if c == 'own' else 'binary'}" for c in names]]))


def own_hash(items: np.ndarray) -> int:
    """Tells the texts of one id apart."""
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


def _matrix(column: pa.Array, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _surviving(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that counts and signatures do not rule out."""
    least = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                n, c, s = ([part.column(f"{x}{y}") for y in "ab"] for x in "ncs")
                keep = alive(*map(_matrix, s), least)
                keep &= may_link(n[0].to_numpy(), _matrix(c[0], np.uint8), n[1].to_numpy(), _matrix(c[1], np.uint8))
                yield part.select(["a", "b"]).filter(pa.array(keep))

    mark = nodes.select("id", "n", "counts", "signature")
    both = pairs.join(mark.toDF("a", "na", "ca", "sa"), "a").join(mark.toDF("b", "nb", "cb", "sb"), "b")
    return both.mapInArrow(run, "a long, b long").distinct()


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                keep.append(linked(x, y))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.join(sized(ids, "near-ids"), "id", "left_semi").select("id", "text").dropDuplicates()
    sets = stage(_sets(texts, "items").select("id", "items"), "near-sets")
    both = pairs.join(sets.toDF("a", "ia"), "a").join(sets.toDF("b", "ib"), "b").select("a", "b", "ia", "ib")
    return both.mapInArrow(run, "a long, b long").distinct()


def forest(side: np.ndarray, ids: np.ndarray, comps: np.ndarray, n: np.ndarray, counts: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], least: list[int]) -> list[tuple[int, int]]:
    """Links between nodes of different groups that join all groups which links between the sides join.

    Nodes of ``side`` 0 are compared with those of side 1, nodes of side 2 with each other.
    """
    of = np.unique(comps, return_inverse=True)[1]
    alone = (side == 2).any()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    found = []
    for i in left:
        rest = right[right > i] if alone else right
        rest = rest[of[rest] != of[i]]
        rest = rest[may_link(n[i], counts[i], n[rest], counts[rest])]
        rest = rest[alive(np.broadcast_to(signatures[i], (len(rest), HASHES)), signatures[rest], least)]
        while len(rest):
            j, rest = rest[0], rest[1:]
            if linked(sets[i], sets[j]):
                found.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                of[of == of[j]] = of[i]
                rest = rest[of[rest] != of[i]]
    return found


def _in_crowds(crowds: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) among the nodes ``item, id, comp, own, blocks`` of each item, block against block."""
    least = least_matches()

    def run(group: pa.Table) -> pa.Table:
        cells = [group.column(c).to_numpy() for c in ("id", "comp", "n")]
        marks = [_matrix(group.column("counts"), np.uint8), _matrix(group.column("signature"))]
        sets = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        found = forest(group.column("side").to_numpy(), *cells, *marks, sets, least)
        return pa.table({c: pa.array([x[k] for x in found], pa.int64()) for k, c in enumerate("ab")})

    own = F.pmod(F.xxhash64("id", "own"), F.col("blocks"))
    ways = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, own).alias("lo"), F.greatest(x, own).alias("hi"), F.when(x == own, 2).otherwise((x < own).cast("int")).alias("side")),
    )
    rows = crowds.select("item", "id", "comp", "own", F.explode(ways).alias("way")).select("item", "id", "comp", "own", "way.*")
    ids = crowds.select("id").distinct()
    whole = texts.join(sized(ids, "near-ids"), "id", "left_semi").select("id", "text").dropDuplicates()
    whole = stage(_sets(whole, "both").dropDuplicates(["id", "own"]), "near-whole")
    met = rows.join(whole, ["id", "own"])
    return met.groupBy("item", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def _across_groups(nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``nodes`` (id, comp): pairs (a, b) of different groups, and verified links within crowds.

    Together they hold all that can be similar enough. With n and m shingles two sets need
    t / (1 + t) * (n + m) in common. Ordered by how many nodes have a shingle, the first common
    one must come before too little is left for that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingles(t or b"") for t in part.column(2).to_pylist()]
                n = np.array([len(s) for s in sets])
                own = np.array([own_hash(s) for s in sets], np.int64)
                rows = np.repeat(np.arange(len(sets)), n)
                items = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
                cells = [part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))]
                cells += [pa.array(x) for x in (own[rows], n[rows], items)]
                yield pa.RecordBatch.from_arrays(cells, ["id", "comp", "own", "n", "item"])

    texts = docs.join(sized(nodes, "near-open"), "id").select("id", "comp", "text").dropDuplicates()
    items = stage(texts.mapInArrow(run, "id long, comp long, own long, n long, item long"), "near-items")
    shared = stage(items.groupBy("item").agg(F.count("*").alias("times")).filter("times > 1"), "near-shared")
    one = Window.partitionBy("id", "own")
    place = F.row_number().over(one.orderBy("times", "item")) - 1 + F.col("n") - F.count("*").over(one)
    early = items.join(shared, "item").withColumn("left", F.col("n") - place).drop("times")
    early = stage(early.filter(100 * F.col("left") >= PERCENT * F.col("n")), "near-early")
    held = early.groupBy("item").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    many = stage(held.filter(f"m > {FEW} AND lo < hi").select("item", "m", "size"), "near-crowded")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("size") * 8 / BLOCK_BYTES)).cast("long")
    crowds = spread_join(early, many.withColumn("blocks", blocks), ["item"], "m", early.count(), F.xxhash64("id"))
    few = early.join(stage(held.filter(f"m <= {FEW} AND lo < hi").select("item"), "near-few"), "item", "left_semi")
    short = few.filter((100 + PERCENT) * F.col("left") >= 2 * PERCENT * F.col("n"))
    short = short.select("item", *[F.col(c).alias(f"s_{c}") for c in ("id", "comp", "n", "left")])
    need = PERCENT * (F.col("n") + F.col("s_n"))
    pairs = short.join(few, "item").filter(
        (F.col("s_comp") != F.col("comp"))
        & (F.col("s_n") <= F.col("n"))
        & ((100 + PERCENT) * F.col("left") >= need)
        & ((100 + PERCENT) * F.col("s_left") >= need)
    )
    links = stage(_in_crowds(crowds.select("item", "id", "comp", "own", "blocks"), docs), "near-crowd-links")
    return pairs.select(F.least("id", "s_id").alias("a"), F.greatest("id", "s_id").alias("b")).distinct(), links


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for all ends of ``links`` (a, b): the smallest id that is reachable.

    Each round links every node's larger neighbours to its smallest one, then its
    smaller ones; the links become stars in a number of rounds like the logarithm of
    the longest path. Each round is written out, so that plans stay short.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "cc")
    last = None
    while True:
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == last:
            break
        last = sums
        ways = edges.union(edges.select("v", "u"))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        # A hub of many nodes is a hot key on the side of its neighbours.
        low = stage(low.filter("n > 0"), "cc-low")
        large = spread_join(ways.filter("v > u"), low, ["u"], "n", last[0], F.xxhash64("v"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        edges = stage(small.union(low.toDF("u", "v")).distinct(), "cc")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row of ``docs``.

    Texts without words (null, empty, white space) are empty sets, linked with nothing:
    each is its own group. Rows that repeat a key with other texts are one document that
    is linked if one of its texts is. A row without a key links nothing; it takes the
    group of an equal text and is kept only if no row with a key has that text.
    """
    with scratch(docs.sparkSession):
        return stage(_groups(docs, key, text), "near-groups", keep=True)


def _groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    marks = stage(_sets(rows, "marks"), "near-marks")
    found = marks.filter("print is not null and id is not null")
    same = [F.first(c).alias(c) for c in ("n", "counts", "signature")]
    nodes = stage(found.groupBy("print").agg(F.min("id").alias("id"), *same), "near-nodes")
    cut = lambda i: F.substring("signature", i * ROWS * 4 + 1, ROWS * 4)
    keys = F.array(*[F.xxhash64(F.lit(i), cut(i)) for i in range(BANDS)])
    member = nodes.select("id", F.explode(keys).alias("bucket"))
    least = member.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("m")).filter("m > 1")
    buckets = stage(least.select("bucket", "a"), "near-buckets")
    member = stage(member.join(buckets, "bucket").select("bucket", "id", "a"), "near-members")
    star = stage(member.filter("id > a").select("a", F.col("id").alias("b")).distinct(), "near-star")
    texts = rows.filter("id is not null")
    links = stage(_verified(stage(_surviving(star, nodes), "near-alive"), texts), "near-links")
    comps = components(links)
    of = F.coalesce("component", "id").alias("comp")
    placed = stage(member.join(comps, "id", "left").select("bucket", "id", of), "near-placed")
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    mixed = stage(mixed.select("bucket"), "near-mixed")
    open_ = placed.join(mixed, "bucket", "left_semi").select("id", "comp").distinct()
    pairs, crowd_links = _across_groups(open_, texts)
    rest = pairs.join(star, ["a", "b"], "left_anti")
    more = _verified(stage(_surviving(rest, nodes), "near-alive"), texts)
    every = components(stage(links.union(more).union(crowd_links), "near-links"))
    placed = nodes.join(every, "id", "left").select("print", F.coalesce("component", "id").alias("component"))
    return marks.select("id", "n", "print").join(placed, "print", "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.when(F.col("id").isNull(), F.col("component_id").isNull()).otherwise(F.col("id") == F.col("component_id")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near-duplicates one row of ``docs``, all columns as they are.

    Rows are told apart by key and text, so that null and repeated keys are no reason to
    lose a text. The row of the smallest key stays, one without a key only if no row of its
    group has one. Texts without words are alike only in rows of one key; of equal rows one stays.
    """
    rows = docs.withColumn("__row", row_id(key, text))
    with scratch(docs.sparkSession):
        comps = groups(rows, "__row", text).select(F.col("id").alias("__row"), "component_id").distinct()
        named = rows.select("__row", F.col(key).alias("__key")).distinct()
        rank = F.struct(F.col("__key").isNull(), "__key", "__row")
        first = named.join(comps, "__row").groupBy("component_id").agg(F.min(rank).alias("first"))
        kept = stage(first.select(F.col("first.__row")), "near-kept", keep=True)
    return rows.dropDuplicates(["__row"]).join(kept, "__row", "left_semi").select(*docs.columns)
