"""Exact duplicates by counting quotient filters.

A text's fingerprint is 64 bits of its normalised form: the quotient is its upper part, the
remainder the rest. A task builds a filter of the fingerprints it sees, with counts, cut into
slices of the fingerprint space; filters of a slice are merged by their sorted remainders.
Nothing is lost in either step, as quotient and remainder give the fingerprint back. Only
texts whose fingerprint the merged filter counts more than once are compared, byte by byte.

A filter is a byte string: the number of slots, the bits of a quotient, the bytes of a slot; one
bit for each quotient that occurs; for each slot one bit for the last slot of a quotient's run and one
for a digit of a counter; then the slots. A remainder that occurs c > 1 times is followed by
the digits of c - 1, lowest first.

Rows with null texts count as empty ones, which equal each other and not a text of white space
(that one is a single space). Rows without a key rank behind those with one: a group of only such rows has no
``keep_id`` and all of them are kept. Rows that tie for the smallest key are all kept by ``groups``;
``one_of_each`` returns one of them. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewake.llm.common import WHITE, spread_join
from candlewake.session import scratch, stage

BITS = 64
#: Rows for which one slice of the fingerprint space is made.
SLICE_ROWS = 1 << 18
#: Fingerprints a task holds before it writes out its filters and begins new ones.
TASK_ROWS = 1 << 20
_HEAD = "<QBB"


def pack(keys: np.ndarray, counts: np.ndarray, tail: int) -> bytes:
    """The filter of ascending distinct ``keys`` below ``2**tail``, each with its count."""
    n = len(keys)
    quotient_bits = min(max(n - 1, 1).bit_length(), tail)
    rest = tail - quotient_bits
    wide = max(1, (rest + 7) // 8)
    quotients = (keys >> np.uint64(rest)).astype(np.int64)
    more = (counts - 1).astype(np.uint64)
    digits, left = np.zeros(n, np.int64), more.copy()
    while left.any():
        digits += left > 0
        left = left >> np.uint64(8 * wide) if wide < 8 else np.zeros_like(left)
    at = np.concatenate([[0], np.cumsum(digits + 1)])
    slots, digit, end = np.zeros(at[-1], np.uint64), np.zeros(at[-1], bool), np.zeros(at[-1], bool)
    slots[at[:-1]] = keys & np.uint64((1 << rest) - 1)
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        slots[at[:-1][has] + 1 + k] = more[has] >> np.uint64(8 * wide * k)
        digit[at[:-1][has] + 1 + k] = True
    last = np.flatnonzero(np.append(quotients[1:] != quotients[:-1], n > 0)) if n else np.empty(0, np.int64)
    end[at[last + 1] - 1] = True
    taken = np.zeros(1 << quotient_bits, bool)
    taken[quotients] = True
    body = slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
    return struct.pack(_HEAD, len(slots), quotient_bits, wide) + b"".join(np.packbits(b).tobytes() for b in (taken, end, digit)) + body


def unpack(data: bytes, tail: int) -> tuple[np.ndarray, np.ndarray]:
    """The ascending keys of a filter and their counts."""
    n, quotient_bits, wide = struct.unpack_from(_HEAD, data)
    at = struct.calcsize(_HEAD)

    def bits(size: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
        at += len(part)
        return np.unpackbits(part, count=size).astype(bool)

    taken, end, digit = bits(1 << quotient_bits), bits(n), bits(n)
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at).reshape(n, wide)
    slots = slots.reshape(-1).view("<u8").astype(np.uint64)
    # The i-th run holds the remainders of the i-th quotient that occurs.
    run = np.cumsum(end) - end
    first = np.flatnonzero(~digit)
    quotients = np.flatnonzero(taken).astype(np.uint64)[run[first]]
    rest = tail - quotient_bits
    keys = (quotients << np.uint64(rest) if rest < BITS else np.zeros_like(quotients)) | slots[first]
    counts = np.ones(len(first), np.int64)
    where = np.flatnonzero(digit)
    owner = np.cumsum(~digit)[where] - 1
    place = (where - first[owner] - 1) * 8 * wide
    np.add.at(counts, owner, (slots[where] << place.astype(np.uint64)).astype(np.int64))
    return keys, counts


def combine(filters: list[bytes], tail: int) -> bytes:
    """One filter for all: equal keys meet in sorted order and add their counts."""
    parts = [unpack(f, tail) for f in filters]
    keys = np.concatenate([np.empty(0, np.uint64), *[p[0] for p in parts]])
    counts = np.concatenate([np.empty(0, np.int64), *[p[1] for p in parts]])
    if not len(keys):
        return pack(keys, counts, tail)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return pack(keys[starts], np.add.reduceat(counts, starts), tail)


def slice_bits(rows: int) -> int:
    """Upper bits of a fingerprint that name its slice."""
    return max(1, (max(rows, 1) // SLICE_ROWS).bit_length())


def build(prints: DataFrame, bits: int) -> DataFrame:
    """``slice, filter`` of the fingerprints ``fp``: one row for each slice, whatever the partitions were."""
    tail = BITS - bits

    def filters(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
        part = (keys >> np.uint64(tail)).astype(np.int32)
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        low = keys & np.uint64((1 << tail) - 1)
        cells = [pack(low[a:b], counts[a:b], tail) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(cells, pa.binary())], ["slice", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch.column(0).to_numpy())
                size += len(batch)
            if size >= TASK_ROWS:
                yield filters(held)
                held, size = [], 0
        if held:
            yield filters(held)

    return merged(prints.select("fp").mapInArrow(run, "slice int, filter binary"), bits)


def merged(filters: DataFrame, bits: int) -> DataFrame:
    """One filter for each slice from any number of them; so corpora built apart can be put together."""
    tail = BITS - bits

    def run(group: pa.Table) -> pa.Table:
        whole = combine(group.column("filter").to_pylist(), tail)
        return pa.table({"slice": group.column("slice")[:1], "filter": pa.array([whole], pa.binary())})

    return filters.groupBy("slice").applyInArrow(run, "slice int, filter binary")


def counted(filters: DataFrame, bits: int, least: int = 2) -> DataFrame:
    """``fp, n``: the fingerprints that the filters count at least ``least`` times."""
    tail = BITS - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = unpack(data, tail)
                keep = counts >= least
                keys = (keys[keep] | np.uint64(part << tail)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts[keep])], ["fp", "n"])

    return filters.select("slice", "filter").mapInArrow(run, "fp long, n long")


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is an empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("body")).withColumn("fp", F.xxhash64("body"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``."""
    with scratch(docs.sparkSession):
        return stage(_groups(docs, key, text), "exact-groups", keep=True)


def _groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    found = _read(docs, key, text)
    rows = stage(found.select("id", "fp", F.sha2("body", 256).alias("text_sha256")), "exact-rows")
    total = rows.count()
    bits = slice_bits(total)
    repeated = stage(counted(build(rows, bits), bits), "exact-repeated")
    alike = spread_join(found, repeated, ["fp"], "n", total, F.xxhash64("id"))
    same = alike.groupBy("fp", "body").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    same = same.filter("group_size > 1").withColumn("text_sha256", F.sha2("body", 256)).drop("body")
    same = stage(same.withColumn("found", F.lit(True)), "exact-same")
    every = spread_join(rows, same, ["fp", "text_sha256"], "group_size", total, F.xxhash64("id"), "left")
    keep = F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("id"))
    return every.select(
        "id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each distinct text, all columns as they are: that of the smallest key."""
    number = F.monotonically_increasing_id()
    with scratch(docs.sparkSession):
        rows = stage(docs.withColumn("__row", number), "exact-docs", keep=True)
        named = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__row").alias("row"))
        comps = groups(rows.withColumn("__id", named), "__id", text)
        gone = stage(comps.filter(~F.col("kept")).select(F.col("id.row").alias("__row")), "exact-gone", keep=True)
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)
