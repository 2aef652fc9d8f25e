"""Removal of byte strings that are repeated anywhere, by blockwise sorting of suffixes.

Suffixes are sorted one bucket at a time, and ties are resolved by ranks of a cover
sample, so that no task needs more than one bucket and no suffix more than the bytes
up to its sample. The sample is chosen by content: of the ``GRAM``-byte strings
inside a ``SPAN``-byte window, the one of least hash, leftmost if tied. Like the positions
of a difference cover it is met within a bounded distance by every two equal suffixes, at
the same distance; but equal windows always choose the same string, so that it also names
their bucket, and one position in 70 is in the sample, instead of one in 8.

1. Windows that choose the same position form a run; a run with its bytes is a row
   (bucket, hash of the bytes). Buckets met once hold nothing repeated.
2. Runs of equal bytes are repeated as a whole.
3. Of each distinct run of a bucket that has several, the bytes are fetched. What follows
   the sample position is sorted and ranked once, and so is what precedes it, read
   backwards. The windows at one distance are equal where both ranks tie to that depth.
4. Buckets of more than ``CROWD`` distinct runs are cut into cells of some windows each, and
   these, where they differ but overlap, into windows; both are counted by hash, which
   spreads them over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewake.session import stage

#: Length of the repeated strings, and of the strings that the sample is chosen among.
SPAN, GRAM = 200, 64
#: Positions that a window chooses among.
REACH = SPAN - GRAM + 1
#: Bytes looked at together; longer texts are taken in overlapping pieces.
PIECE = 1 << 19
#: Distinct runs of a bucket up to which one task sorts it.
CROWD = 1000
#: Neighbouring windows of a run that are counted together in crowded buckets.
CELL = 12
#: Runs that a task sorts together, in whole buckets.
ROWS = 8192

_RANDOM = np.random.RandomState(11)
_TABLE = _RANDOM.randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_POSITION = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, np.uint64(base))
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``GRAM``-byte strings at each position."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_BASE, n), out=sums[1:])
    x = (sums[GRAM:] - sums[:-GRAM]) * _powers(pow(_BASE, -1, 1 << 64), n)[: n - GRAM + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def runs(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Buckets, sample positions, and first and last window of the runs in texts laid end to end.

    ``ends`` are the ends of the texts; windows lie inside one text.
    """
    if len(data) < SPAN:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    found = _hashes(np.frombuffer(data, np.uint8))
    least = (found & ~_POSITION) | np.arange(len(found), dtype=np.uint64)
    width = 1
    while width * 2 <= REACH:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = REACH - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    chosen = (least & _POSITION).astype(np.int64)
    at = np.arange(len(chosen))
    end = ends[np.searchsorted(ends, at, side="right")]
    inside = at + SPAN <= end
    at, chosen, end = at[inside], chosen[inside], end[inside]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (end[1:] != end[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return found[chosen[first]], chosen[first], at[first], at[last[: len(first)]]


def _pieces(ids: list, texts: list[bytes | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, list]]:
    """Texts laid end to end: bytes, ends, offsets inside the text, ids. Pieces of a long text overlap by a window."""
    data, ends, offsets, names = [], [], [], []
    size = 0

    def packed():
        return b"".join(data), np.array(ends), np.array(offsets), list(names)

    for name, text in zip(ids, texts, strict=True):
        text = text or b""
        for at in range(0, max(1, len(text) - SPAN + 1), PIECE):
            part = text[at : at + PIECE + SPAN - 1]
            data.append(part)
            size += len(part)
            ends.append(size)
            offsets.append(at)
            names.append(name)
            if size >= PIECE:
                yield packed()
                data, ends, offsets, names, size = [], [], [], [], 0
    if data:
        yield packed()


def _pack(low: np.ndarray, count: np.ndarray, before: np.ndarray) -> np.ndarray:
    """First window, windows after it, and distance of the sample from it, in one number."""
    return (low << 16) | (count << 8) | before


def _unpacked(name: str = "run") -> dict[str, Column]:
    return {
        "lo": F.call_function("shiftright", F.col(name), F.lit(16)),
        "more": F.call_function("shiftright", F.col(name), F.lit(8)).bitwiseAND(F.lit(255)),
    }


def _list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            for data, ends, offsets, names in _pieces(part.column(0).to_pylist(), part.column(1).to_pylist()):
                bucket, sample, low, high = runs(data, ends)
                view = memoryview(data)
                content = np.fromiter(
                    (
                        xxhash.xxh3_64_intdigest(view[a : b + SPAN], seed=x - a)
                        for a, b, x in zip(low.tolist(), high.tolist(), sample.tolist(), strict=True)
                    ),
                    np.uint64,
                    len(low),
                )
                text = np.searchsorted(ends, low, side="right")
                start = low - np.where(text > 0, ends[text - 1], 0) + offsets[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket.view(np.int64)),
                        pa.array(content.view(np.int64)),
                        pa.array(np.array(names, np.int64)[text]),
                        pa.array(_pack(start, high - low, sample - low)),
                    ],
                    ["bucket", "content", "id", "run"],
                )


def repeated_windows(buckets: np.ndarray, parts: list[bytes], run: np.ndarray) -> np.ndarray:
    """For rows of whole buckets, which of their windows are in another row: a matrix by row and distance.

    ``parts`` are the bytes from the first window to the end of the last. The
    distance is that from a window's start to the sample position.
    """
    more, before = (run >> 8) & 255, run & 255
    rows = len(parts)
    group = buckets.astype(">u8").view(np.uint8).reshape(rows, 8)
    after = np.zeros((rows, SPAN), np.uint8)
    behind = np.zeros((rows, REACH), np.uint8)
    for i, (part, d) in enumerate(zip(parts, before.tolist(), strict=True)):
        x = np.frombuffer(part, np.uint8)
        right = x[d : d + SPAN]
        after[i, : len(right)] = right
        behind[i, :d] = x[:d][::-1]

    def ranked(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the rows by bucket and bytes, and how many bytes each has in common with the row before (-1: none)."""
        order = np.argsort(np.hstack([group, side]).view(f"S{8 + side.shape[1]}").ravel(), kind="stable")
        unlike = side[order][1:] != side[order][:-1]
        common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), side.shape[1])
        common[buckets[order][1:] != buckets[order][:-1]] = -1
        return order, np.append(-1, common)

    by_right, common_right = ranked(after)
    by_left, common_left = ranked(behind)
    repeated = np.zeros((rows, REACH), bool)
    tie_right, tie_left = np.empty(rows, np.int64), np.empty(rows, np.int64)
    for d in range(REACH):
        here = np.flatnonzero((before >= d) & (before - more <= d))
        if len(here) < 2:
            continue
        tie_right[by_right] = np.cumsum(common_right < SPAN - d)
        tie_left[by_left] = np.cumsum(common_left < d)
        both = tie_left[here] * (rows + 1) + tie_right[here]
        _, place, count = np.unique(both, return_inverse=True, return_counts=True)
        repeated[here, d] = count[place] > 1
    return repeated


def _marks(repeated: np.ndarray, ids: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    """Stretches of repeated windows as (id, lo, hi)."""
    sample = (run >> 16) + (run & 255)
    flags = np.zeros((len(ids), REACH + 2), np.int8)
    flags[:, 1:-1] = repeated
    step = np.diff(flags, axis=1)
    row, near = np.nonzero(step == 1)
    _, far = np.nonzero(step == -1)
    cells = [pa.array(ids[row]), pa.array(sample[row] - far + 1), pa.array(sample[row] - near)]
    return pa.RecordBatch.from_arrays(cells, ["id", "lo", "hi"])


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the runs that come sorted by bucket; the last bucket seen waits for more of its rows."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        bucket, run = rows.column("bucket").to_numpy(), rows.column("run").to_numpy()
        found = repeated_windows(bucket, rows.column("part").to_pylist(), run)
        return _marks(found, rows.column("id").to_numpy(), run)

    wait: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            wait.append(batch.slice(at, ROWS))
            if sum(map(len, wait)) >= ROWS:
                rows = pa.Table.from_batches(wait)
                bucket = rows.column("bucket").to_numpy()
                cut = int(np.searchsorted(bucket, bucket[-1]))
                if cut:
                    yield done(rows.slice(0, cut))
                    wait = rows.slice(cut).combine_chunks().to_batches()
    if wait:
        yield done(pa.Table.from_batches(wait))


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            bucket, ids, runs_, alone, crowded, bytes_ = [], [], [], [], [], []
            for name, text, asked in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for a in asked:
                    low, more = a["run"] >> 16, (a["run"] >> 8) & 255
                    bucket.append(a["bucket"])
                    ids.append(name)
                    runs_.append(a["run"])
                    alone.append(a["alone"])
                    crowded.append(a["crowded"])
                    bytes_.append(text[low : low + more + SPAN])
            cells = [pa.array(bucket, pa.int64()), pa.array(ids, pa.int64()), pa.array(runs_, pa.int64())]
            cells += [pa.array(alone, pa.bool_()), pa.array(crowded, pa.bool_()), pa.array(bytes_, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["bucket", "id", "run", "alone", "crowded", "part"])


def _cells(run: int) -> Iterator[tuple[int, int, int]]:
    """The windows of a run in cells of ``CELL`` distances: number of the cell, least and largest distance."""
    most = run & 255
    least = most - ((run >> 8) & 255)
    for j in range(least // CELL, most // CELL + 1):
        yield j, max(least, j * CELL), min(most, j * CELL + CELL - 1)


def _list_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of runs, with hashes of their bytes and of the core, the bytes that all windows of a full cell share."""
    for batch in batches:
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            rows, core, code = [], [], []
            for b, i, run, x in zip(*(c.to_pylist() for c in part.columns), strict=True):
                sample, low = run & 255, run >> 16
                for j, d0, d1 in _cells(run):
                    inner = x[sample - j * CELL : sample + SPAN - j * CELL - CELL + 1]
                    core.append(xxhash.xxh3_64_intdigest(inner, seed=j))
                    code.append(xxhash.xxh3_64_intdigest(x[sample - d1 : sample - d0 + SPAN], seed=d0 * 256 + d1))
                    rows.append((b, i, run, j, low + sample - d1, low + sample - d0))
            cells = [pa.array([r[c] for r in rows], pa.int64()) for c in range(6)]
            cells += [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (core, code)]
            yield pa.RecordBatch.from_arrays(cells, ["bucket", "id", "run", "cell", "lo", "hi", "core", "code"])


def _list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the cells asked for, by hash."""
    for batch in batches:
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            bucket, name, low, code = [], [], [], []
            for b, i, run, x, asked in zip(*(c.to_pylist() for c in part.columns), strict=True):
                sample = run & 255
                for j, d0, d1 in _cells(run):
                    for d in range(d0, d1 + 1) if j in asked else ():
                        bucket.append(b)
                        name.append(i)
                        low.append((run >> 16) + sample - d)
                        code.append(xxhash.xxh3_64_intdigest(x[sample - d : sample - d + SPAN]))
            code = np.array(code, np.uint64).view(np.int64)
            cells = [pa.array(bucket, pa.int64()), pa.array(code), pa.array(name, pa.int64()), pa.array(low, pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, ["bucket", "code", "id", "lo"])


def _crowded(parts: DataFrame) -> DataFrame:
    """Marks of the runs of crowded buckets (``bucket, id, run, part``), which no task needs to hold.

    Cells of equal bytes are repeated as a whole. Cells whose core is met once hold nothing
    repeated. Of the others, at the edges of what is repeated, each window is counted.
    """
    cells = "bucket long, id long, run long, cell long, lo long, hi long, core long, code long"
    cells = stage(parts.mapInArrow(_list_cells, cells), "repeat-cells")
    same = cells.groupBy("bucket", "core", "code").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "run", "cell")).alias("one")
    )
    same = stage(same, "repeat-same")
    whole = same.filter("n > 1").select("bucket", "core", "code")
    marks = cells.join(whole, ["bucket", "core", "code"]).select("id", "lo", "hi")
    cores = same.groupBy("bucket", "core").agg(F.count("*").alias("codes"), F.min("n").alias("least"))
    cores = stage(cores.filter("codes > 1 and least = 1").select("bucket", "core"), "repeat-cores")
    asked = same.join(cores, ["bucket", "core"]).select("bucket", "one.*")
    asked = asked.groupBy("bucket", "id", "run").agg(F.collect_list("cell").alias("asked"))
    windows = parts.join(asked, ["bucket", "id", "run"]).select("bucket", "id", "run", "part", "asked")
    windows = stage(windows.mapInArrow(_list_windows, "bucket long, code long, id long, lo long"), "repeat-windows")
    twice = windows.groupBy("bucket", "code").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", "code")
    many = windows.join(twice, ["bucket", "code"]).select("id", "lo", F.col("lo").alias("hi"))
    return marks.union(many)


def repeats(rows: DataFrame) -> DataFrame:
    """``id, lo, hi`` for ``rows`` (``id`` long, ``text`` binary): all windows that start from ``lo`` to ``hi`` are repeated.

    Rows of one id have equal texts.
    """
    listed = stage(rows.mapInArrow(_list_runs, "bucket long, content long, id long, run long"), "repeat-runs")
    often = listed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    often = stage(often, "repeat-often")  # a table of its own, so that the join can split a bucket that many rows have
    listed = stage(listed.join(often, "bucket"), "repeat-buckets")
    distinct = listed.groupBy("bucket", "content").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "run")).alias("one")
    )
    distinct = stage(distinct, "repeat-contents")
    whole = listed.join(distinct.filter("n > 1").select("bucket", "content"), ["bucket", "content"]).withColumns(_unpacked())
    marks = whole.select("id", "lo", (F.col("lo") + F.col("more")).alias("hi"))
    several = distinct.groupBy("bucket").agg(F.count("*").alias("contents"), F.min("n").alias("least"))
    several = several.filter("contents > 1 and least = 1").select("bucket", (F.col("contents") > CROWD).alias("crowded"))
    asked = distinct.join(several, "bucket").select(
        "one.id", F.struct("bucket", "one.run", (F.col("n") == 1).alias("alone"), "crowded").alias("ask")
    )
    asked = asked.groupBy("id").agg(F.collect_list("ask").alias("asked"))
    parts = rows.join(asked, "id").select("id", "text", "asked").mapInArrow(
        _cut_runs, "bucket long, id long, run long, alone boolean, crowded boolean, part binary"
    )
    parts = stage(parts, "repeat-parts")
    few = parts.filter("not crowded").select("bucket", "id", "run", "part")
    few = few.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets, "id long, lo long, hi long")
    crowded = parts.filter("crowded").select("bucket", "id", "run", "part")
    marks = marks.union(few)
    return marks if crowded.isEmpty() else marks.union(_crowded(crowded))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", bytes_left: bool = False) -> DataFrame:
    """``key`` with the counts of removed bytes for each row; with ``bytes_left`` also the bytes that are kept.

    Null counts as empty; texts under ``SPAN`` bytes lose nothing. Where keys are null or
    repeated, rows are told apart by their texts: equal rows get equal results, each
    being a copy of the other.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keys = docs.groupBy(key).agg(F.count("*").alias("n"))
    odd = not keys.filter(f"n > 1 or {key} is null").isEmpty()
    row_id = F.xxhash64(F.col(key), body) if odd else F.col(key).cast("long")
    rows = docs.select(F.col(key).alias("__key"), row_id.alias("id"), body.alias("text"))
    texts = rows.select("id", "text")
    marks = repeats(texts).groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    more = ", kept binary" if bytes_left else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out = []
                for data, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    step = np.zeros(len(data) + 1, np.int32)
                    if found:
                        np.add.at(step, [m["lo"] for m in found], 1)
                        np.add.at(step, [m["hi"] + SPAN for m in found], -1)
                    gone = np.cumsum(step[:-1]) > 0
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if found else data
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                cells = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)]
                cells.append(pa.array([o[3] for o in out], pa.string()))
                names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if bytes_left:
                    cells.append(pa.array([o[4] for o in out], pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays([part.column(0), *cells], names)

    kind = docs.schema[key].dataType.simpleString()
    return rows.join(marks, "id", "left").select("__key", "text", "marks").mapInArrow(run, f"`{key}` {kind}, {RESULT}{more}")
