"""Ranked lexical search by presence masks.

Each document is cut into terms once; kept are its length and the counts of the terms that occur
in the items. Documents are then taken in blocks. For an item, the bitmaps of its terms over a
block, put side by side, give each document a mask of the terms it holds. Equal masks are one
group; the largest contribution that each term makes in the block bounds the score of a group.
Groups are scored in falling order of that bound, until it lies below the score that an item's
last place has in the task so far. The places of all tasks are ranked at the end.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are
lower-cased. A null text has none. Rows that repeat a document's key are documents of their own; a
document without a key ranks last among equal scores. Equal rows of items count once; items of one
key with unlike texts are ranked apart; an item without terms that occur has no places. Empty tables
give an empty result.

Items are searched in blocks of about ``ITEM_BYTES`` of text, each with a pass over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from candlewake.llm.common import lower_ascii
from candlewake.session import scratch, stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
#: Documents whose bitmaps are held at a time.
BLOCK = 1 << 14
#: Text of the items that are searched in one pass.
ITEM_BYTES = 4 << 20
#: Documents scored before the bound is looked at again; doubled each time.
FIRST = 64

#: Letters in lower case, digits and bytes beyond ASCII as they are, all others a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def counted_terms(docs: DataFrame, key: str, text: str, vocabulary: list[str]) -> DataFrame:
    """``id, n, terms, times``: a document's length and how often it holds terms of ``vocabulary``, by place there."""
    place = {t.encode(): i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                n, terms, times = [], [], []
                for cell in part.column(1):
                    words = (cell.as_py() or b"").translate(_FOLD).split()
                    seen = Counter(map(place.get, words))
                    seen.pop(None, None)
                    n.append(len(words))
                    terms.append(list(seen))
                    times.append(list(seen.values()))
                cells = [part.column(0), pa.array(n, pa.int64())]
                cells += [pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cells, ["id", "n", "terms", "times"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n long, terms array<int>, times array<int>")


def document_counts(hits: DataFrame, size: int) -> dict[int, int]:
    """How many documents hold each of the ``size`` terms that occur; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["term", "n"])

    parts = hits.select("terms").mapInArrow(run, "term int, n long")
    return {r.term: r.n for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def grouped(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of a matrix of bits (terms, documents), as rows, and which of them each document has."""
    words = np.packbits(present, axis=0)
    words = np.pad(words, ((0, -len(words) % 8), (0, 0))).T.copy().view(np.uint64)
    first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)[1:]
    for k in range(1, words.shape[1]):
        other = np.unique(words[:, k], return_inverse=True)[1]
        first, group = np.unique(group * (other.max() + 1) + other, return_index=True, return_inverse=True)[1:]
    return present[:, first].T, group


class Block:
    """The postings of some documents, by term."""

    def __init__(self, n: np.ndarray, docs: np.ndarray, terms: np.ndarray, times: np.ndarray, size: int, all_docs: int, all_terms: int):
        m = 75 + (25 * n * all_docs) // all_terms
        order = np.argsort(terms, kind="stable")
        self.docs, tf = docs[order], times[order].astype(np.int64)
        self.part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.docs])
        self.cut = np.searchsorted(terms[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        held = np.flatnonzero(self.cut[1:] > self.cut[:-1])
        if len(held):
            self.most[held] = np.maximum.reduceat(self.part, self.cut[held])
        self.size = len(n)

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for t, w in zip(terms, weights, strict=True):
            a, b = self.cut[t], self.cut[t + 1]
            at = np.minimum(np.searchsorted(self.docs[a:b], docs), b - a - 1)
            total += np.where(self.docs[a:b][at] == docs, w * self.part[a:b][at], 0)
        return total

    def best(self, terms: np.ndarray, weights: np.ndarray, least: int, places: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores among which are all that can take one of the places; ``least`` is the last place's score so far."""
        bound = weights * self.most[terms]
        terms, weights, bound = terms[bound > 0], weights[bound > 0], bound[bound > 0]
        none = np.empty(0, np.int64)
        if not len(terms) or bound.sum() < least:
            return none, none
        present = np.zeros((len(terms), self.size), bool)
        for row, t in zip(present, terms, strict=True):
            row[self.docs[self.cut[t] : self.cut[t + 1]]] = True
        some = np.flatnonzero(present.any(axis=0))
        masks, group = grouped(present[:, some])
        most = masks.astype(np.int64) @ bound
        falling = np.argsort(-most, kind="stable")
        rank = np.empty(len(falling), np.int64)
        rank[falling] = np.arange(len(falling))
        order = np.argsort(rank[group], kind="stable")
        bounds, some = most[group][order], some[order]
        found, scored, at, step = [none], [none], 0, FIRST
        while at < len(some) and bounds[at] >= least:
            part = some[at : at + step]
            found.append(part)
            scored.append(self.scores(part, terms, weights))
            every = np.concatenate(scored)
            if len(every) >= places:
                least = max(least, int(np.partition(every, -places)[-places]))
            at, step = at + step, step * 2
        docs, scores = np.concatenate(found), np.concatenate(scored)
        keep = (scores >= least) & (scores > 0)
        return docs[keep], scores[keep]


def _places(hits: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], size: int, all_docs: int, all_terms: int, places: int) -> DataFrame:
    """``item, id, score``: each task's best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple]] = [[] for _ in queries]

        def take(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts).combine_chunks()
            lists = rows.column("terms").combine_chunks()
            docs = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
            times = rows.column("times").combine_chunks().flatten().to_numpy()
            block = Block(rows.column("n").to_numpy(), docs, lists.flatten().to_numpy(), times, size, all_docs, all_terms)
            ids = rows.column("id")
            for i, (_, terms, weights) in enumerate(queries):
                least = -top[i][-1][0] if len(top[i]) == places else 0
                found, scores = block.best(terms, weights, least, places)
                if len(found):
                    new = [(-s, d is None, d) for s, d in zip(scores.tolist(), ids.take(pa.array(found)).to_pylist(), strict=True)]
                    top[i] = sorted(top[i] + new, key=lambda x: x[:2] if x[1] else x)[:places]

        held, waiting = [], 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                held.append(batch.slice(at, BLOCK))
                waiting += len(held[-1])
                if waiting >= BLOCK:
                    take(held)
                    held, waiting = [], 0
        if waiting:
            take(held)
        out = [(queries[i][0], d, -s) for i, rows in enumerate(top) for s, _, d in rows]
        cells = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), kind, pa.int64()))]
        yield pa.RecordBatch.from_arrays(cells, ["item", "id", "score"])

    of = hits.schema["id"].dataType
    kind = to_arrow_type(of)
    return hits.select("id", "n", "terms", "times").mapInArrow(run, f"item long, id {of.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", places: int = TOP) -> DataFrame:
    """``item_id, rank, id, score``: the ``places`` best documents of each item with a score above 0."""
    with scratch(docs.sparkSession):
        return stage(_search(docs, items, key, text, item, item_text, places), "lexical-top", keep=True)


def _search(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, places: int) -> DataFrame:
    spark = docs.sparkSession
    terms = F.regexp_extract_all(lower_ascii(F.col("body")), F.lit(TERM), F.lit(0))
    asked = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("body")).distinct()
    asked = asked.select(F.monotonically_increasing_id().alias("item"), "item_id", terms.alias("terms"), F.octet_length(F.coalesce("body", F.lit(""))).alias("size"))
    asked = stage(asked, "lexical-items")
    passes = -(-(asked.agg(F.sum("size")).first()[0] or 0) // ITEM_BYTES)
    kind = docs.schema[key].dataType.simpleString()
    found = spark.createDataFrame([], f"item long, id {kind}, score long")
    for k in range(passes):
        block = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).select("item", "terms").collect()
        vocabulary = sorted({t for r in block for t in r.terms or ()})
        hits = stage(counted_terms(docs, key, text, vocabulary), "lexical-hits")
        all_docs, all_terms = hits.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = document_counts(hits, len(vocabulary))
        place = {t: i for i, t in enumerate(vocabulary)}
        queries = []
        for r in block:
            times = Counter(place[t] for t in r.terms or () if place[t] in holding)
            own = np.array(sorted(times), np.int64)
            weights = [times[t] * math.floor(1000 * math.log((2 * all_docs + 2) / (2 * holding[t] + 1))) for t in own]
            if times:
                queries.append((r.item, own, np.array(weights, np.int64)))
        if queries:
            found = found.union(stage(_places(hits, queries, len(vocabulary), all_docs, all_terms, places), "lexical-places"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= places)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "id", "score")
