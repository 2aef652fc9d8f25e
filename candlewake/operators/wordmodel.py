"""A learned text scorer as tables: hashed words with negation, weights fitted by sums.

A logistic model on the presence of words, each document's scaled to length one. A round takes
every weight as far as a bound on its curvature allows, so the penalised loss never rises and no
step size has to be chosen. Weights are at most ``SLOTS`` rows whatever the texts, so a round
sends them to every task and brings back one sum for each slot; documents stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewake.functions.text import is_blank, label_distribution, with_polarity
from candlewake.operators.sentiment import lexicon_label
from candlewake.session import scratch, stage

SLOTS = 1 << 18
#: Words a negation reaches ahead.
REACH = 3
NEGATIONS = ["cannot", "neither", "never", "no", "none", "nor", "not", "without"]
ROUNDS, LEAST_DOCS, PENALTY = 15, 10, 3.0


def marked_words(text: Column) -> Column:
    """Lower-case words in order; those at most ``REACH`` behind a negation carry a mark."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda w: w != "")
    listed = F.array(*[F.lit(w) for w in NEGATIONS])

    def mark(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            before = F.slice(ws, F.greatest(i - REACH + 1, F.lit(1)), F.least(i, F.lit(REACH)))
            return F.when(F.arrays_overlap(before, listed), F.concat(F.lit("not_"), w)).otherwise(w)

        return F.transform(ws, one)

    return F.transform(F.array(words), mark)[0]


def _slots(text: str) -> Column:
    """The distinct slots that the words of a text fall in."""

    def slot(w: Column) -> Column:
        digest = F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long")
        return (digest % SLOTS).cast("int")

    return F.array_distinct(F.transform(F.array_distinct(marked_words(F.col(text))), slot))


def _united(slots: str) -> Column:
    return F.array_distinct(F.flatten(F.collect_set(slots)))


def slots(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, slots``: every slot that a document's words fall in, once. Rows of one key are one document."""
    return docs.select(key, _slots(text).alias("slots")).groupBy(key).agg(_united("slots").alias("slots"))


def _pull(rows: DataFrame, weights: np.ndarray, live: np.ndarray, heights: tuple[float, float]) -> np.ndarray:
    """The gradient of the fit by slot: each task sums its documents, then the tasks are summed."""
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            at = batch.column("slots").flatten().to_numpy()
            owner = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("slots")).to_numpy(zero_copy_only=False))
            at, owner = at[live[at]], owner[live[at]]
            y, times = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_times"))
            length = np.sqrt(times * np.bincount(owner, minlength=len(batch)))
            length[length == 0] = 1.0
            margin = times * np.bincount(owner, weights=weights[at], minlength=len(batch)) / length
            miss = np.where(y == 1, heights[1], heights[0]) * (y - 1 / (1 + np.exp(-margin))) / length
            out += np.bincount(at, weights=(times * miss)[owner], minlength=size)
        found = np.flatnonzero(out).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(out[found])], ["slot", "g"])

    parts = rows.select("_y", "_times", "slots").mapInArrow(run, "slot int, g double")
    summed = parts.groupBy("slot").agg(F.sum("g").alias("g")).toArrow()  # at most SLOTS rows
    out = np.zeros(size)
    out[summed.column("slot").to_numpy()] = summed.column("g").to_numpy()
    return out


def fit(
    docs: DataFrame, key: str, text: str = "text", label: str = "positive", rounds: int = ROUNDS,
    least: int = LEAST_DOCS, penalty: float = PENALTY,
) -> DataFrame:
    """``slot, weight`` after ``rounds`` over all labelled documents, each of its own ``key``.

    ``label`` is a boolean; rows without one are left out. Both classes weigh the same in all.
    Slots in fewer than ``least`` documents have no weight. Without labels the table is empty.
    The driver holds the weights, at most ``SLOTS`` numbers.
    """
    spark = docs.sparkSession
    with scratch(spark):
        known = docs.where(F.col(label).isNotNull()).select(key, text, F.col(label).cast("int").alias("_y"))
        n, ones = known.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
        heights = (n / 2 / max(1, n - ones), n / 2 / max(1, ones))
        # Rows without a key count as one document in all and are not fitted; they are dealt here.
        part = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(text), F.lit(1024)))
        dealt = known.select(key, part.alias("_part"), "_y", _slots(text).alias("slots"))
        merged = dealt.groupBy(key, "_part").agg(
            _united("slots").alias("slots"), F.count("*").alias("_times"), F.sum("_y").alias("_ones"), F.first("_y").alias("_y")
        )
        every = stage(merged.where(F.size("slots") > 0), "word-slots")
        height = F.col("_ones") * heights[1] + (F.col("_times") - F.col("_ones")) * heights[0]
        held = every.select(key, height.alias("_c"), F.explode("slots").alias("slot")).groupBy("slot").agg(
            (F.count(key) + F.max(F.col(key).isNull().cast("int"))).alias("_docs"),
            (F.sum(F.when(F.col(key).isNotNull(), F.col("_c"))) / 4 + penalty).alias("_curve"),
        )
        kept = held.where((F.col("_docs") >= least) & F.col("_curve").isNotNull()).toArrow()  # at most SLOTS rows
        live, curve, weights = np.zeros(SLOTS, bool), np.ones(SLOTS), np.zeros(SLOTS)
        at = kept.column("slot").to_numpy().astype(np.int64)
        live[at], curve[at] = True, kept.column("_curve").to_numpy()
        rows = every.where(F.col(key).isNotNull())
        for _ in range(rounds if len(at) else 0):
            weights += np.where(live, (_pull(rows, weights, live, heights) - penalty * weights) / curve, 0.0)
        table = pa.table({"slot": pa.array(at.astype(np.int32)), "weight": pa.array(weights[at])})
        return stage(spark.createDataFrame(table), "word-weights", keep=True)


def chances(docs: DataFrame, weights: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, chance`` that a document is positive, of documents with a known word and a key.

    ``weights`` has at most ``SLOTS`` rows, so the words need no exchange to meet them.
    """
    words = slots(docs.where(F.col(key).isNotNull()), key, text).select(key, F.explode("slots").alias("slot"))
    hits = words.join(F.broadcast(weights), "slot")
    return hits.groupBy(key).agg((1 / (1 + F.exp(-F.sum("weight") / F.sqrt(F.count("*"))))).alias("chance"))


def learned_sentiment(docs: DataFrame, weights: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Positive, negative, neutral and polarity of every document, as the word list gives them.

    The word list decides where no word is known or the key is null. Blank texts are neutral.
    """
    found = chances(docs, weights, key, text).withColumnRenamed(key, "_key")
    # The text is read before the join, which a caller's choice of columns then keeps free of it.
    read = lexicon_label(docs, text).withColumn("_blank", is_blank(F.col(text)))
    listed = read.join(found, read[key] == found["_key"], "left")
    p = F.col("chance")
    label = F.when(p > 0.5, "positive").when(p <= 0.5, "negative").otherwise(F.col("label"))
    score = F.when(p.isNotNull(), F.greatest(p, 1 - p)).otherwise(F.col("score"))
    parts = label_distribution(label, score, F.col("_blank"))
    return with_polarity(listed.withColumns(parts)).drop("label", "score", "_key", "_blank", "chance")
