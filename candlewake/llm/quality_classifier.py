"""Naive Bayes support vectors for text quality.

Word n-grams are indicators in a hashed space. Their class log-count ratios, counted
over all labelled training rows, scale the indicators; a linear model of squared-hinge
loss is fitted by dual coordinate descent on a bounded sample of these rows, and its
margins are turned into chances by a logistic curve on the same sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewake.llm.common import crc_bucket, sized

#: Hashed features. Words, word pairs, and the last characters and shape of words share the space.
SPACE = 1 << 18
#: Labelled rows of each class that the linear model is fitted on, at most; drawn by hash of the key.
SAMPLE = 4_000
SMOOTH = 1.0
PENALTY = 1.0
ROUNDS = 12
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

_CLASS_OF = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
    for b in range(256)
)


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text: words, pairs, and words' endings by kind of character."""
    raw = (text or b"").split()
    if not raw:
        return np.empty(0, np.int64)
    seen: dict[bytes, tuple[int, int]] = {}
    pairs = []
    for w in raw:
        if (got := seen.get(w)) is None:
            kind = w.translate(_CLASS_OF)
            got = seen[w] = (zlib.crc32(w.lower()), zlib.crc32(kind[:2] + b"~" + kind[-4:]))
        pairs.append(got)
    codes = np.array(pairs, np.uint64)
    mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
    word, shape = codes[:, 0], codes[:, 1]
    found = [mix(word + np.uint64(1)), mix(shape + np.uint64(1 << 33))]
    for x, salt in ((word, 3 << 33), (shape, 7 << 33)):
        found.append(mix(x[:-1] * np.uint64(31) + x[1:] + np.uint64(salt)))
    return np.unique(np.concatenate(found)).astype(np.int64)


def ratios(labelled: DataFrame) -> np.ndarray:
    """Class log-count ratios of all features over ``labelled`` (``text``, ``label``); tasks send sums of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SPACE), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[label, features(text)] += 1
        label, feature = np.nonzero(sums)
        n = sums[label, feature]
        for at in range(0, len(n), 65536):
            part = slice(at, at + 65536)
            cells = [pa.array(label[part] * SPACE + feature[part]), pa.array(n[part])]
            yield pa.RecordBatch.from_arrays(cells, ["at", "n"])

    counts = np.full(2 * SPACE, SMOOTH)
    sums = labelled.select(F.col("text").cast("binary"), "label").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # at most two numbers a feature
    counts[got.column("at").to_numpy()] += got.column("n").to_numpy()
    bad, good = counts.reshape(2, SPACE)
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def descend(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights over features and a bias: L2-regularised squared hinge loss by dual coordinate descent.

    Rows are scaled to length one, with the bias as one more feature. Classes weigh the same in all.
    """
    rng = np.random.default_rng(3)
    weights, bias = np.zeros(SPACE), 0.0
    values = [(scale[r] / max(np.sqrt((scale[r] ** 2).sum()), 1e-12)).astype(np.float32) for r in rows]
    sign = np.where(labels > 0, 1.0, -1.0)
    share = np.where(labels > 0, (labels > 0).mean(), (labels <= 0).mean())
    ridge = 1 / (2 * PENALTY * 0.5 / np.maximum(share, 1e-9))
    norm = np.array([(v * v).sum() for v in values]) + 1.0 + ridge
    alpha = np.zeros(len(rows))
    for _ in range(ROUNDS):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = sign[i] * (weights[r] @ v + bias) - 1 + ridge[i] * alpha[i]
            new = max(alpha[i] - gradient / norm[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[r] += step * v
                bias += step
                alpha[i] = new
    return weights, bias


def margin(found: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float) -> float:
    v = scale[found]
    return float(weights[found] @ v / max(np.sqrt(v @ v), 1e-12) + bias)


def curve(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the chance of label 1 by Newton steps; ``weight`` undoes the sampling of classes."""
    x, y = np.column_stack([margins, np.ones(len(margins))]), (labels > 0).astype(float)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-2 * theta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(theta[0]), float(theta[1])


def fit(rows: DataFrame, known: DataFrame, sample: int = SAMPLE):
    """A function from a text to the chance of label 1, from ``rows`` (``key, text``) and ``known`` (``key, label``).

    Without labels of both classes there is nothing to learn, and all chances are the share of label 1.
    """
    known = sized(known, "quality-labels")
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        only = float(next(iter(counts), 0.5))
        return lambda text: only
    scale = ratios(rows.join(known, "key"))
    # The first labels of each class in hash order, drawn from parts, so that no task ranks a whole class.
    order = Window.partitionBy("label", "part").orderBy(F.xxhash64("key"), "key")
    drawn = known.withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(64)))
    drawn = drawn.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= -(-sample // 64))
    drawn = rows.join(sized(drawn.select("key", "label"), "quality-sample"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).astype(np.int32).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["found", "label"])

    got = drawn.select(F.col("text").cast("binary"), "label").mapInArrow(run, "found binary, label int").toArrow()
    found = [np.frombuffer(b, np.int32) for b in got.column("found").to_pylist()]
    labels = got.column("label").to_numpy()
    if len(set(labels.tolist())) < 2:
        share = counts[1] / (counts[0] + counts[1])
        return lambda text: share
    weights, bias = descend(found, labels, scale)
    margins = np.array([margin(r, scale, weights, bias) for r in found])
    drawn_n = np.array([(labels == c).sum() for c in (0, 1)])
    weight = np.array([counts[0], counts[1]])[labels] / drawn_n[labels]
    slope, offset = curve(margins, labels, weight * len(labels) / weight.sum())
    scale, weights = scale.astype(np.float32), weights.astype(np.float32)

    def chance(text: bytes | None) -> float:
        x = slope * margin(features(text), scale, weights, bias) + offset
        return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))

    return chance


def chances(text: Column, model) -> Column:
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model(t) for t in texts.to_pylist()], pa.float64())

    return run(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``id, held_out, score, predicted`` for each row of ``docs``; null texts count as empty.

    Labels of held-out keys are not read. Keys without a label, or with a null one, teach
    nothing; repeated rows and labels count each time. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = labels.filter(crc_bucket(key, FOLDS) != HELD_OUT).filter(F.col(label).isin(0, 1))
    known = known.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    model = fit(rows, known)
    held = crc_bucket("key", FOLDS) == HELD_OUT
    scored = rows.select(F.col("key").alias("id"), held.alias("held_out"), chances(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
