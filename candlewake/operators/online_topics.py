"""Topic model by online variational inference: each round takes all documents, each until it is at rest.

The settings are those of Spark's online LDA: weights from a gamma law, steps of ``(1024 + round) ** -0.51``,
a prior of the shares that is learned too, and a document is at rest when a step changes its gammas by
``REST`` on average or less. Documents stay in their partitions; a round sends out the weights of the
vocabulary, which the driver holds, and brings back one sum a word. Within a task documents of about
one length take their steps together, and a step leaps ahead where steps go the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewake.session import scratch, stage

#: Delay and power of the steps of the weights, and the shape of the law of the first weights.
DELAY, POWER, SHAPE = 1024, 0.51, 100.0
#: Mean change of a document's gammas in a step from which on it is at rest.
REST = 1e-3
#: Counts that take their steps together; the longest documents are alone. Cycles with leaps.
CELLS, LEAPS = 1 << 14, 100

AT, N, WORD = "_at", "_n", "_word"


@dataclass(frozen=True)
class TopicModel:
    """The vocabulary, its weights (words by topics), and the prior of the topic shares."""

    words: list[str]
    weights: np.ndarray
    prior: np.ndarray


def digamma(x: np.ndarray) -> np.ndarray:
    """To 3e-9 for x > 0: six recurrences, then the asymptotic series."""
    y = x + 6
    out = np.log(y) - 0.5 / y - (1 / 12 - (1 / 120 - 1 / (252 * y * y)) / (y * y)) / (y * y)
    for i in range(6):
        out -= 1 / (x + i)
    return out


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 12
    out = 1 / y + 0.5 / y**2 + (1 / 6 - (1 / 30 - 1 / (42 * y * y)) / (y * y)) / y**3
    for i in range(12):
        out = out + 1 / (x + i) ** 2
    return out


def _logs(g: np.ndarray) -> np.ndarray:
    """The expected log shares of gammas, by row."""
    return digamma(g) - digamma(g.sum(-1, keepdims=True))


def _parts(cells: np.ndarray, counts: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the expected log shares (d, k), and the counts over their chances (d, l)."""
    e = np.exp(_logs(g))
    return e, counts / (np.matmul(cells, e[:, :, None])[:, :, 0] + 1e-100)


def _step(cells: np.ndarray, counts: np.ndarray, g: np.ndarray, prior: np.ndarray) -> np.ndarray:
    e, share = _parts(cells, counts, g)
    return e * np.matmul(share[:, None, :], cells)[:, 0, :] + prior


def at_rest(cells: np.ndarray, counts: np.ndarray, prior: np.ndarray, rest: float = REST) -> np.ndarray:
    """Gammas (d, k) of documents with word chances (d, l, k) and counts (d, l), from equal shares.

    Two plain steps tell the way and how it slows down; a leap goes on from there, farther with each cycle.
    After ``LEAPS`` cycles there are plain steps only, which always come to rest.
    """
    g = prior + counts.sum(1, keepdims=True) / len(prior)
    out, live, moving, cycle = g.copy(), np.arange(len(g)), np.ones(len(g), bool), 0
    while len(live):
        one = _step(cells, counts, g, prior)
        two = _step(cells, counts, one, prior)
        way, bend = one - g, two - 2 * one + g
        leap = np.sqrt((way**2).sum(1, keepdims=True) / np.maximum((bend**2).sum(1, keepdims=True), 1e-300))
        leap = np.clip(leap, 1.0, 4.0 ** (cycle + 1) if cycle < LEAPS else 1.0)
        ahead = np.maximum(g + 2 * leap * way + leap**2 * bend, prior)
        g = np.where(leap > 1, ahead, two)
        out[live[moving]] = two[moving]
        moving &= np.abs(two - one).mean(1) > rest
        if 4 * moving.sum() <= 3 * len(moving):
            live, g, cells, counts = live[moving], g[moving], cells[moving], counts[moving]
            moving = np.ones(len(live), bool)
        cycle += 1
    return out


def _together(lens: np.ndarray) -> Iterator[np.ndarray]:
    """Documents with words, by length, so many that their longest times their number is about ``CELLS``."""
    order = np.argsort(lens, kind="stable")
    order = order[lens[order] > 0]
    at = 0
    while at < len(order):
        size = lens[order[at:]] * np.arange(1, len(order) - at + 1)
        to = at + max(1, int(np.searchsorted(size, CELLS, "right")))
        yield order[at:to]
        at = to


def infer(
    at: np.ndarray, n: np.ndarray, lens: np.ndarray, chances: np.ndarray, prior: np.ndarray,
    found: np.ndarray | None = None,
) -> np.ndarray:
    """Gammas of documents, whose word numbers and counts are neighbours; the prior where there is no word.

    The expected counts over the chances are added to ``found``.
    """
    gammas, begins = np.tile(prior, (len(lens), 1)), np.cumsum(lens) - lens
    shares, raised = np.zeros(len(at)), np.ones_like(gammas)
    for rows in _together(lens):
        real = np.arange(lens[rows].max()) < lens[rows][:, None]
        source = (begins[rows][:, None] + np.arange(real.shape[1]))[real]
        place, counts = np.zeros(real.shape, np.int64), np.zeros(real.shape)
        place[real], counts[real] = at[source], n[source]
        cells = chances.take(place, 0)
        gammas[rows] = at_rest(cells, counts, prior)
        if found is not None:
            raised[rows], share = _parts(cells, counts, gammas[rows])
            shares[source] = share[real]
    if found is not None:
        owner = np.repeat(np.arange(len(lens)), lens)
        for k in range(len(prior)):
            found[:, k] += np.bincount(at, shares * raised[:, k].take(owner), len(found))
    return gammas


def vocabulary(docs: DataFrame, tokens: str, words: int, least: float, share: float) -> list[str]:
    """The ``words`` most frequent words that are in ``least`` documents or more and in the ``share`` of all or fewer."""
    every = docs.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    held = docs.select(F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    kept = held.where((F.col("docs") >= least) & (F.col("docs") <= share * docs.count())).join(every, "word")
    return [r["word"] for r in kept.orderBy(F.desc("n"), "word").limit(words).select("word").collect()]


def _count(texts: pa.Array, words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Numbers of the known words of each text, and how often the text has them."""
    lens = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = texts.flatten().dictionary_encode()
    known = pc.fill_null(pc.index_in(flat.dictionary, value_set=words), -1).to_numpy(zero_copy_only=False)
    codes = pc.fill_null(flat.indices, len(known)).to_numpy(zero_copy_only=False)
    place = np.append(known, -1).astype(np.int64)[codes]
    owner, size = np.repeat(np.arange(len(lens)), lens), max(len(words), 1)
    cells, n = np.unique((owner * size + place)[place >= 0], return_counts=True)
    owner, place = np.divmod(cells, size)
    cuts = pa.py_buffer((4 * np.searchsorted(owner, np.arange(len(lens) + 1))).astype(np.int32))
    return tuple(
        pa.Array.from_buffers(pa.binary(), len(lens), [None, cuts, pa.py_buffer(x.astype(np.int32))]) for x in (place, n)
    )


def counted(docs: DataFrame, words: list[str], keys: list[str], tokens: str) -> DataFrame:
    """``keys, _at, _n`` of every row: numbers and counts of its known words, 4 bytes each."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            kept = {k: batch.column(k) for k in keys}
            at, n = _count(batch.column(tokens), known)
            yield pa.RecordBatch.from_pydict({**kept, AT: at, N: n})

    packed = [T.StructField(c, T.BinaryType()) for c in (AT, N)]
    schema = T.StructType([*[docs.schema[k] for k in keys], *packed])
    return docs.select(*keys, tokens).mapInArrow(run, schema)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, n = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32) for c in (AT, N))
    return at, n, pc.binary_length(batch.column(AT)).to_numpy(zero_copy_only=False).astype(np.int64) // 4


def _summed(counts: DataFrame, chances: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Expected counts over the chances, log shares of all documents with words, and the number of these."""
    topics = len(prior)
    every = range(topics)
    sent = counts.sparkSession.sparkContext.broadcast((chances, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chances, prior = sent.value
        found, logs, docs = np.zeros_like(chances), np.zeros(topics), 0
        for batch in batches:
            at, n, lens = _lists(batch)
            gammas = infer(at, n, lens, chances, prior, found)[lens > 0]
            logs, docs = logs + _logs(gammas).sum(0), docs + len(gammas)
        seen = np.flatnonzero(found.any(1))
        # The last row has the sums over documents.
        cells = np.vstack([found[seen], logs])
        place = pa.array(np.append(seen, len(found)), pa.int32())
        size = pa.array(np.append(np.zeros(len(seen), np.int64), docs))
        yield pa.RecordBatch.from_arrays([place, size, *[pa.array(cells[:, k]) for k in every]], [WORD, N, *[f"g{k}" for k in every]])

    parts = counts.select(AT, N).mapInArrow(run, f"{WORD} int, {N} long, " + ", ".join(f"g{k} double" for k in every))
    sums = parts.groupBy(WORD).agg(F.sum(N).alias(N), *[F.sum(f"g{k}").alias(f"g{k}") for k in every]).toArrow()
    sent.unpersist()
    out = np.zeros((len(chances) + 1, topics))
    place = sums.column(WORD).to_numpy()
    for k in every:
        out[place, k] = sums.column(f"g{k}").to_numpy()
    return out[:-1], out[-1], int(pc.sum(sums.column(N)).as_py() or 0)


def chances(weights: np.ndarray) -> np.ndarray:
    """The exponentials of the expected log chances of the words in each topic."""
    return np.exp(digamma(weights) - digamma(weights.sum(0))) if len(weights) else weights


def next_prior(prior: np.ndarray, logs: np.ndarray, docs: int, rate: float) -> np.ndarray:
    """A Newton step of the prior to the mean log shares of the documents; as before if it would leave zero behind."""
    slope = docs * (logs / docs - _logs(prior))
    q = -docs * trigamma(prior)
    b = (slope / q).sum() / (1 / (docs * trigamma(prior.sum())) + (1 / q).sum())
    new = prior - rate * (slope - b) / q
    return new if (new > 0).all() else prior


def fit(
    docs: DataFrame, tokens: str, topics: int, rounds: int, words: int, least: float, share: float, seed: int,
    watch: Callable[[np.ndarray, np.ndarray], None] | None = None,
) -> TopicModel:
    """The model after ``rounds`` over all ``docs``; null arrays have no words. ``watch`` sees each round's weights and prior."""
    with scratch(docs.sparkSession):
        known = vocabulary(docs, tokens, words, least, share)
        weights = np.random.default_rng(seed).gamma(SHAPE, 1 / SHAPE, (len(known), topics))
        prior = np.full(topics, 1 / topics)
        counts = stage(counted(docs, known, [], tokens), "topic-counts")
        for i in range(1, rounds + 1):
            now = chances(weights)
            found, logs, n = _summed(counts, now, prior)
            if not n:
                break
            rate = (DELAY + i) ** -POWER
            weights = (1 - rate) * weights + rate * (found * now + 1 / topics)
            prior = next_prior(prior, logs, n, rate)
            if watch:
                watch(weights, prior)
    return TopicModel(known, weights, prior)


def distribution(model: TopicModel, docs: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """``keys, topics``: the share of each topic in every row, zeros where it has no known word."""
    sent = docs.sparkSession.sparkContext.broadcast((chances(model.weights), model.prior))
    topics = len(model.prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prior = sent.value
        for batch in batches:
            at, n, lens = _lists(batch)
            shares = infer(at, n, lens, now, prior)
            shares = np.where(lens[:, None] > 0, shares / shares.sum(1, keepdims=True), 0.0)
            cuts = pa.array(np.arange(len(lens) + 1) * topics, pa.int32())
            kept = {k: batch.column(k) for k in keys}
            yield pa.RecordBatch.from_pydict({**kept, "topics": pa.ListArray.from_arrays(cuts, pa.array(shares.ravel()))})

    counts = counted(docs, model.words, keys, tokens)
    schema = T.StructType([*[docs.schema[k] for k in keys], T.StructField("topics", T.ArrayType(T.DoubleType()))])
    return counts.mapInArrow(run, schema)
