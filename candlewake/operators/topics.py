"""Topic model as tables: counts, word weights and topic shares, fitted by joins and sums.

Latent Dirichlet allocation by variational expectation and maximisation over all documents.
The vocabulary, the weights and the counts are tables; the driver sees one sum for each topic.
Documents are dealt to groups, and each group numbers its own words. A round sends every group
the weights of its words once, however many of its documents hold them, takes a fixed number
of steps on the topic shares there, and sums the expected counts of the groups by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewake.operators.learning import FULL, TOPIC_MAX_SHARE, TOPIC_MIN_DOCS, TOPIC_SEED, TOPICS
from candlewake.session import scratch, stage

#: Steps on a document's shares in each round, from equal shares.
STEPS = 5
#: Least number of groups that the documents are dealt to: copies of a word's weights in a round.
COPIES = 16
#: Words of a group's documents, with repeats; a task holds one group. More words make more groups.
GROUP_WORDS = 1 << 23
#: Counts that take their steps together, and words whose documents (or counts whose sums) a task works out at a time.
CELLS, SLICE = 1 << 13, 1 << 20

PART, GROUP, AT, N, WORD, PLACE, DOCS, LOOSE = "_part", "_group", "_at", "_n", "_word", "_place", "_docs", "_loose"


def _dealt(key: str, tokens: str, groups: int) -> Column:
    """The group of a document; rows without a key count for the vocabulary only and go anywhere."""
    return F.pmod(F.when(F.col(key).isNull(), F.xxhash64(tokens)).otherwise(F.xxhash64(key)), F.lit(groups)).cast("int")


def _slices(codes: np.ndarray, lens: np.ndarray) -> Iterator[slice]:
    """Rows of about ``SLICE`` words; rows of one document, which are neighbours, stay together."""
    at = (np.cumsum(lens) - lens) // SLICE
    new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    cuts = new[np.append(True, at[new][1:] != at[new][:-1])]
    for a, b in zip(cuts, np.append(cuts[1:], len(codes)), strict=True):
        yield slice(int(a), int(b))


def _tallies(group: pa.Table, key: str, tokens: str, names: list[str]) -> pa.Table:
    """One group: a row for each document with a key, and a row for each word."""
    group = group.combine_chunks()
    coded = pc.dictionary_encode(group.column(key)).combine_chunks()
    codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(codes, kind="stable")
    codes, texts = codes[order], group.column(tokens).combine_chunks()
    if np.any(order[1:] < order[:-1]):
        texts = texts.take(pa.array(order))
    lens = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = texts.flatten().dictionary_encode()
    words, place = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
    size, docs, loose = len(words), np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
    ends, held, ats, ns, sizes = np.cumsum(lens), [], [], [], []
    for rows in _slices(codes, lens) if len(codes) else ():
        cells = place[ends[rows.start] - lens[rows.start] : ends[rows.stop - 1]]
        pairs, counts = np.unique(np.repeat(codes[rows], lens[rows]) * max(size, 1) + cells, return_counts=True)
        keyed = pairs >= 0
        loose[np.mod(pairs[~keyed], max(size, 1))] = 1
        owner, at = np.divmod(pairs[keyed], max(size, 1))
        docs += np.bincount(at, minlength=size).astype(np.int32)
        own, many = np.unique(owner, return_counts=True)
        held.append(own), sizes.append(many), ats.append(at.astype(np.int32)), ns.append(counts[keyed].astype(np.int32))
    own = np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64)
    cuts = pa.array(np.append(0, np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))), pa.int32())
    listed = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([*x, np.zeros(0, np.int32)]), pa.int32())) for x in (ats, ns)]
    part = group.column(PART)[0].as_py()
    keys = coded.dictionary.take(pa.array(own))
    ints = lambda x: pa.array(x, pa.int32())
    by_doc = {PART: ints(np.full(len(own), part)), key: keys, AT: listed[0], N: listed[1]}
    by_word = {PART: ints(np.full(size, part)), WORD: words, PLACE: ints(np.arange(size)), DOCS: ints(docs), LOOSE: ints(loose)}
    types = {**{n: c.type for n, c in by_doc.items()}, **{n: c.type for n, c in by_word.items()}}
    whole = [pa.table({n: t.get(n, pa.nulls(len(t[PART]), types[n])) for n in names}) for t in (by_doc, by_word)]
    return pa.concat_tables(whole)


def _tallied(docs: DataFrame, key: str, tokens: str, keep: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Documents ``_part, key, _at, _n``, words ``_part, _word, _place, _docs, _loose``, and the number of rows.

    ``_at`` has the places of a document's words in the list of its group. Rows of one key
    count as one document. Null arrays and null or empty words count as none.
    """
    words = F.filter(F.coalesce(F.col(tokens), F.array().cast("array<string>")), lambda w: w != "")
    rows = stage(docs.select(key, words.alias(tokens)), "topic-words")
    n, total = rows.agg(F.count("*"), F.sum(F.size(tokens))).first()
    groups = max(COPIES, -(-(total or 0) // GROUP_WORDS))
    ints = {c: T.IntegerType() for c in (PLACE, DOCS, LOOSE)}
    listed = T.ArrayType(T.IntegerType())
    kinds = {PART: T.IntegerType(), key: docs.schema[key].dataType, AT: listed, N: listed, WORD: T.StringType(), **ints}
    schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()])
    names = list(kinds)

    def run(group: pa.Table) -> pa.Table:
        return _tallies(group, key, tokens, names)

    dealt = rows.withColumn(PART, _dealt(key, tokens, groups))
    both = stage(dealt.groupBy(PART).applyInArrow(run, schema), "topic-counts", keep=keep)
    by_doc = both.where(F.col(AT).isNotNull()).select(PART, key, AT, N)
    by_word = both.where(F.col(WORD).isNotNull()).select(PART, WORD, PLACE, DOCS, LOOSE)
    return by_doc, by_word, n


def counted(docs: DataFrame, key: str, tokens: str = "tokens") -> tuple[DataFrame, DataFrame, int]:
    """The counts of ``docs`` for ``fit`` and ``shares``, which then read the texts once between them."""
    with scratch(docs.sparkSession):
        return _tallied(docs, key, tokens, keep=True)


def vocabulary(words: DataFrame, docs: int, least: float = TOPIC_MIN_DOCS, share: float = TOPIC_MAX_SHARE) -> DataFrame:
    """Words in at least ``least`` and at most the ``share`` of all documents, without a cap on their number."""
    # All rows without a key are one document.
    held = words.groupBy(F.col(WORD).alias("word")).agg((F.sum(DOCS) + F.max(LOOSE)).alias("docs"))
    return held.where((F.col("docs") >= least) & (F.col("docs") <= share * docs))


def _places(by_word: DataFrame, words: DataFrame) -> DataFrame:
    """``word, _group, _place`` of the vocabulary's words in every group that holds them."""
    held = by_word.where(F.col(DOCS) > 0).select(F.col(WORD).alias("word"), F.col(PART).alias(GROUP), PLACE)
    return held.join(words.select("word"), "word")


def first_weights(words: DataFrame, topics: int, seed: int = TOPIC_SEED) -> DataFrame:
    """Weights drawn from an exponential law by a digest of seed, topic and word, over the prior ``1 / topics``."""

    def drawn(k: int) -> Column:
        digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), F.col("word")).cast("binary")), 1, 12)
        share = (F.conv(digest, 16, 10).cast("double") + 0.5) / 2.0**48
        return (1.0 / topics - F.log(share)).alias(f"l{k}")

    return words.select("word", *[drawn(k) for k in range(topics)])


def _totals(weights: DataFrame, topics: int) -> np.ndarray:
    found = weights.selectExpr(*[f"sum(l{k})" for k in range(topics)]).first()  # one number for each topic
    return np.array([float(t or 1.0) for t in found])


def _raised(x: np.ndarray) -> np.ndarray:
    """The exponentials of the digammas of ``x > 0``, to 3e-9: six recurrences, then the asymptotic series."""
    y = x + 6
    out = np.log(y) - 0.5 / y - (1 / 12 - (1 / 120 - 1 / (252 * y * y)) / (y * y)) / (y * y)
    for i in range(6):
        out -= 1 / (x + i)
    return np.exp(out)


def _chances(words: pa.Table, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By place, the exponentials of the expected log chances of a group's words in each topic, and which words are known."""
    place = words.column(PLACE).to_numpy().astype(np.int64)
    size = int(place.max()) + 1 if len(place) else 0
    w, known = np.zeros((size, len(totals))), np.zeros(size + 1, bool)
    known[place] = True
    found = np.empty((len(place), len(totals)))
    for k in range(len(totals)):
        found[:, k] = words.column(f"l{k}").to_numpy()
    w[place] = _raised(found) / _raised(totals)
    return w, known


def _group_steps(docs: pa.Table, w: np.ndarray, known: np.ndarray, steps: int) -> Iterator[tuple]:
    """Rows with known words, their gammas, and the lengths, places, counts and chances of their words, some documents at a time.

    Rows count from the start of ``docs``.
    """
    shift = 0
    for batch in docs.select([AT, N]).to_batches():
        at, n = (batch.column(c).flatten().to_numpy() for c in (AT, N))
        many = pc.list_value_length(batch.column(AT)).to_numpy(zero_copy_only=False)
        for rows, *rest in _batch_steps(at, n, many, w, known, steps):
            yield rows + shift, *rest
        shift += len(batch)


def _blocks(lens: np.ndarray) -> Iterator[slice]:
    """Neighbours among ascending lengths that fill ``CELLS`` together; the longest are alone."""
    a = 0
    while a < len(lens):
        most = lens[min(a + max(1, CELLS // lens[a]), len(lens)) - 1]
        b = min(a + max(1, CELLS // most), len(lens))
        yield slice(a, b)
        a = b


def _batch_steps(
    at: np.ndarray, n: np.ndarray, many: np.ndarray, w: np.ndarray, known: np.ndarray, steps: int
) -> Iterator[tuple]:
    """Documents of about one length take their steps together, each row filled up with words that count zero times."""
    topics = w.shape[1]
    keep = known[np.minimum(at, len(known) - 1)]
    if not keep.any():
        return
    owner = np.repeat(np.arange(len(many)), many)[keep]
    at, n = at[keep].astype(np.int64), n[keep].astype(np.float64)
    lens = np.bincount(owner, minlength=len(many))
    rows = np.flatnonzero(lens)
    lens = lens[rows]
    starts = np.cumsum(lens) - lens
    order = np.argsort(lens, kind="stable")
    rows, starts, lens = rows[order], starts[order], lens[order]
    for some in _blocks(lens):
        span = np.arange(lens[some][-1])
        held = span < lens[some, None]
        cells = np.where(held, starts[some, None] + span, starts[some, None])
        place, count = at.take(cells), n.take(cells) * held
        mine = w.take(place, 0)
        g = np.repeat((1 / topics + count.sum(1) / topics)[:, None], topics, 1)
        for _ in range(steps):
            e = _raised(g)
            share = count / np.matmul(mine, e[:, :, None])[:, :, 0]
            g = 1 / topics + e * np.matmul(share[:, None, :], mine)[:, 0]
        yield rows[some], g, lens[some], place[held], count, mine, held


def _expected(docs: pa.Table, w: np.ndarray, known: np.ndarray, steps: int) -> np.ndarray:
    """The expected counts of a group's words in each topic."""
    out, waiting, cells = np.zeros(w.shape), [], 0

    def take() -> None:
        place, share, owner, e = (np.concatenate(x) for x in zip(*waiting, strict=True))
        for k in range(w.shape[1]):
            out[:, k] += np.bincount(place, share * np.repeat(np.ascontiguousarray(e[:, k]), owner), len(w))
        waiting.clear()

    for _, g, lens, place, count, mine, held in _group_steps(docs, w, known, steps):
        e = _raised(g)
        share = (count / np.matmul(mine, e[:, :, None])[:, :, 0])[held]
        waiting.append((place, share, lens, e))
        cells += len(place)
        if cells >= SLICE:
            take()
            cells = 0
    if waiting:
        take()
    return out * w


def _summed(docs: DataFrame, places: DataFrame, weights: DataFrame, topics: int, steps: int) -> DataFrame:
    """The next weights ``word, l0, l1, ..``: the prior and the expected counts of all groups."""
    every, totals = range(topics), _totals(weights, topics)

    def run(held: pa.Table, words: pa.Table) -> pa.Table:
        found = _expected(held, *_chances(words, totals), steps)[words.column(PLACE).to_numpy()]
        return pa.table({"word": words.column("word"), **{f"g{k}": pa.array(found[:, k]) for k in every}})

    near = places.join(weights, "word").groupBy(GROUP)
    schema = "word string, " + ", ".join(f"g{k} double" for k in every)
    parts = docs.groupBy(PART).cogroup(near).applyInArrow(run, schema)
    return parts.groupBy("word").agg(*[F.expr(f"{1 / topics!r}D + sum(g{k}) AS l{k}") for k in every])


def fit(
    docs: DataFrame, key: str, tokens: str = "tokens", topics: int = TOPICS, rounds: int = FULL.topic_iterations,
    steps: int = STEPS, least: float = TOPIC_MIN_DOCS, share: float = TOPIC_MAX_SHARE, seed: int = TOPIC_SEED,
    counts: tuple[DataFrame, DataFrame, int] | None = None,
) -> DataFrame:
    """Word weights ``word, l0, l1, ..`` after ``rounds`` over all documents, each document of its own ``key``.

    Each round's weights are written, so a lost executor repeats one round at most. No
    documents, or none with a word of the vocabulary, give an empty table. ``counts`` are the
    documents' ``counted``, where these are at hand.
    """
    spark = docs.sparkSession
    with scratch(spark):
        by_doc, by_word, n = counts or _tallied(docs, key, tokens)
        words = stage(vocabulary(by_word, n, least, share), "topic-vocabulary")
        places = stage(_places(by_word, words), "topic-places")
        weights = stage(first_weights(words, topics, seed), "topic-weights", keep=rounds == 0)
        for i in range(rounds):
            new = _summed(by_doc, places, weights, topics, steps)
            weights = stage(new, "topic-weights", keep=i == rounds - 1)
    return weights


def word_chances(weights: DataFrame) -> DataFrame:
    """``topic, word, weight``: the chance of each word in each topic."""
    names = [n for n in weights.columns if n != "word"]
    totals = weights.agg(*[F.sum(n) for n in names]).first()
    cells = [
        F.struct(F.lit(k).alias("topic"), (F.col(n) / F.lit(float(totals[k] or 1.0))).alias("weight"))
        for k, n in enumerate(names)
    ]
    return weights.select("word", F.inline(F.array(*cells))).select("topic", "word", "weight")


def shares(
    docs: DataFrame, weights: DataFrame, key: str, tokens: str = "tokens", steps: int = STEPS,
    counts: tuple[DataFrame, DataFrame, int] | None = None,
) -> DataFrame:
    """``key, topics``: the share of each topic in every document.

    Shares are equal where a document has no known word or no key. Documents of one key count as one.
    ``counts`` as for ``fit``.
    """
    topics = len(weights.columns) - 1
    totals, kind = _totals(weights, topics), docs.schema[key].dataType

    def run(held: pa.Table, words: pa.Table) -> pa.Table:
        parts, at = [], []
        for rows, g, *_ in _group_steps(held, *_chances(words, totals), steps):
            at.append(rows)
            parts.append(g / g.sum(1, keepdims=True))
        found = np.concatenate([*parts, np.zeros((0, topics))])
        cuts = pa.array(np.arange(len(found) + 1) * topics, pa.int32())
        keys = held.column(key).combine_chunks().take(pa.array(np.concatenate([*at, np.zeros(0, np.int64)])))
        return pa.table({"_key": keys, "topics": pa.ListArray.from_arrays(cuts, pa.array(found.ravel()))})

    with scratch(docs.sparkSession):
        by_doc, by_word, _ = counts or _tallied(docs, key, tokens)
        near = _places(by_word, weights).join(weights, "word").groupBy(GROUP)
        schema = T.StructType([T.StructField("_key", kind), T.StructField("topics", T.ArrayType(T.DoubleType()))])
        found = stage(by_doc.groupBy(PART).cogroup(near).applyInArrow(run, schema), "topic-shares", keep=True)
    same = docs[key].eqNullSafe(found["_key"])
    even = F.array(*[F.lit(1.0 / topics)] * topics)
    return docs.join(found, same, "left").select(docs[key], F.coalesce("topics", even).alias("topics"))
