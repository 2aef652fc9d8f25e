"""Language identification by a linear-chain conditional random field over words.

Each word of a text is labelled with a language. Its score for a language comes from
its n-grams of two to four bytes, which with the marks for its start and end are its
affixes too, and from a lexicon of frequent words; transitions between the
languages of neighbouring words are learned with them. Marginals by forward-backward
add up to the language of the text.

The field is fitted on a bounded sample of labelled texts. Their lines of thought are
cut into stretches and joined to sequences that switch languages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewake.llm.common import crc_bucket, sized

FOLDS, HELD_OUT = 3, 1
#: Labelled texts of each language that the field is fitted on, at most; drawn by hash of the key.
SAMPLE = 320
#: Hashed n-gram features, and frequent words of the sample with weights of their own.
SPACE = 1 << 16
LEXICON = 20_000
GRAMS = (2, 3, 4)
#: Words in a stretch of one language in training, and stretches in a sequence.
STRETCH = (5, 40)
STRETCHES = 4
ROUNDS = 2
RATE = 0.3
BLOCK = 128


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def has_letter(word: bytes) -> bool:
    return any(c.isalpha() for c in word.decode())


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of distinct words, and where each word's begin."""
    text = np.frombuffer(b"".join(b"\x02%b\x03" % w for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(text))
    word = np.repeat(np.arange(len(words)), sizes)
    found, owners = [], []
    for n in GRAMS:
        code = np.full(max(len(text) - n + 1, 0), np.uint64(n))
        for j in range(n):
            code = code * np.uint64(0x100000001B3) + text[j : len(text) - n + 1 + j]
        inside = at[: len(code)] + n <= ends[: len(code)]
        mixed = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        found.append(mixed[inside].astype(np.int32))
        owners.append(word[: len(code)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts = np.searchsorted(owners[order], np.arange(len(words)))
    return np.concatenate(found)[order], starts


class Field:
    """Weights of n-grams and lexicon words for each language, and transition weights."""

    def __init__(self, names: list[str], lexicon: dict[bytes, int]) -> None:
        self.names, self.lexicon = names, lexicon
        k = len(names)
        self.by_gram = np.zeros((SPACE, k))
        self.by_word = np.zeros((len(lexicon) + 1, k))  # the last row, for other words, stays zero
        self.steps = np.zeros((k, k))

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Scores of distinct words for each language."""
        out = np.empty((len(words), len(self.names)))
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            features, starts = grams(part)
            rows = np.fromiter((self.lexicon.get(w, -1) for w in part), np.int64, len(part))
            out[at : at + len(part)] = np.add.reduceat(self.by_gram[features], starts, axis=0) + self.by_word[rows]
        return out


def marginals(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray, block: int = BLOCK, pairs: bool = False):
    """Chances of each language at each word of texts laid end to end; with ``pairs`` also expected transitions.

    Texts are cut into blocks, and all blocks go forward at the same time: first as
    products of step matrices, which gives the messages at their ends, then word by
    word. The result is that of one pass through each text. A text starts from equal
    chances and one step.
    """
    k = scores.shape[1]
    step = np.exp(steps - steps.max())
    near = np.exp(scores - scores.max(axis=1, keepdims=True))
    per = -(-lengths // block)
    first = np.repeat(np.cumsum(lengths) - lengths, per)
    inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = first + inner * block
    size = np.minimum(np.repeat(lengths, per) - inner * block, block)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    active = [int(np.searchsorted(-size, -t)) for t in range(int(size.max(initial=0)))]  # blocks longer than t
    slot = np.empty(len(order), np.int64)
    slot[order] = np.arange(len(order))
    whole = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)

    before = np.full((len(start), k), 1 / k)
    after = np.full((len(start), k), 1 / k)
    if per.max(initial=0) > 1:
        product = np.tile(np.eye(k), (len(start), 1, 1))
        for t, m in enumerate(active):
            product[:m] = (product[:m] @ step) * near[start[:m] + t][:, None, :]
            product[:m] /= np.maximum(product[:m].max(axis=(1, 2), keepdims=True), 1e-300)
        head = np.cumsum(per) - per
        long = np.argsort(-per, kind="stable")
        for j in range(1, int(per.max())):
            texts = long[: np.searchsorted(-per[long], -j)]
            a, b = slot[head[texts] + j - 1], slot[head[texts] + j]
            before[b] = whole(np.einsum("ni,nij->nj", before[a], product[a]))
        for j in range(int(per.max()) - 1, 0, -1):
            texts = long[: np.searchsorted(-per[long], -j)]
            a, b = slot[head[texts] + j - 1], slot[head[texts] + j]
            after[a] = whole(np.einsum("nij,nj->ni", product[b], after[b]))
    forward = np.empty_like(near)
    now = before.copy()
    for t, m in enumerate(active):
        now[:m] = whole((now[:m] @ step) * near[start[:m] + t])
        forward[start[:m] + t] = now[:m]
    chances, moves = np.empty_like(near), np.zeros((k, k))
    now = after
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        rows = start[:m] + t
        chances[rows] = whole(forward[rows] * now[:m])
        seen = near[rows] * now[:m]
        if pairs:
            last = forward[rows - 1] if t else before[:m]
            both = last[:, :, None] * step * seen[:, None, :]
            moves += (both / np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
        now[:m] = whole(seen @ step.T)
    return (chances, moves) if pairs else chances


def fit(texts: list[str], labels: list[str], seed: int = 5) -> Field:
    """A field for the languages among ``labels``, by stochastic gradient steps on the log-likelihood."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    number = {n: i for i, n in enumerate(names)}
    words: dict[bytes, int] = {}
    stretches, counts = [], Counter()
    for text, label in zip(texts, labels, strict=True):
        parts = tokens(text)
        counts.update(parts)
        ids = np.fromiter((words.setdefault(w, len(words)) for w in parts), np.int64, len(parts))
        cuts = np.cumsum(rng.integers(*STRETCH, size=len(ids) // STRETCH[0] + 1))
        stretches += [(x, number[label]) for x in np.split(ids, cuts[cuts < len(ids)]) if len(x)]
    frequent = sorted(counts, key=lambda w: (-counts[w], w))[:LEXICON]
    field = Field(names, {w: i for i, w in enumerate(frequent)})
    if not stretches:
        return field
    features, starts = grams(list(words))
    sizes = np.diff(np.append(starts, len(features)))
    rows = np.fromiter((field.lexicon.get(w, -1) for w in words), np.int64, len(words))
    k = len(names)
    squares = [np.full_like(x, 1e-2) for x in (field.by_gram, field.by_word, field.steps)]
    for _ in range(ROUNDS):
        shuffled = rng.permutation(len(stretches))
        for at in range(0, len(shuffled), 64 * STRETCHES):
            part = [stretches[i] for i in shuffled[at : at + 64 * STRETCHES]]
            ids = np.concatenate([x for x, _ in part])
            truth = np.repeat([y for _, y in part], [len(x) for x, _ in part])
            lengths = np.array([sum(len(x) for x, _ in part[i : i + STRETCHES]) for i in range(0, len(part), STRETCHES)])
            own, place = np.unique(ids, return_inverse=True)
            used = np.concatenate([features[s : s + n] for s, n in zip(starts[own], sizes[own], strict=True)])
            begin = np.cumsum(sizes[own]) - sizes[own]
            score = np.add.reduceat(field.by_gram[used], begin, axis=0) + field.by_word[rows[own]]
            chance, moves = marginals(score[place], lengths, field.steps, int(lengths.max()), pairs=True)
            wrong = chance.copy()
            wrong[np.arange(len(ids)), truth] -= 1
            firsts = np.zeros(len(ids), bool)
            firsts[np.cumsum(lengths) - lengths] = True
            np.subtract.at(moves, (truth[:-1][~firsts[1:]], truth[1:][~firsts[1:]]), 1)
            np.subtract.at(moves, (slice(None), truth[firsts]), 1 / k)
            by_word = np.stack([np.bincount(place, wrong[:, c], len(own)) for c in range(k)], axis=1)
            owner = np.repeat(np.arange(len(own)), sizes[own])
            slopes = [
                np.stack([np.bincount(used, by_word[owner, c], SPACE) for c in range(k)], axis=1),
                np.stack([np.bincount(rows[own] % len(field.by_word), by_word[:, c], len(field.by_word)) for c in range(k)], axis=1),
                moves,
            ]
            slopes[1][-1] = 0
            for weight, slope, square in zip((field.by_gram, field.by_word, field.steps), slopes, squares, strict=True):
                slope = slope / len(ids) * 100
                square += slope**2
                weight -= RATE * slope / np.sqrt(square)
    return field


def label(texts: list[str | None], field: Field) -> list[tuple[str, float]]:
    """(language, its mean chance over the words with letters) of each text; ``und`` and 0 without letters."""
    words: dict[bytes, int] = {}
    ids, lengths = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = tokens(text)
        ids += [words.setdefault(w, len(words)) for w in parts]
        lengths[i] = len(parts)
    if not ids or not field.names:
        return [("und", 0.0)] * len(texts)
    ids = np.array(ids)
    chance = marginals(field.scores(list(words))[ids], lengths, field.steps)
    lettered = np.fromiter(map(has_letter, words), bool, len(words))[ids]
    text = np.repeat(np.arange(len(texts)), lengths)[lettered]
    n = np.bincount(text, minlength=len(texts))
    sums = np.stack([np.bincount(text, c, len(texts)) for c in chance[lettered].T], axis=1)
    best = sums.argmax(axis=1)
    return [
        (field.names[b], float(min(1.0, s[b] / m))) if m else ("und", 0.0) for b, s, m in zip(best, sums, n, strict=True)
    ]


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score`` for each row; learned from rows that are not held out.

    Rows without a text or language teach nothing. With nothing learned all texts are
    ``und``. Repeated rows are labelled, and may be drawn, one by one; null keys count as empty.
    """
    spark = docs.sparkSession
    held = crc_bucket(key, FOLDS) == HELD_OUT
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held.alias("held_out"))
    teach = rows.filter("not held_out and lang is not null and text is not null")
    # The first keys of each language in hash order, drawn from parts, so that no task ranks a whole language.
    order = Window.partitionBy("lang", "part").orderBy(F.xxhash64("id"), "id")
    drawn = teach.select("id", "lang", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(32)).alias("part"))
    drawn = drawn.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= -(-SAMPLE // 32))
    drawn = sized(drawn.select("id").distinct(), "language-sample")
    sample = teach.join(drawn, "id").select("text", "lang").orderBy("lang", F.xxhash64("text")).toArrow()
    field = fit(sample.column("text").to_pylist(), sample.column("lang").to_pylist())
    for name in ("by_gram", "by_word"):
        setattr(field, name, getattr(field, name).astype(np.float32))
    shared = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = label(part.column(2).to_pylist(), shared.value)
                cells = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *cells], ["id", "held_out", "lang_pred", "score"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return rows.select("id", "held_out", "text").mapInArrow(
        run, f"id {kind}, held_out boolean, lang_pred string, score double"
    )
