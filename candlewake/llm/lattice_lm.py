"""Language-model scores from the lattice of subwords.

A text is its lower-cased words and an end. The model draws pieces of a given public
vocabulary one by one; the probability of a text is the sum over all ways to cut it
into pieces. No piece reaches over the start of a word, so the lattice of a text is
a chain of lattices of words: the forward recursion, in logarithms, runs once for each
distinct word of the corpus, and a text adds up its words.

The vocabulary file holds ranks of merges and no probabilities. Those come from
the training texts: their words are cut by the file's own tokenizer, and the
pieces counted. The vocabulary itself is not trained.

Distinct words grow with the corpus: their table is joined by shuffle. The ``HEAD`` most
frequent words of the training texts go to all tasks, which keeps most tokens out of
the shuffle; all others are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from candlewake.llm.common import crc_bucket, lower_ascii, words_of
from candlewake.session import stage

#: Vocabulary file, in the format of sentencepiece.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words known to every task; the rest is joined.
HEAD = 100_000
FOLDS, HELD_OUT = 5, 1
SMOOTH = 0.5
SPACE = "▁"


class Lattice:
    """Log-probabilities (natural) of pieces, and of words as sums over their segmentations.

    A character that is no piece is written as the pieces of its UTF-8 bytes.
    """

    def __init__(self, scores: dict[str, float], by_byte: list[float]) -> None:
        self.scores, self.by_byte = scores, by_byte
        self.longest = max(map(len, scores), default=1)

    def word(self, word: str) -> float:
        text, get = SPACE + word, self.scores.get
        forward = [0.0]
        for i in range(1, len(text) + 1):
            ways = []
            for j in range(max(0, i - self.longest), i):
                score = get(text[j:i])
                if score is not None:
                    ways.append(forward[j] + score)
            if text[i - 1] not in self.scores:
                ways.append(forward[i - 1] + sum(self.by_byte[b] for b in text[i - 1].encode()))
            if len(ways) == 1:
                forward.append(ways[0])
            else:
                top = max(ways)
                forward.append(top + math.log(sum([math.exp(w - top) for w in ways])))
        return forward[-1]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all words of ``docs`` (``train``, ``text``); ``n`` counts training texts alone."""
    words = docs.select("train", F.explode(words_of(lower_ascii(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.sum(F.col("train").cast("long")).alias("n"))


def frequent_words(words: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, ``most`` at most: as many whole classes of equal log-counts as fit."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = words.filter("n > 0").groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()
    least, room = 1 << 20, most
    for level_, n in sorted(((r.level, r.words) for r in sizes), reverse=True):
        if n > room:
            break
        least, room = level_, room - n
    return words.filter("n > 0").filter(level >= least)


def piece_counts(words: DataFrame, model: bytes) -> dict[int, int]:
    """How often the vocabulary's pieces occur in the words, by piece; at most a row per piece comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = sentencepiece.SentencePieceProcessor(model_proto=model)
        sums = np.zeros(cutter.get_piece_size(), np.int64)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                cut = cutter.encode(part.column(0).to_pylist(), num_threads=1)
                times = np.repeat(part.column(1).to_numpy(), [len(x) for x in cut])
                np.add.at(sums, np.fromiter((p for x in cut for p in x), np.int64, len(times)), times)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["piece", "n"])

    rows = words.filter("n > 0").select("word", "n").mapInArrow(run, "piece long, n long")
    return {r.piece: r.n for r in rows.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


def lattice_of(counts: dict[int, int], ends: int, model: bytes) -> tuple[Lattice, float]:
    """The lattice, and the log-probability of an end."""
    file = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = file.get_piece_size()
    total = math.log(sum(counts.values()) + ends + SMOOTH * size)
    scores, by_byte = {}, [0.0] * 256
    for i in range(size):
        score = math.log(counts.get(i, 0) + SMOOTH) - total
        if file.is_byte(i):
            by_byte[int(file.id_to_piece(i)[3:5], 16)] = score
        elif not (file.is_control(i) or file.is_unknown(i)):
            scores[file.id_to_piece(i)] = score
    return Lattice(scores, by_byte), math.log(ends + SMOOTH) - total


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    A null text counts as empty: one token, the end. Rows that repeat a key are scored one
    by one, and count as often in training if they train. Null keys are hashed as empty text.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        model = f.read()
    held = crc_bucket(key, FOLDS) == HELD_OUT
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), held.alias("held_out"))
    words = stage(word_counts(rows.select((~F.col("held_out")).alias("train"), "text")), "lm-words")
    ends = rows.filter("not held_out").count()
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    total, distinct = sums.n + ends, sums.v + (ends > 0)
    lattice, end_score = lattice_of(piece_counts(words, model), ends, model)
    below = total + SMOOTH * (distinct + 1)
    base = lambda n: math.log10((n + SMOOTH) / below)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lattices = [lattice.word(w) / math.log(10) for w in batch.column(0).to_pylist()]
            bases = [base(n) for n in batch.column(1).to_pylist()]
            cells = [batch.column(0), batch.column(1), pa.array(bases, pa.float64()), pa.array(lattices, pa.float64())]
            yield pa.RecordBatch.from_arrays(cells, ["word", "n", "base", "lattice"])

    words = stage(
        words.select("word", "n").mapInArrow(scored, "word string, n long, base double, lattice double"), "lm-scored"
    )
    frequent = frequent_words(words, HEAD).collect()
    head = spark.sparkContext.broadcast({r.word.encode(): (r.base, r.lattice) for r in frequent})
    at_end = (1, int(ends > 0), base(ends), end_score / math.log(10))

    kind = to_arrow_type(rows.schema["id"].dataType)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                ids, keys, tokens, hits, bases, lattices = [], [], [], [], [], []
                for i, data in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
                    n, k, b, s = at_end
                    for w, times in Counter((data or b"").lower().split()).items():
                        if (found := known.get(w)) is None:
                            ids.append(i)
                            keys.append(w)
                            tokens.append(times)
                        else:
                            n, k, b, s = n + times, k + times, b + times * found[0], s + times * found[1]
                    hits.append((i, n, k, b, s))
                m = len(ids)
                ids += [h[0] for h in hits]
                keys += [b" %d" % h[0] for h in hits]  # no word has a space: joined with nothing
                tokens += [h[1] for h in hits]
                known_n = np.concatenate([np.zeros(m, np.int64), np.array([h[2] for h in hits], np.int64)])
                bases = np.concatenate([np.zeros(m), np.array([h[3] for h in hits])])
                lattices = np.concatenate([np.zeros(m), np.array([h[4] for h in hits])])
                cells = [
                    pa.array(ids, pa.int64()), pa.array(keys, pa.binary()).cast(pa.string()),
                    pa.array(tokens, pa.int64()), pa.array(known_n), pa.array(bases), pa.array(lattices),
                    pa.concat_arrays([pa.nulls(m, kind), part.column("id").cast(kind)]),
                    pa.concat_arrays([pa.nulls(m, pa.bool_()), part.column("held_out")]),
                ]
                yield pa.RecordBatch.from_arrays(cells, ["row", "word", "tokens", "known", "b", "l", "id", "held_out"])

    # Row numbers hold only within one run over the documents, so they are given and written once.
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", F.col("text").cast("binary"))
    shape = f"row long, word string, tokens long, known long, b double, l double, id {rows.schema['id'].dataType.simpleString()}, held_out boolean"
    split = stage(numbered.mapInArrow(parts, shape), "lm-split")
    times = lambda c: F.coalesce(F.col(c) * F.col("tokens"), F.lit(0.0))
    sums = (
        split.join(words, "word", "left")
        .groupBy("row")
        .agg(
            F.max("id").alias("id"),
            F.max("held_out").alias("held_out"),
            F.sum("tokens").alias("n_tokens"),
            F.sum(F.col("known") + F.when(F.col("n") > 0, F.col("tokens")).otherwise(0)).alias("n_known"),
            F.sum(F.col("b") + times("base")).alias("base_score"),
            F.sum(F.col("l") + times("lattice")).alias("score"),
        )
    )
    return sums.select(
        "id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )
