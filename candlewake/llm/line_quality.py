"""Line-first quality rules.

Each line is judged on its own: end punctuation, navigation, boilerplate and noise.
Failing lines are removed, and a document that loses too much of its words by
that, or fails the counts of the whole text, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewake.llm.common import WORD, let, words_of

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
#: A sentence end, perhaps inside quotes or brackets. A line that holds one is prose, though it may break off later.
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*([\x20\x09-\x0D]|$)"
BOILERPLATE = (
    r"(?i)(javascript|cookies?\b|terms of (use|service)|privacy policy|all rights reserved|copyright|"
    r"licen[cs]ed under|released under the|lorem ipsum|click here|subscribe|sign up|log ?in\b|share this)"
)
#: Longer lines that name a boilerplate phrase are prose about it.
BOILERPLATE_WORDS = 25
#: Symbols a word from which on a line is noise, and separators a word from which on it is navigation.
NOISE = 0.3
NAVIGATION = 0.25
MIN_WORDS = 50
#: Percent of the words that may lie in repeated three-word windows.
MOST_REPEATED = 50
#: Share of the words that a document may lose with its lines.
MOST_LOST = 0.3


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_passes(line: Column, words: Column) -> Column:
    """Whether a line with ``words`` words stays. A line without words is a paragraph break and stays."""
    shouting = (F.upper(line) == line) & (F.lower(line) != line) & (words >= 4)
    fails = (
        ~line.rlike(SENTENCE_END)
        | (count_of(line, SEPARATORS) >= F.greatest(F.lit(2.0), words * NAVIGATION))
        | (count_of(line, SYMBOLS) >= F.greatest(F.lit(2.0), words * NOISE))
        | shouting
        | ((words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
    )
    return (words == 0) | ~fails


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in ``words``."""

    def covered(windows: Column) -> Column:
        marked = F.sort_array(F.transform(windows, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(s, j)["t"] == F.get(s, k)["t"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.aggregate(let(marked, twice), start, step, lambda a: a["n"]),
        ).otherwise(0)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) >= 3, let(windows, covered)).otherwise(0)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with one more column ``__quality``, a struct:

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of the whole
    text, ``base_failed``, ``words_left`` and ``clean_text`` after the lines that
    fail are removed, ``kept``. Null counts as an empty text, which has no words
    and is not kept. Rows are judged one by one, so repeated rows get equal results.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def by_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat"))

    def by_lines(lines: Column) -> Column:
        counted = F.transform(
            lines, lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"))
        )

        def sums(c: Column) -> Column:
            full = F.transform(F.filter(c, lambda x: x["words"] > 0), lambda x: x["line"])
            dup = let(full, lambda f: F.size(f) - F.size(F.array_distinct(f)))
            left = F.filter(c, lambda x: line_passes(x["line"], x["words"]))
            return let(
                left,
                lambda k: F.struct(
                    dup.cast("long").alias("n_dup_lines"),
                    F.aggregate(k, F.lit(0), lambda a, x: a + x["words"]).cast("long").alias("words_left"),
                    F.array_join(F.transform(k, lambda x: x["line"]), "\n").alias("clean_text"),
                ),
            )

        return let(counted, sums)

    parts = F.struct(
        let(words_of(F.col(text)), by_words).alias("w"),
        let(F.split(body, "\n"), by_lines).alias("l"),
        F.length(F.translate(body, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        count_of(body, SYMBOLS).cast("long").alias("n_symbols"),
    )

    def verdict(p: Column) -> Column:
        n, repeat = p["w"]["n_words"], p["w"]["n_repeat"]
        failed = (n < MIN_WORDS) | (100 * repeat > MOST_REPEATED * n)
        return F.struct(
            n.alias("n_words"),
            p["word_chars"].alias("word_chars"),
            p["n_symbols"].alias("n_symbols"),
            p["l"]["n_dup_lines"].alias("n_dup_lines"),
            repeat.alias("n_repeat_words"),
            failed.alias("base_failed"),
            p["l"]["words_left"].alias("words_left"),
            p["l"]["clean_text"].alias("clean_text"),
            (~failed & (p["l"]["words_left"] >= (1 - MOST_LOST) * n)).alias("kept"),
        )

    # Exploding one row to one row: what is made here is not made again for each filter or column above.
    return docs.select("*", F.explode(F.array(let(parts, verdict))).alias("__quality"))


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that stay, without their failing lines. Other columns are left as they are."""
    return (
        judge(docs, text)
        .filter(F.col("__quality.kept"))
        .withColumn(text, F.col("__quality.clean_text"))
        .select(*docs.columns)
    )
