"""Text rules for topics and sentiment as column expressions."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def topic_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case letter tokens longer than three characters that are not stop words."""
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    # One range and the characters of \s: Java takes some nine times as long over a class of more sets.
    letters = F.regexp_replace(F.lower(text), r"[^a-z \t\n\x0B\f\r]", "")
    words = [w for w in stop_words if len(w) > 3]
    return F.filter(
        F.split(letters, r"\s+"),
        lambda t: (F.length(t) > 3) & ~t.isin(words),
    )


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"\s", "")) == 0, F.lit(True))


def label_distribution(label: Column, score: Column, blank: Column) -> dict[str, Column]:
    """Score to its own label and half of the rest to each of the others."""

    def part(name: str) -> Column:
        share = F.when(F.lower(label) == name, score).otherwise((1.0 - score) / 2)
        return F.when(blank, 1.0 if name == "neutral" else 0.0).otherwise(share)

    return {n: part(n) for n in ("positive", "negative", "neutral")}


def with_polarity(df: DataFrame) -> DataFrame:
    return df.withColumn("polarity", F.col("positive") - F.col("negative"))
