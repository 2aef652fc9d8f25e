"""Text sentiment: scoring, daily means, smoothing, joins to bars, base against quote."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewake.functions.text import is_blank, label_distribution, with_polarity
from candlewake.operators import scan
from candlewake.operators.blocks import BLOCK_ROWS, indexed_blocks

PARTS = ["positive", "negative", "neutral", "polarity"]
SMOOTHED = ["polarity", "positive", "negative"]
EMA_SPANS = (3, 7, 14)

# A small built-in word list for the default scorer, in plain order.
POSITIVE_WORDS = [
    "advance", "beat", "boost", "bullish", "confident", "exceed", "expand", "gain", "growth", "improve",
    "optimistic", "profit", "rally", "recover", "rise", "robust", "strong", "surge", "upgrade", "win",
]
NEGATIVE_WORDS = [
    "bearish", "crash", "crisis", "decline", "default", "deficit", "downgrade", "drop", "fail", "fall",
    "fear", "loss", "miss", "plunge", "recession", "risk", "slump", "stupid", "weak", "worthless",
]

# English stop words longer than three characters.
STOP_WORDS = [
    "about", "above", "after", "again", "against", "because", "been", "before", "being", "below",
    "between", "both", "could", "does", "doing", "down", "during", "each", "from", "further",
    "have", "having", "here", "hers", "herself", "himself", "into", "itself", "just", "more",
    "most", "myself", "once", "only", "other", "ours", "ourselves", "over", "same", "should",
    "some", "such", "than", "that", "their", "theirs", "them", "themselves", "then", "there",
    "these", "they", "this", "those", "through", "under", "until", "very", "were", "what", "when",
    "where", "which", "while", "whom", "will", "with", "your", "yours", "yourself", "yourselves",
]

Scorer = Callable[[pd.Series], pd.DataFrame]


def lexicon_label(df: DataFrame, text: str = "text") -> DataFrame:
    """Label and score from counts of listed words over the whole text."""
    words = F.split(F.lower(F.col(text)), r"[^a-z]+")
    hits = lambda ws: F.size(F.filter(words, lambda t: t.isin(*ws)))
    out = df.withColumns({"_pos": hits(POSITIVE_WORDS), "_neg": hits(NEGATIVE_WORDS)})
    total = F.col("_pos") + F.col("_neg")
    margin = F.try_divide(F.abs(F.col("_pos") - F.col("_neg")), total)
    label = (
        F.when(F.col("_pos") > F.col("_neg"), "positive")
        .when(F.col("_neg") > F.col("_pos"), "negative")
        .otherwise("neutral")
    )
    score = F.coalesce(F.lit(0.5) + margin / 2, F.lit(1.0))
    return out.withColumns({"label": label, "score": score}).drop("_pos", "_neg")


def word_scorer(texts: pd.Series) -> pd.DataFrame:
    """The word rule as a scorer, in the shape that any other model would have."""
    words = texts.fillna("").str.lower().str.split(r"[^a-z]+", regex=True)
    pos = words.map(lambda ws: sum(w in POSITIVE_WORDS for w in ws))
    neg = words.map(lambda ws: sum(w in NEGATIVE_WORDS for w in ws))
    total = pos + neg
    score = (0.5 + (pos - neg).abs() / total.where(total > 0) / 2).fillna(1.0)
    label = pd.Series("neutral", index=texts.index)
    label = label.mask(pos > neg, "positive").mask(neg > pos, "negative")
    return pd.DataFrame({"label": label, "score": score.astype("float64")})


def scored_by(df: DataFrame, scorer: Scorer, text: str = "text", batch: int = 32) -> DataFrame:
    """Label and score from any model; ``scorer`` maps a series of texts to two columns.

    The scorer is shipped once per task and called with at most ``batch`` texts.
    """

    @F.pandas_udf(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())
    ]))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            calls = [scorer(part.iloc[i : i + batch]) for i in range(0, len(part), batch)]
            yield pd.concat(calls, ignore_index=True)[["label", "score"]]

    scored = df.withColumn("_r", run(F.col(text)))
    return scored.withColumns(
        {"label": F.col("_r.label"), "score": F.col("_r.score")}
    ).drop("_r")


def article_sentiment(df: DataFrame, scorer: Scorer | None = None, text: str = "text") -> DataFrame:
    """Positive, negative, neutral and polarity of every article."""
    labelled = scored_by(df, scorer, text) if scorer else lexicon_label(df, text)
    parts = label_distribution(F.col("label"), F.col("score"), is_blank(F.col(text)))
    return with_polarity(labelled.withColumns(parts)).drop("label", "score")


def daily_sentiment(articles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return articles.groupBy(*keys, F.to_date("ts").alias("date")).agg(
        *[F.avg(n).alias(n) for n in PARTS]
    )


def sentiment_ema(
    daily: DataFrame, keys: list[str] | None = None, spans: tuple[int, ...] = EMA_SPANS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exponential averages that start at the first day, one per series and span."""
    keys = keys or []
    src = daily if keys else daily.withColumn("_all", F.lit(1))
    betas = [1 - 2.0 / (n + 1) for n in spans]
    b = indexed_blocks(
        src,
        keys or ["_all"],
        ["date"],
        F.trunc("date", "year"),
        scan.reach(max(betas)),
        block_rows=block_rows,
        segment_rows=scan.segment_rows_for(*betas),
    )
    b = scan.apply(
        b, [scan.ema_unseeded(f"{x}_ema_{n}", x, n) for x in SMOOTHED for n in spans]
    )
    return b.close().select(*daily.columns, *[f"{x}_ema_{n}" for x in SMOOTHED for n in spans])


def attach_daily(
    bars: DataFrame, daily: DataFrame, keys: list[str] | None = None, lag_days: int = 0
) -> DataFrame:
    """Sentiment of the bar's day (or of an earlier day); zero where there is none."""
    keys = keys or []
    cols = [n for n in daily.columns if n not in [*keys, "date"]]
    shifted = daily.withColumn("date", F.date_add("date", lag_days))
    joined = bars.withColumn("date", F.to_date("ts")).join(shifted, [*keys, "date"], "left")
    return joined.select(
        *bars.columns, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in cols]
    )


def differential_sentiment(base: DataFrame, quote: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Base minus quote per day; a side without news counts as zero."""
    on = [*(keys or []), "date"]
    names = ["polarity", "positive", "negative"]
    names += [n for n in base.columns if n.startswith("polarity_ema_")]
    b = base.select(*on, *[F.col(n).alias(f"_b_{n}") for n in names])
    q = quote.select(*on, *[F.col(n).alias(f"_q_{n}") for n in names])
    zero = F.lit(0.0)
    return b.join(q, on, "full").select(
        *on,
        *[
            (F.coalesce(f"_b_{n}", zero) - F.coalesce(f"_q_{n}", zero)).alias(f"{n}_diff")
            for n in names
        ],
    )
