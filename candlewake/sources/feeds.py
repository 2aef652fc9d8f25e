"""Readers and normalisers for news and calendar feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.schema import CALENDAR_FEED, NEWS_CSV

MIN_IMPORTANCE = 3


def read_news_csv(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Dated headlines; rows with a bad date are dropped, both ends of the range count."""
    raw = spark.read.csv(
        path, schema=NEWS_CSV, header=True, multiLine=True, quote='"', escape='"'
    )
    df = raw.select(F.try_to_timestamp("date").alias("ts"), F.col("title").alias("text")).where(
        F.col("ts").isNotNull()
    )
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df


def normalise_news(raw: DataFrame, category: str, keys: list[str] | None = None) -> DataFrame:
    """News rows from a feed with epoch seconds and headlines."""
    return raw.select(
        *(keys or []),
        F.timestamp_seconds("datetime").alias("ts"),
        F.col("headline").alias("text"),
        F.lit(category).alias("category"),
    )


def normalise_calendar(
    raw: DataFrame, json: str = "body", min_importance: int = MIN_IMPORTANCE
) -> DataFrame:
    """Calendar events from landed feed messages."""
    rows = raw.select(F.from_json(json, CALENDAR_FEED).alias("_p")).select(F.inline("_p.result"))
    return rows.where(F.col("importance") >= min_importance).select(
        F.timestamp_seconds("time").alias("ts"),
        "country",
        F.col("title").alias("event_name"),
        F.col("actual").alias("actual_value"),
        F.col("forecast").alias("consensus_forecast"),
        F.col("previous").alias("previous_value"),
        F.col("importance").alias("impact_level"),
    )
