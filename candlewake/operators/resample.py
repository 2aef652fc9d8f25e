"""Ticks to bars, bars to longer bars, duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ticks_to_bars(
    ticks: DataFrame,
    every: str,
    order: list[str],
    price: str = "price",
    size: str = "size",
    keys: list[str] | None = None,
) -> DataFrame:
    """Left-closed, left-labelled bars; ``order`` is the total order of ticks.

    All aggregates combine on the map side, so a symbol with a large share of the
    ticks sends one row per task and bar.
    """
    keys = keys or ["symbol"]
    rank = F.struct(*order)
    return _aggregate(
        ticks,
        every,
        keys,
        F.min_by(price, rank),
        F.max(price),
        F.min(price),
        F.max_by(price, rank),
        F.sum(size),
    )


def resample(bars: DataFrame, every: str, keys: list[str] | None = None) -> DataFrame:
    """Longer bars from shorter ones; empty bins do not appear."""
    keys = keys or ["symbol"]
    return _aggregate(
        bars,
        every,
        keys,
        F.min_by("open", "ts"),
        F.max("high"),
        F.min("low"),
        F.max_by("close", "ts"),
        F.sum("volume"),
    )


def _aggregate(
    df: DataFrame,
    every: str,
    keys: list[str],
    first: Column,
    high: Column,
    low: Column,
    last: Column,
    volume: Column,
) -> DataFrame:
    return (
        df.groupBy(*keys, F.window("ts", every).alias("_bin"))
        .agg(
            first.alias("open"),
            high.alias("high"),
            low.alias("low"),
            last.alias("close"),
            volume.cast("bigint").alias("volume"),
        )
        .select(*keys, F.col("_bin.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by ``order``; combines on the map side, unlike ``row_number``."""
    rest = [n for n in df.columns if n not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, *[F.col(f"_row.{n}").alias(n) for n in rest]).select(*df.columns)
