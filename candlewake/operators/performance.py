"""Equity, drawdown and return ratios of closed deals.

A drawdown needs the running maximum of a running sum along a key. Deals are cut into blocks
by their position; a block is summarised by its sum, its highest and lowest running sum and
its worst fall, and summaries of neighbours combine to one of the same kind. So a task holds
a block of deals, and what is ordered along a key is one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewake.operators.blocks import BLK, BLOCK_ROWS, IDX, day_of, with_row_index

TRADING_DAYS, YEAR_DAYS = 252, 365.25


def _curve_in_blocks(
    deals: DataFrame, keys: list[str], ts: str, order: list[str], profit: str, block_rows: int, bucket: Column | None
) -> DataFrame:
    indexed = with_row_index(
        deals.withColumn("_p", F.coalesce(F.col(profit).cast("double"), F.lit(0.0))),
        keys, order, day_of(ts) if bucket is None else bucket,
    ).withColumn(BLK, F.floor(F.col(IDX) / block_rows))
    along = Window.partitionBy(*keys, BLK).orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)
    summed = indexed.withColumn("_sum", F.sum("_p").over(along))
    return summed.withColumn("_top", F.max("_sum").over(along))


def _starts(curve: DataFrame, keys: list[str]) -> DataFrame:
    """For each block the equity and the peak before it; the curve begins at a peak of zero."""
    blocks = curve.groupBy(*keys, BLK).agg(
        F.max_by("_sum", IDX).alias("_total"),
        F.max("_top").alias("_high"),
        F.min("_sum").alias("_low"),
        F.max(F.col("_top") - F.col("_sum")).alias("_fall"),
    )
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    started = blocks.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    peak = F.max(F.col("_start") + F.col("_high")).over(before)
    return started.withColumn("_peak", F.greatest(F.coalesce(peak, F.lit(0.0)), F.lit(0.0)))


def equity_curve(
    deals: DataFrame, keys: list[str], ts: str = "close_ts", order: list[str] | None = None, profit: str = "profit",
    block_rows: int = BLOCK_ROWS, bucket: Column | None = None,
) -> DataFrame:
    """Each deal with ``equity`` (profits so far), ``peak`` (the highest equity so far, at least
    zero) and ``drawdown`` (what the equity lies below it).

    Deals are taken in ``order`` (``ts`` unless given; add a tie-breaker where times repeat).
    A null profit counts as zero. Deals without a key or a time have no place and drop out.
    """
    curve = _curve_in_blocks(deals, keys, ts, order or [ts], profit, block_rows, bucket)
    starts = _starts(curve, keys).select(*keys, BLK, "_start", "_peak")
    equity = F.col("_start") + F.col("_sum")
    peak = F.greatest("_peak", F.col("_start") + F.col("_top"))
    out = curve.join(starts, [*keys, BLK]).withColumns({"equity": equity, "peak": peak, "drawdown": peak - equity})
    return out.select(*deals.columns, "equity", "peak", "drawdown")


def max_drawdown(
    deals: DataFrame, keys: list[str], ts: str = "close_ts", order: list[str] | None = None, profit: str = "profit",
    block_rows: int = BLOCK_ROWS, bucket: Column | None = None,
) -> DataFrame:
    """The greatest drawdown of each key, from block summaries alone."""
    blocks = _starts(_curve_in_blocks(deals, keys, ts, order or [ts], profit, block_rows, bucket), keys)
    fall = F.greatest("_fall", F.col("_peak") - (F.col("_start") + F.col("_low")))
    return blocks.groupBy(*keys).agg(F.max(fall).alias("max_drawdown"))


def trade_metrics(
    deals: DataFrame, keys: list[str], ts: str = "close_ts", order: list[str] | None = None, profit: str = "profit",
    block_rows: int = BLOCK_ROWS, bucket: Column | None = None,
) -> DataFrame:
    """One row for each key: deals, won, lost, profit, ``profit_factor`` (gains over losses),
    ``max_drawdown``, ``sharpe`` and ``calmar``.

    ``sharpe`` is the mean over the sample deviation of the sums of days with a deal, times
    the root of 252. ``calmar`` is the profit for a year, by the days from the first deal to
    the last, over the greatest drawdown. A ratio over zero, or of a single day, is null.
    """
    placed = deals.where(F.col(ts).isNotNull())
    for key in keys:
        placed = placed.where(F.col(key).isNotNull())
    p = F.coalesce(F.col(profit).cast("double"), F.lit(0.0))
    days = placed.groupBy(*keys, day_of(ts).alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(p > 0).alias("_won"),
        F.count_if(p < 0).alias("_lost"),
        F.sum(p).alias("_sum"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("_gain"),
        F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("_loss"),
    )
    span = F.date_diff(F.max("_day"), F.min("_day"))
    totals = days.groupBy(*keys).agg(
        F.sum("_n").alias("deals"),
        F.sum("_won").alias("won"),
        F.sum("_lost").alias("lost"),
        F.sum("_sum").alias("profit"),
        F.try_divide(F.sum("_gain"), F.sum("_loss")).alias("profit_factor"),
        (F.try_divide(F.avg("_sum"), F.stddev_samp("_sum")) * TRADING_DAYS**0.5).alias("sharpe"),
        F.try_divide(F.sum("_sum") * YEAR_DAYS, span.cast("double")).alias("_yearly"),
    )
    falls = max_drawdown(deals, keys, ts, order, profit, block_rows, bucket)
    return totals.join(falls, keys).withColumn("calmar", F.try_divide("_yearly", "max_drawdown")).drop("_yearly")
