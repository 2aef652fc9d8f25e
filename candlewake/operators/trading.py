"""Gates over signals and deals that need history: volatility, losses, limits, exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewake.operators.blocks import Blocks, day_of, indexed_blocks
from candlewake.operators.resample import first_per
from candlewake.operators.timeline import asof_join, running_totals

# Frames and factors of the volatility rules.
GATE_ROWS, GATE_FLOOR, SPREAD_SHARE = 100, 0.5, 0.3
REGIME_ROWS, REGIME_BAND = 50, 0.5
EXIT_CONFIDENCE = 0.60


def _blocks(df: DataFrame, keys: list[str], rows: int, bucket: Column | None, **sizes: int) -> Blocks:
    return indexed_blocks(df, keys, ["ts"], day_of("ts") if bucket is None else bucket, rows, **sizes)


def volatility_gate(
    df: DataFrame, spread: str = "spread", keys: list[str] | None = None,
    bucket: Column | None = None, **sizes: int,
) -> DataFrame:
    """``allowed`` by ATR against its recent mean and by spread against ATR.

    With fewer than 100 values both count as zero, so any spread blocks. A row without
    ATR is allowed.
    """
    keys = keys or ["symbol"]
    b = _blocks(df, keys, GATE_ROWS, bucket, **sizes)
    w = b.last(GATE_ROWS)
    out = b.add({"_mean": F.avg("atr_14").over(w), "_n": F.count("atr_14").over(w)}).close()
    enough = F.col("_n") >= GATE_ROWS
    atr = F.when(enough, F.col("atr_14")).otherwise(0.0)
    mean = F.when(enough, F.col("_mean")).otherwise(0.0)
    blocked = (atr < GATE_FLOOR * mean) | (F.col(spread) > SPREAD_SHARE * atr)
    allowed = F.when(F.col("atr_14").isNull(), True).otherwise(~blocked)
    return out.withColumn("allowed", allowed).drop("_mean", "_n")


def volatility_regime(
    df: DataFrame, keys: list[str] | None = None, bucket: Column | None = None, **sizes: int
) -> DataFrame:
    """LOW, MEDIUM or HIGH by ATR against mean and deviation of its last 50 values."""
    keys = keys or ["symbol"]
    b = _blocks(df, keys, REGIME_ROWS, bucket, **sizes)
    w = b.last(REGIME_ROWS)
    out = b.add(
        {
            "_mean": F.avg("atr_14").over(w),
            "_sd": F.stddev_pop("atr_14").over(w),
            "_n": F.count("atr_14").over(w),
        }
    ).close()
    atr, band = F.col("atr_14"), REGIME_BAND * F.col("_sd")
    regime = (
        F.when(F.col("_n") < REGIME_ROWS, "MEDIUM")
        .when(atr < F.col("_mean") - band, "LOW")
        .when(atr > F.col("_mean") + band, "HIGH")
        .otherwise("MEDIUM")
    )
    return out.withColumn("regime", regime).drop("_mean", "_sd", "_n")


def loss_streaks(
    deals: DataFrame, keys: list[str], order: list[str], bucket: Column
) -> DataFrame:
    """Losses since the last win along each key; a zero profit changes nothing.

    A win starts a new island, and the streak is the running loss count minus the
    count at the last win, which is the largest such count so far.
    """
    won, lost = F.col("profit") > 0, F.col("profit") < 0
    counted = running_totals(
        deals, keys, bucket, order, {"_losses": lost.cast("bigint"), "_wins": won.cast("bigint")}
    )
    at_win = F.when(won, F.col("_losses"))
    reset = running_max(counted, keys, bucket, order, {"_reset": at_win})
    return reset.withColumn(
        "loss_count", F.col("_losses") - F.coalesce("_reset", F.lit(0))
    ).drop("_losses", "_wins", "_reset")


def running_max(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], cols: dict[str, Column]
) -> DataFrame:
    """Inclusive running maxima along each key, bucket by bucket."""
    tagged = df.withColumn("_b", bucket).withColumns({f"_v_{n}": x for n, x in cols.items()})
    tops = tagged.groupBy(*keys, "_b").agg(*[F.max(f"_v_{n}").alias(f"_m_{n}") for n in cols])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_b", *[F.max(f"_m_{n}").over(earlier).alias(f"_c_{n}") for n in cols])
    w = (
        Window.partitionBy(*keys, "_b").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = tagged.join(carried, [*keys, "_b"]).withColumns(
        {n: F.greatest(F.col(f"_c_{n}"), F.max(f"_v_{n}").over(w)) for n in cols}
    )
    return out.select(*df.columns, *cols)


def recovery_depth(
    deals: DataFrame, keys: list[str], order: list[str], bucket: Column
) -> DataFrame:
    """Depth that rises by one with a loss and falls by one, not below zero, otherwise.

    With S the plain walk of the same steps, the depth is S minus the lowest S so far,
    or S itself while it has not been below zero.
    """
    step = F.when(F.col("profit") < 0, 1).otherwise(-1)
    walk = running_totals(deals, keys, bucket, order, {"_walk": step.cast("bigint")})
    low = running_max(walk, keys, bucket, order, {"_low": -F.col("_walk")})
    floor = F.least(F.lit(0), -F.col("_low"))
    return low.withColumn("depth", F.col("_walk") - floor).drop("_walk", "_low")


def block_after_loss(
    signals: DataFrame, streaks: DataFrame, close_ts: str = "close_ts"
) -> DataFrame:
    """Signals whose last closed deal of the same symbol and side left no open loss streak."""
    joined = asof_join(
        signals, streaks, ["symbol", "side"], ["loss_count"], right_ts=close_ts
    )
    return joined.where(F.coalesce("loss_count", F.lit(0)) == 0).drop("loss_count")


def daily_first(signals: DataFrame, order: list[str]) -> DataFrame:
    """First BUY and first SELL per symbol and day."""
    dated = signals.withColumn("date", F.to_date("ts"))
    return first_per(dated, ["symbol", "date", "side"], order).select(*dated.columns)


def daily_close_flag(rows: DataFrame, fires: Column) -> DataFrame:
    """Time of the first row per symbol and day on which the close rule fires."""
    return rows.where(fires).groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.min("ts").alias("close_ts")
    )


def new_bar_rows(ticks: DataFrame, every: str, order: list[str]) -> DataFrame:
    """First tick of each bar."""
    binned = ticks.withColumn("bar_ts", F.window("ts", every).start)
    return first_per(binned, ["symbol", "bar_ts"], order).select(*binned.columns)


def first_exit(
    positions: DataFrame, signals: DataFrame, min_confidence: float = EXIT_CONFIDENCE
) -> DataFrame:
    """The first later signal of the opposite side that is confident enough; null if none.

    A forward as-of join on (symbol, side to close), strictly after the opening.
    """
    closing = signals.where(
        (F.col("confidence") >= min_confidence) & F.col("side").isin("BUY", "SELL")
    ).select(
        "symbol",
        F.when(F.col("side") == "BUY", "SELL").otherwise("BUY").alias("side"),
        F.col("ts").alias("exit_ts"),
        F.col("confidence").alias("exit_confidence"),
    )
    closing = closing.groupBy("symbol", "side", "exit_ts").agg(
        F.max("exit_confidence").alias("exit_confidence")
    )
    probe = positions.withColumn("_after", F.timestamp_micros(F.unix_micros("open_ts") + 1))
    return asof_join(
        probe, closing, ["symbol", "side"], ["exit_ts", "exit_confidence"],
        ts="_after", right_ts="exit_ts", direction="forward",
    ).drop("_after")


def open_position_count(
    signals: DataFrame, positions: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Positions open at each signal (``open_ts <= ts < close_ts``).

    Opens count +1 and closes -1 on one time line, so no (signal, position) pair is formed.
    """
    keys = keys or ["symbol"]
    moves = positions.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("open_ts").alias("_t"), F.lit(1).alias("_d")),
                F.struct(F.col("close_ts").alias("_t"), F.lit(-1).alias("_d")),
            )
        ),
    ).where(F.col("_t").isNotNull())
    moves = moves.groupBy(*keys, "_t").agg(F.sum("_d").alias("_d"))
    line = signals.withColumn("_t", F.col("ts")).withColumn("_d", F.lit(0)).withColumn(
        "_row", F.lit(True)
    ).unionByName(moves.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    counted = running_totals(
        line, keys, F.to_date("_t"), ["_t"], {"open_positions": F.col("_d").cast("bigint")},
        range_order=True,
    )
    return counted.where(F.col("_row")).select(*signals.columns, "open_positions")


