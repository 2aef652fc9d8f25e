"""The feature job: base features, higher timeframes, events, sentiment, clean rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewake.operators import indicators as ind
from candlewake.operators import sentiment, timeline
from candlewake.operators.blocks import BLOCK_ROWS
from candlewake.operators.resample import resample
from candlewake.session import stage


def htf_columns(timeframe: str) -> list[str]:
    flags = [f"regime_{x}_{timeframe}" for x in ("trending", "ranging", "bullish", "bearish")]
    return [f"{n}_{timeframe}" for n in ind.HTF_NAMES] + flags


def add_higher_timeframes(
    bars: DataFrame,
    timeframes: dict[str, str],
    closed_only: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Attach the last row of each longer timeframe at or before every bar.

    Bars are stamped with their opening time, so by default a bar sees the running longer
    bar; ``closed_only`` shifts the longer bars to their closing time.
    """
    if not timeframes:
        return bars
    # Bars and longer bars are each read several times below: written once, they are made once.
    out = bars = stage(bars, "bars")
    for name, every in timeframes.items():
        htf = ind.htf_features(resample(bars, every), name, block_rows)
        if closed_only:
            htf = htf.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {every}"))
        htf = stage(htf.select("symbol", "ts", *htf_columns(name)), f"bars-{name}")
        out = timeline.asof_join(out, htf, ["symbol"], htf_columns(name))
    return stage(out, "bars-joined")


def feature_table(
    bars: DataFrame,
    timeframes: dict[str, str],
    events: DataFrame | None = None,
    daily_sentiment: DataFrame | None = None,
    closed_only: bool = False,
    drop_lookahead: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Feature rows of all symbols, in contract order, without incomplete rows.

    The joins run on the narrow bar table before the indicators, so their columns ride
    through the one shuffle of the indicator job.
    """
    out = add_higher_timeframes(bars, timeframes, closed_only, block_rows)
    names = [n for tf in timeframes for n in htf_columns(tf)]
    if events is not None:
        out = timeline.event_proximity(out, events)
    else:
        out = out.withColumns(
            {n: F.lit(0.0) for n in ("tau_pre", "tau_post", "weighted_surprise")}
        )
    names += ["tau_pre", "tau_post", "weighted_surprise"]
    if daily_sentiment is not None:
        before = out.columns
        out = sentiment.attach_daily(out, daily_sentiment)
        names += [n for n in out.columns if n not in before]
    out = ind.base_features(out, block_rows=block_rows, drop_lookahead=drop_lookahead)
    base = [n for n in out.columns if n in set(ind.BASE_FEATURES + ind.CROSS_FEATURES)]
    return out.select(*bars.columns, *base, *names).dropna(how="any")
