"""Positioning reports: the net position against its range over a trailing number of weeks.

The range is taken over the weeks before a report, from one row of extrema for each week, and
over its own week so far. So no task holds more of a key than a week of reports, and what is
ordered along a key is one row for each week.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewake.operators.timeline import asof_join

# Fixed value: weeks of the range, the report's own week included.
WEEKS = 156
COLUMNS = ["net_position", "position_index"]


def positioning(reports: DataFrame, keys: list[str], ts: str = "ts", weeks: int = WEEKS) -> DataFrame:
    """Reports (``long, short, open_interest``) with ``net_position`` and ``position_index``.

    The net position is (long - short) / open interest. The index is where it lies between
    the least (0) and the greatest (1) of its range: all reports of the key up to its time, as
    far back as the start of the week ``weeks - 1`` before its own. Weeks of seven days are
    counted from 1 January 1970. Both are null without open interest, the index also where
    the range has no width. Reports of one time see each other. Rows without a key or time
    have no place and drop out.
    """
    placed = reports.dropna(subset=[*keys, ts]).withColumns({
        "net_position": F.try_divide(F.col("long").cast("double") - F.col("short"), F.col("open_interest").cast("double")),
        "_week": F.floor(F.unix_date(F.to_date(ts)) / 7),
    })
    by_week = placed.groupBy(*keys, "_week").agg(F.min("net_position").alias("_low"), F.max("net_position").alias("_high"))
    before = Window.partitionBy(*keys).orderBy("_week").rangeBetween(-(weeks - 1), -1)
    past = by_week.select(*keys, "_week", F.min("_low").over(before).alias("_low"), F.max("_high").over(before).alias("_high"))
    so_far = Window.partitionBy(*keys, "_week").orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumns({
        "_own_low": F.min("net_position").over(so_far), "_own_high": F.max("net_position").over(so_far),
    })
    low, high = F.least("_low", "_own_low"), F.greatest("_high", "_own_high")
    index = F.try_divide(F.col("net_position") - low, high - low)
    out = own.join(past, [*keys, "_week"]).withColumn("position_index", index)
    return out.select(*reports.columns, *COLUMNS)


def positioning_on_bars(bars: DataFrame, positions: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Each bar with the latest report at or before it; null before a key's first report.

    Of reports of one time the one of the greatest index counts.
    """
    return asof_join(bars, positions, keys, COLUMNS, ts=ts, right_ts=ts, tie=["position_index", "net_position"])
