"""Joins and running totals along time, without a whole key in one task.

Everything works inside (key, bucket) groups, where a bucket is a calendar period such
as a day. What a bucket needs from earlier ones is carried by a small table with one
row per key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def bucket_number(us: Column, bucket_us: int = DAY) -> Column:
    return F.floor(us / F.lit(bucket_us)).cast("bigint")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    cols: list[str],
    ts: str = "ts",
    right_ts: str = "ts",
    direction: str = "backward",
    bucket_us: int = DAY,
    tie: list[str] | None = None,
) -> DataFrame:
    """Attach ``cols`` of the nearest right row at or before (``forward``: after) each left row.

    The last right row of earlier buckets enters a bucket as one extra row, so a match
    may lie any number of buckets away. Of right rows of one time the last by ``tie`` counts.
    """
    row = {"_m": F.struct(*[F.col(n).alias(n) for n in cols])}
    out = asof_cells(left, right, keys, row, ts, right_ts, direction, bucket_us, tie)
    return out.select(*left.columns, *[F.col(f"_m.{n}").alias(n) for n in cols])


def asof_cells(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    cells: dict[str, Column],
    ts: str = "ts",
    right_ts: str = "ts",
    direction: str = "backward",
    bucket_us: int = DAY,
    tie: list[str] | None = None,
) -> DataFrame:
    """Attach to each left row the nearest value of each of ``cells`` that is not null.

    The cells are expressions over ``right`` and are looked up one by one, in one pass.
    """
    sign = 1 if direction == "backward" else -1
    at = micros(ts) * sign
    rat = micros(right_ts) * sign
    bucket = lambda t: bucket_number(t, bucket_us)
    order = {f"_o{i}": F.col(n) for i, n in enumerate(tie or [])}
    r = right.select(
        *keys, rat.alias("_t"), *[c.alias(n) for n, c in order.items()], *[c.alias(n) for n, c in cells.items()]
    ).withColumn("_b", bucket(F.col("_t")))
    lt = left.withColumn("_t", at).withColumn("_b", bucket(F.col("_t")))

    rank = F.struct("_t", *order)
    ends = r.groupBy(*keys, "_b").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), rank)).alias(n) for n in cells]
    )
    wanted = lt.select(*keys, "_b").distinct()
    per_bucket = ends.unionByName(wanted, allowMissingColumns=True).groupBy(*keys, "_b").agg(
        *[F.first(n, ignorenulls=True).alias(n) for n in cells]
    )
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        *keys, "_b", *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in cells]
    ).where(" OR ".join(f"`{n}` IS NOT NULL" for n in cells))

    line = (
        lt.withColumn("_side", F.lit(2))
        .unionByName(r.withColumn("_side", F.lit(1)), allowMissingColumns=True)
        .unionByName(
            carried.withColumn("_side", F.lit(0)).withColumn("_t", F.lit(None).cast("bigint")),
            allowMissingColumns=True,
        )
    )
    w = (
        Window.partitionBy(*keys, "_b")
        .orderBy(F.col("_t").asc_nulls_first(), "_side", *order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        line.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in cells})
        .where(F.col("_side") == 2)
        .select(*left.columns, *cells)
    )


def running_totals(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[str | Column],
    sums: dict[str, Column],
    range_order: bool = False,
) -> DataFrame:
    """Inclusive running sums along each key.

    With ``range_order`` rows that tie in ``order`` share one total.
    """
    tagged = df.withColumn("_b", bucket).withColumns({f"_v_{n}": x for n, x in sums.items()})
    per_bucket = tagged.groupBy(*keys, "_b").agg(
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums]
    )
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
    )
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    w = (
        w.rangeBetween(Window.unboundedPreceding, 0)
        if range_order
        else w.rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = tagged.join(carried, [*keys, "_b"])
    inside = joined.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(w) for n in sums})
    return inside.select(
        *df.columns,
        *[(F.col(f"_c_{n}") + F.coalesce(F.col(f"_i_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def into_buckets(marks: DataFrame, before_us: int, after_us: int, bucket_us: int) -> DataFrame:
    """Copy each mark into every bucket its window touches; the window has a fixed length."""
    first = bucket_number(F.col("_te") - before_us, bucket_us)
    last = bucket_number(F.col("_te") + after_us, bucket_us)
    return marks.withColumn("_b", F.explode(F.sequence(first, last)))


def around_events(
    rows: DataFrame,
    events: DataFrame,
    keys: list[str],
    before_us: int,
    after_us: int,
    ts: str = "ts",
    event_ts: str = "ts",
    weight: str | None = None,
    decay_per_hour: float = 0.0,
    bucket_us: int = DAY,
    salts: int = 1,
) -> DataFrame:
    """Time to the nearest event on both sides and the decayed sum of recent weights.

    Adds ``_prev`` (latest event at or before the row, not ``after_us`` or more old),
    ``_next`` (earliest later event, at most ``before_us`` away), both in microseconds,
    and ``_decayed = sum(weight * exp(-decay * hours since))`` over the events of the
    last ``after_us``.

    Events of one key and instant are added up first. Then each enters the buckets that
    its window touches twice, once with its weight and once, when its window ends, with
    the weight taken back. A running sum over rows and marks gives the decayed sum, so
    the cost is linear and no (row, event) pair is ever formed.

    Rows do not affect each other, so ``salts`` may split a crowded (key, bucket) into
    that many groups, each with its own copy of the bucket's few marks.
    """
    w_col = F.col(weight) if weight else F.lit(0.0)
    merged = events.groupBy(*keys, micros(event_ts).alias("_te")).agg(F.sum(w_col).alias("_w"))
    placed = into_buckets(merged, before_us, after_us, bucket_us)
    columns = rows.columns
    if salts > 1:
        keys = [*keys, "_salt"]
        placed = placed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        spread = F.pmod(F.xxhash64(*[F.col(n) for n in columns]), F.lit(salts))
        rows = rows.withColumn("_salt", spread.cast("int"))
    hours = lambda us: (us - F.col("_b") * bucket_us) / F.lit(float(HOUR))
    grown = F.col("_w") * F.exp(decay_per_hour * hours(F.col("_te")))
    starts = placed.select(
        *keys, "_b", F.col("_te").alias("_t"), F.lit(0).alias("_side"), "_te",
        grown.alias("_g"), F.lit(1).alias("_on"),
    )
    ends = placed.select(
        *keys, "_b", (F.col("_te") + after_us).alias("_t"), F.lit(0).alias("_side"),
        F.lit(None).cast("bigint").alias("_te"), (-grown).alias("_g"), F.lit(-1).alias("_on"),
    )
    bars = (
        rows.withColumn("_t", micros(ts))
        .withColumn("_b", bucket_number(F.col("_t"), bucket_us))
        .withColumn("_side", F.lit(1))
    )
    line = bars.unionByName(starts.unionByName(ends), allowMissingColumns=True)
    group = Window.partitionBy(*keys, "_b")
    up = group.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    down = group.orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    swept = line.withColumns(
        {
            "_before": F.last("_te", ignorenulls=True).over(up),
            "_sum": F.sum("_g").over(up),
            "_live": F.sum("_on").over(up),
        }
    ).withColumn("_after", F.last("_te", ignorenulls=True).over(down))
    age = F.col("_t") - F.col("_before")
    wait = F.col("_after") - F.col("_t")
    return swept.where(F.col("_side") == 1).select(
        *columns,
        F.when(age < after_us, age).alias("_prev"),
        F.when(wait <= before_us, wait).alias("_next"),
        F.when(
            F.col("_live") > 0, F.col("_sum") * F.exp(-decay_per_hour * hours(F.col("_t")))
        )
        .otherwise(0.0)
        .alias("_decayed"),
    )


def event_proximity(
    bars: DataFrame,
    events: DataFrame,
    keys: list[str] | None = None,
    surprise: str = "surprise_zscore",
    pre_hours: int = 24,
    post_hours: int = 48,
    decay: float = 0.1,
    bucket_us: int = DAY,
    salts: int = 1,
) -> DataFrame:
    """``tau_pre``, ``tau_post`` and ``weighted_surprise`` of every bar; zero without events.

    Events without a surprise value do not count at all. Bars of a symbol are grouped by
    ``bucket_us``, which ``salts`` splits further where a group is crowded.
    """
    keys = keys or ["symbol"]
    known = events.where(F.col(surprise).isNotNull())
    near = around_events(
        bars, known, keys, pre_hours * HOUR, post_hours * HOUR, weight=surprise,
        decay_per_hour=decay, bucket_us=bucket_us, salts=salts,
    )
    h = float(HOUR)
    return near.select(
        *bars.columns,
        F.coalesce(1.0 / (1.0 + F.col("_next") / h / pre_hours), F.lit(0.0)).alias("tau_pre"),
        F.coalesce(F.exp(-decay * F.col("_prev") / h), F.lit(0.0)).alias("tau_post"),
        F.col("_decayed").alias("weighted_surprise"),
    )


def outside_blackout(
    rows: DataFrame,
    events: DataFrame,
    keys: list[str] | None = None,
    before_min: int = 30,
    after_min: int = 30,
    bucket_us: int = HOUR,
) -> DataFrame:
    """Rows with no event of their key within the given minutes on either side, ends included.

    Each event is listed under the hours it blocks, which makes the range an equality on
    the hour with an exact check behind it: a join, which Spark can split where an hour is
    crowded. Without ``keys`` every event blocks all rows.
    """
    keys = keys or []
    minute = 60_000_000
    times = events.select(*keys, micros("ts").alias("_te")).distinct()
    # An event blocks the rows from before_min ahead of it to after_min past it.
    marks = into_buckets(times, before_min * minute, after_min * minute, bucket_us)
    marks = marks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_te", "_b")
    at = micros(rows["ts"])
    near = (
        (bucket_number(at, bucket_us) == F.col("_b"))
        & (at >= F.col("_te") - before_min * minute)
        & (at <= F.col("_te") + after_min * minute)
    )
    for k in keys:
        near = near & (rows[k] == F.col(f"_k_{k}"))
    return rows.join(marks, near, "left_anti")


def with_grid(
    bars: DataFrame, step_seconds: int, keys: list[str] | None = None
) -> DataFrame:
    """Every expected time between the first and last bar of a key.

    The day list of a key is as long as its calendar; the steps of a day are made in
    parallel afterwards.
    """
    keys = keys or ["symbol"]
    span = bars.groupBy(*keys).agg(
        F.unix_seconds(F.min("ts")).alias("_lo"), F.unix_seconds(F.max("ts")).alias("_hi")
    )
    day = max(86400 // step_seconds * step_seconds, step_seconds)
    chunks = span.withColumn("_c", F.explode(F.sequence("_lo", "_hi", F.lit(day).cast("bigint"))))
    last = F.least(F.col("_hi"), F.col("_c") + day - step_seconds)
    steps = F.explode(F.sequence("_c", last, F.lit(step_seconds).cast("bigint")))
    return (
        chunks.repartition(*keys, "_c")
        .select(*keys, steps.alias("_s"))
        .select(*keys, F.timestamp_seconds("_s").alias("ts"))
    )


def fill_gaps(
    bars: DataFrame,
    step_seconds: int,
    cols: list[str],
    method: str = "ffill",
    keys: list[str] | None = None,
) -> DataFrame:
    """Bars on the regular grid and at their own times, missing cells filled forward, backward or by time.

    Each column is filled from its own values, so a bar with a null cell keeps the others.
    """
    keys = keys or ["symbol"]
    src = bars.select(*keys, "ts", *cols)
    grid = with_grid(bars, step_seconds, keys).union(bars.select(*keys, "ts")).distinct()
    if method in ("ffill", "bfill"):
        way = "backward" if method == "ffill" else "forward"
        return asof_cells(grid, src, keys, {n: F.col(n) for n in cols}, direction=way)
    cell = lambda n: F.when(F.col(n).isNotNull(), F.struct(micros("ts").alias("t"), F.col(n).alias("v")))
    near = asof_cells(grid, src, keys, {f"_a_{n}": cell(n) for n in cols})
    near = asof_cells(near, src, keys, {f"_z_{n}": cell(n) for n in cols}, direction="forward")

    def between(n: str) -> Column:
        a, z = F.col(f"_a_{n}"), F.col(f"_z_{n}")
        part = F.try_divide(micros("ts") - a["t"], z["t"] - a["t"])
        return F.coalesce(a["v"] + (z["v"] - a["v"]) * part, a["v"])

    return near.select(*keys, "ts", *[between(n).alias(n) for n in cols])
