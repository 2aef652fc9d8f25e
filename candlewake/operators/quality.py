"""Bar quality: reports, required fields, null rows, feature profiles and schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewake.operators.timeline import DAY, HOUR

OHLCV = ["open", "high", "low", "close", "volume"]


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _with_step(bars: DataFrame, keys: list[str], bucket_us: int) -> DataFrame:
    """Seconds since the previous bar of the key; null for the first and for bars without a time or key.

    Inside a bucket the previous bar is a ``lag``; the first one of a bucket follows the
    last time of the buckets before, which a table with a row per key and bucket carries.
    """
    placed = F.col("ts").isNotNull()
    for k in keys:
        placed = placed & F.col(k).isNotNull()
    at = F.unix_micros("ts")
    timed = bars.where(placed).withColumn("_b", F.floor(at / bucket_us))
    ends = timed.groupBy(*keys, "_b").agg(F.max(at).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_b")
    ends = ends.select(*keys, "_b", F.lag("_end").over(before).alias("_last"))
    inside = F.lag(at).over(Window.partitionBy(*keys, "_b").orderBy("ts"))
    stepped = timed.join(ends, [*keys, "_b"]).withColumn("_step", (at - F.coalesce(inside, "_last")) / 1e6)
    rest = bars.where(~placed).withColumn("_step", F.lit(None).cast("double"))
    return stepped.drop("_b", "_last").unionByName(rest)


def quality_report(
    bars: DataFrame, expected_seconds: int, keys: list[str] | None = None, bucket_us: int = HOUR
) -> DataFrame:
    """Counts of missing values, repeated times, inverted bars, empty volume and gaps.

    Bars without a time or key count as rows with one more missing value.
    """
    keys = keys or ["symbol"]
    missing = sum(F.col(n).isNull().cast("int") for n in [*OHLCV, "ts", *keys])
    report = (
        _with_step(bars, keys, bucket_us)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.sum(missing).cast("bigint").alias("missing_values"),
            _count_if(F.col("high") < F.col("low")).alias("inverted_bars"),
            _count_if(F.col("volume") == 0).alias("zero_volume"),
            _count_if(F.col("_step") > 1.5 * expected_seconds).alias("gaps"),
            _count_if(F.col("_step") == 0).alias("duplicate_timestamps"),
        )
    )
    bad = F.col("missing_values") + F.col("duplicate_timestamps") + F.col("inverted_bars")
    score = 1 - bad / F.greatest(F.col("total_rows"), F.lit(1))
    return report.withColumn("quality_score", score).withColumn("low_quality", score < 0.95)


def accuracy_report(bars: DataFrame, keys: list[str] | None = None, bucket_us: int = DAY) -> DataFrame:
    """Share of missing values and of gaps longer than twice the usual step."""
    keys = keys or ["symbol"]
    stepped = _with_step(bars, keys, bucket_us)
    missing = sum(F.col(n).isNull().cast("int") for n in OHLCV)
    per_step = stepped.groupBy(*keys, "_step").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(missing).alias("_missing")
    )
    usual = F.max_by(
        F.when(F.col("_step").isNotNull(), F.col("_step")),
        F.when(F.col("_step").isNotNull(), F.struct("_n", -F.col("_step"))),
    )
    whole = per_step.groupBy(*keys).agg(
        usual.alias("_usual"),
        F.sum("_n").alias("total_rows"),
        F.sum("_missing").alias("_missing"),
    )
    gaps = (
        per_step.join(whole.select(*keys, "_usual"), keys)
        .groupBy(*keys)
        .agg(F.sum(F.when(F.col("_step") > 2 * F.col("_usual"), F.col("_n")).otherwise(0)).alias("_gaps"))
    )
    missing_pct = F.col("_missing") / (F.col("total_rows") * len(OHLCV))
    gap_pct = F.col("_gaps") / F.col("total_rows")
    out = whole.join(gaps, keys).select(
        *keys, "total_rows", missing_pct.alias("missing_pct"), gap_pct.alias("gap_pct")
    )
    accuracy = 1 - (F.col("missing_pct") + F.col("gap_pct"))
    return out.withColumn("accuracy", accuracy).withColumn("valid", accuracy >= 0.98)


def split_required(df: DataFrame, required: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose required fields cast to the given types, and the rows that do not."""
    cast = df.withColumns({f"_c_{n}": F.col(n).try_cast(t) for n, t in required.items()})
    missing = F.array_compact(
        F.array(*[F.when(F.col(f"_c_{n}").isNull(), F.lit(n)) for n in required])
    )
    marked = cast.withColumn("_missing", missing)
    good = marked.where(F.size("_missing") == 0).select(
        *[F.col(f"_c_{n}").alias(n) if n in required else F.col(n) for n in df.columns]
    )
    bad = marked.where(F.size("_missing") > 0).select(
        *df.columns, F.array_join("_missing", ",").alias("missing_fields")
    )
    return good, bad


def drop_null_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=cols)


def null_row_counts(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Rows before and after dropping those with any null."""
    any_null = F.lit(False)
    for n in cols:
        any_null = any_null | F.col(n).isNull()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(~any_null).alias("rows_after"),
        F.count_if(any_null).alias("rows_dropped"),
    )


def feature_columns(df: DataFrame, excluded: list[str]) -> list[str]:
    """Every column that is not excluded, in table order."""
    skip = set(excluded)
    return [n for n in df.columns if n not in skip]


def feature_profile(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row per key and feature: position, type, nulls and range.

    Aggregated wide first and turned to rows afterwards, so the rows that are turned are
    as few as the keys.
    """
    keys = keys or ["symbol"]
    types = dict(df.dtypes)
    aggs = []
    for n in features:
        v = F.col(n).cast("double")
        aggs += [
            F.count_if(F.col(n).isNull()).alias(f"_nulls_{n}"),
            F.min(v).alias(f"_min_{n}"),
            F.max(v).alias(f"_max_{n}"),
        ]
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(n).alias("name"),
            F.lit(types[n]).alias("type"),
            F.col(f"_nulls_{n}").alias("nulls"),
            F.col(f"_min_{n}").alias("min"),
            F.col(f"_max_{n}").alias("max"),
        )
        for i, n in enumerate(features)
    ]
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.inline(F.array(*entries)))


def schema_mismatches(
    expected: DataFrame, actual: DataFrame, keys: list[str] | None = None, limit: int = 10
) -> DataFrame:
    """First positions per key at which two feature profiles disagree in name or presence."""
    keys = keys or ["symbol"]
    e = expected.select(*keys, "position", F.col("name").alias("expected"))
    a = actual.select(*keys, "position", F.col("name").alias("actual"))
    both = e.join(a, [*keys, "position"], "full")
    wrong = both.where(~F.col("expected").eqNullSafe(F.col("actual")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    return wrong.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")
