"""Walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Window lengths in months and the smallest training set.
TRAIN_MONTHS, STEP_MONTHS, TEST_MONTHS = 6, 2, 2
MIN_TRAIN_ROWS = 3000


def fold_bounds(
    df: DataFrame,
    keys: list[str],
    train_months: int = TRAIN_MONTHS,
    step_months: int = STEP_MONTHS,
    test_months: int = TEST_MONTHS,
    rolling: bool = False,
) -> DataFrame:
    """One row per key and fold with its periods; a key has as many folds as its calendar allows."""
    span = df.groupBy(*keys).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    months = F.ceil(F.months_between("_hi", "_lo")).cast("int")
    steps = F.greatest(F.floor((months - train_months) / step_months).cast("int") + 1, F.lit(0))
    day = lambda n: F.col("_lo") + F.make_ym_interval(F.lit(0), n)
    rows = span.withColumn("fold", F.explode(F.sequence(F.lit(0), steps)))
    offset = F.col("fold") * step_months
    out = rows.select(
        *keys,
        (F.col("fold") + 1).alias("fold"),
        (day(offset) if rolling else F.col("_lo")).alias("train_start"),
        day(offset + train_months).alias("test_start"),
        day(offset + train_months + test_months).alias("test_end"),
        "_hi",
    )
    return out.where((F.col("test_start") < F.col("_hi")) & (F.col("test_end") <= F.col("_hi"))).drop("_hi")


def assign_folds(df: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with each fold they belong to and their role in it.

    The folds of a key travel as one small array, so rows are never joined fold by fold.
    """
    packed = bounds.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("fold", "train_start", "test_start", "test_end"))).alias("_f")
    )
    t = F.col("ts")
    joined = df.join(packed, keys)
    hit = F.filter(
        "_f", lambda f: (t >= f["train_start"]) & (t < f["test_end"])
    )
    role = F.when(t < F.col("_h.test_start"), "train").otherwise("test")
    return (
        joined.withColumn("_h", F.explode(hit))
        .withColumns({"fold": F.col("_h.fold"), "role": role})
        .drop("_f", "_h")
    )


def fold_sizes(
    df: DataFrame, keys: list[str], min_train_rows: int = MIN_TRAIN_ROWS, **lengths: int
) -> DataFrame:
    """Usable folds with their row counts; the list ends before the first one that is too small."""
    bounds = fold_bounds(df, keys, **lengths)
    # Rows are counted by time first; what is laid beside the folds is a row per key and time step.
    packed = bounds.groupBy(*keys).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("train_start", "test_start", "test_end"))))).alias("_at")
    )
    passed = F.size(F.filter("_at", lambda t: t <= F.col("ts")))
    steps = df.join(packed, keys).groupBy(*keys, passed.alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    steps = steps.groupBy(*keys).agg(F.collect_list(F.struct("_step", "_n")).alias("_steps"))
    number = lambda c: F.array_position("_at", F.col(c)).cast("int")
    between = lambda a, b: F.aggregate(
        F.filter("_steps", lambda s: (s["_step"] >= number(a)) & (s["_step"] < number(b))),
        F.lit(0).cast("bigint"),
        lambda n, s: n + s["_n"],
    )
    sized = bounds.join(packed, keys).join(steps, keys).select(
        *bounds.columns,
        between("train_start", "test_start").alias("train_rows"),
        between("test_start", "test_end").alias("test_rows"),
    )
    upto = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    return (
        sized.withColumn("_min", F.min("train_rows").over(upto))
        .where(F.col("_min") >= min_train_rows)
        .drop("_min")
    )
