"""Forward-return labels, chronological cuts, sequences and class shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewake.functions.scoring import pip_factor
from candlewake.operators.blocks import IDX, cut, day_of, indexed_blocks, with_row_index
from candlewake.schema import CLASS_BUY, CLASS_HOLD, CLASS_SELL


def forward_label(
    bars: DataFrame,
    bars_ahead: int,
    pip_threshold: float | None = None,
    atr_multiplier: float | None = None,
    keys: list[str] | None = None,
    bucket: Column | None = None,
    **block_sizes: int,
) -> DataFrame:
    """Buy, sell or hold by the move over the next ``bars_ahead`` bars, in pips.

    The threshold is fixed, or a multiple of ``atr_14``. ``forward_return`` is the move itself, a
    difference of prices. Bars without a future drop out.
    """
    keys = keys or ["symbol"]
    b = indexed_blocks(
        bars, keys, ["ts"], day_of("ts") if bucket is None else bucket, 0, bars_ahead, **block_sizes
    )
    out = b.add({"forward_close": F.lead("close", bars_ahead).over(b.rows)}).close()
    factor = pip_factor(F.col("symbol"))
    move = (F.col("forward_close") - F.col("close")) * factor
    limit = (
        F.lit(float(pip_threshold))
        if pip_threshold is not None
        else F.col("atr_14") * factor * atr_multiplier
    )
    target = (
        F.when(F.col("forward_return_pips") > limit, 1)
        .when(F.col("forward_return_pips") < -limit, -1)
        .otherwise(0)
    )
    return (
        out.where(F.col("forward_close").isNotNull())
        .withColumn("forward_return", F.col("forward_close") - F.col("close"))
        .withColumn("forward_return_pips", move)
        .withColumn("target", target)
        .withColumn("target_class", target_class(F.col("target")))
    )


def target_class(target: Column) -> Column:
    return (
        F.when(target == 1, CLASS_BUY).when(target == -1, CLASS_SELL).otherwise(CLASS_HOLD)
    )


def class_distribution(df: DataFrame, cls: str = "target_class", keys: list[str] | None = None) -> DataFrame:
    """Count and percent of each class."""
    keys = keys or ["symbol"]
    counts = df.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def with_cut(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, train_share: float = 0.8
) -> DataFrame:
    """``part`` is train for the first ``int(share * n)`` rows of a key, else holdout."""
    indexed = with_row_index(df, keys, order, bucket, idx="row", total="_total")
    split = F.floor(F.col("_total") * train_share)
    part = F.when(F.col("row") < split, "train").otherwise("holdout")
    return indexed.withColumn("part", part).drop("_total")


def sequences(
    df: DataFrame,
    features: list[str],
    length: int = 22,
    label: str | None = None,
    keys: list[str] | None = None,
    bucket: Column | None = None,
    **block_sizes: int,
) -> DataFrame:
    """The last ``length`` rows as one array, with the label of the last of them."""
    keys = keys or ["symbol"]
    b = indexed_blocks(
        df, keys, ["ts"], day_of("ts") if bucket is None else bucket, length, **block_sizes
    )
    rows = F.array(*[F.col(n).cast("double") for n in features])
    seq = b.add({"_row": rows}).add
    b = seq({"sequence": F.collect_list("_row").over(b.last(length))})
    full_only = b.with_df(b.df.where(F.col(IDX) >= length - 1))
    return full_only.close().select(*keys, "ts", "sequence", *([label] if label else []))


#: Spark limits ranks before a shuffle up to this number (spark.sql.optimizer.windowGroupLimitThreshold).
RANKED = 1000


def latest_rows(df: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The last ``n`` rows per key.

    Up to ``RANKED`` rows the rank is limited before the shuffle; more are cut by position,
    so that no task sorts a whole key.
    """
    keys = keys or ["symbol"]
    if n > RANKED:
        placed = with_row_index(df, keys, ["ts"], F.to_date("ts"), idx="_at", total="_of")
        return placed.where(F.col("_at") >= F.col("_of") - n).drop("_at", "_of")
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def time_series_folds(
    df: DataFrame, n_splits: int, keys: list[str], order: list[str], bucket: Column
) -> DataFrame:
    """Test fold of each row: equal test sizes at the end, everything before is training.

    Fold ``i`` trains on the rows with ``row < test_start(i)``. Rows before the first
    test fold get fold -1.
    """
    indexed = with_row_index(df, keys, order, bucket, idx="row", total="_total")
    size = F.floor(F.col("_total") / (n_splits + 1))
    first = F.col("_total") - n_splits * size
    fold = F.when(F.col("row") < first, -1).otherwise(F.floor(F.try_divide(F.col("row") - first, size)))
    return indexed.withColumn("fold", fold.cast("int")).drop("_total")


__all__ = [
    "class_distribution",
    "cut",
    "forward_label",
    "latest_rows",
    "sequences",
    "target_class",
    "time_series_folds",
    "with_cut",
]
