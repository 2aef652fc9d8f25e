"""Writers, and the manifest of what lies in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.schema import TRADE_LOG

FILE_ROWS = 5_000_000


def write_bars(bars: DataFrame, path: str) -> None:
    """One folder per timeframe and symbol.

    Rows are spread by month as well, so a large symbol is written by many tasks, and a
    file holds a bounded number of rows.
    """
    spread = bars.repartition("timeframe", "symbol", F.trunc("ts", "month"))
    (
        spread.write.mode("overwrite")
        .partitionBy("timeframe", "symbol")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_ROWS)
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_trade_log(trades: DataFrame, path: str) -> None:
    """Add orders to the log, one folder per month."""
    fields = [f.split()[0] for f in TRADE_LOG.split(", ")]
    trades.select(*fields).withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode(
        "append"
    ).partitionBy("month").parquet(path)


def read_trade_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRADE_LOG + ", month string").parquet(path)


def write_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").json(path)


def manifest(spark: SparkSession, paths: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Files, bytes, rows and time range of each named dataset.

    ``paths`` maps a name to its path and its time column (or none).
    """
    out = None
    for name, (path, ts) in paths.items():
        when = F.col(ts).cast("timestamp") if ts else F.lit(None).cast("timestamp")
        per_file = (
            spark.read.parquet(path)
            .select(
                F.col("_metadata.file_path").alias("_f"),
                F.col("_metadata.file_size").alias("_s"),
                when.alias("_t"),
            )
            .groupBy("_f")
            .agg(
                F.first("_s").alias("_s"),
                F.count(F.lit(1)).alias("_n"),
                F.min("_t").alias("_lo"),
                F.max("_t").alias("_hi"),
            )
        )
        one = per_file.agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("_s").alias("bytes"),
            F.sum("_n").alias("rows"),
            F.min("_lo").alias("min_ts"),
            F.max("_hi").alias("max_ts"),
        ).select(F.lit(name).alias("dataset"), "*")
        out = one if out is None else out.unionByName(one)
    return out
