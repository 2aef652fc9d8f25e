"""Stand-ins for market data, built from the given tables.

Each function has a SQL twin in :mod:`candlewake.plans.sqltext` under the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.functions.scoring import class_name
from candlewake.operators.resample import ticks_to_bars
from candlewake.schema import CURRENCY_COUNTRY, PAIRS
from candlewake.session import configure, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table with naive timestamps read as UTC instants."""
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(field, F.col(field).cast("timestamp"))
    return df


def pair_of(key: str):
    """One of the configured pairs, by the remainder of ``key``."""
    names = F.array(*[F.lit(p) for p in PAIRS])
    return F.element_at(names, (F.col(key) % len(PAIRS) + 1).cast("int"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price ticks from line items."""
    return table(spark, sf_dir, "lineitem").select(
        pair_of("l_suppkey").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of eight pairs."""
    order = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return ticks_to_bars(trades(spark, sf_dir), "1 day", order)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday ticks of five symbols from the event log."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        (1 + F.col("value") / 100).alias("price"),
        F.lit(1).alias("size"),
        "event_id",
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of eight pairs from the event log, with natural gaps."""
    t = ticks(spark, sf_dir).withColumn("symbol", pair_of("user_id"))
    return ticks_to_bars(t, "1 hour", ["ts", "event_id"])


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar events from purchases."""
    countries = F.array(*[F.lit(c) for c in CURRENCY_COUNTRY.values()])
    t = ticks(spark, sf_dir).where(F.col("symbol") == "purchase")
    return t.select(
        "event_id",
        "ts",
        F.concat(F.lit("release "), F.col("user_id") % 6).alias("event_name"),
        F.element_at(countries, (F.col("user_id") % 8 + 1).cast("int")).alias("country"),
        F.col("value").alias("actual_value"),
        F.col("k").cast("double").alias("consensus_forecast"),
        (F.col("event_id") % 100).cast("double").alias("previous_value"),
        (F.col("event_id") % 3 + 1).cast("int").alias("impact_level"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated texts per currency from documents."""
    currencies = F.array(*[F.lit(c) for c in CURRENCY_COUNTRY])
    seconds = F.lit(1704067200) + F.col("doc_id") % 30 * 86400 + F.col("doc_id") % 24 * 3600
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.timestamp_seconds(seconds).alias("ts"),
        F.element_at(currencies, (F.col("doc_id") % 8 + 1).cast("int")).alias("currency"),
        "text",
        "lang",
    )


def symbol_number():
    names = F.array(*[F.lit(p) for p in PAIRS])
    return F.array_position(names, F.col("symbol"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities for every daily bar, by plain arithmetic on day and symbol.

    Written once for each session and folder, as a scoring job would: otherwise filters on
    the probabilities move below the bar aggregate and are evaluated for every tick.
    """
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _predictions:
        _predictions[known] = stage(_scored(spark, sf_dir), "predictions")
    return _predictions[known]


_predictions: dict[tuple[str, str], DataFrame] = {}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.unix_date(F.to_date("ts"))
    s = symbol_number()
    raw = lambda a, b: 1 + (d * a + s * b) % 11
    w = bars(spark, sf_dir).select(
        "symbol", "ts", "close",
        raw(7, 13).alias("_b"), raw(5, 7).alias("_s"), raw(3, 11).alias("_h"),
    )
    b, s_, h = F.col("_b"), F.col("_s"), F.col("_h")
    cube = lambda x: (x * x * x).cast("double")
    total = cube(b) + cube(s_) + cube(h)
    cls = F.when((b >= s_) & (b >= h), 0).when(s_ >= h, 1).otherwise(2)
    out = w.select(
        "symbol",
        "ts",
        "close",
        (cube(b) / total).alias("pred_buy_prob"),
        (cube(s_) / total).alias("pred_sell_prob"),
        (cube(h) / total).alias("pred_hold_prob"),
        cls.alias("predicted_class"),
        (cube(F.greatest(b, s_, h)) / total).alias("confidence"),
        class_name(cls).alias("signal"),
    )
    return out


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed positions from orders."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("ticket"),
        pair_of("o_custkey").alias("symbol"),
        F.when(key % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.col("o_orderdate").alias("open_ts"),
        F.timestamp_seconds(F.unix_seconds("o_orderdate") + (key % 5 + 1) * 86400).alias("close_ts"),
        (key % 201 - 100).cast("double").alias("profit"),
    )


def symbol_specs(spark: SparkSession) -> DataFrame:
    """Contract sizes of the configured pairs (a fixed dimension of eight rows)."""
    rows = []
    for i, p in enumerate(PAIRS):
        point = 0.001 if "JPY" in p else 0.00001
        rows.append((p, point, point, 1.0, 0.01, 50.0, 0.01, 20.0, 3 if "JPY" in p else 5, 1000.0, 0.5 + i))
    return spark.createDataFrame(
        rows,
        "symbol string, point double, tick_size double, tick_value double, volume_min double, "
        "volume_max double, volume_step double, stops_level double, digits int, "
        "margin_initial double, spread double",
    )
