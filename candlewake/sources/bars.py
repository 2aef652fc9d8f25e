"""Readers and normalisers for bars and scoring messages."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.functions.gates import pair_name
from candlewake.operators.resample import first_per
from candlewake.schema import BAR, NESTED_CANDLES, SCORING_REQUEST, SCORING_RESPONSE

OHLCV = ["open", "high", "low", "close", "volume"]
MIN_REQUEST_BARS = 250


def read_bars(
    spark: SparkSession,
    path: str,
    timeframe: str | None = None,
    symbols: list[str] | None = None,
    snapshot: str | None = None,
) -> DataFrame:
    """Bars from a table partitioned by timeframe and symbol.

    ``snapshot='latest'`` keeps the newest ``snapshot_date`` partition, which the names of the folders
    tell. Filters reach the partition columns, so other partitions are not listed for reading. A
    symbol asked for without any bars is an error.
    """
    schema = BAR if snapshot is None else BAR + ", snapshot_date string"
    df = spark.read.schema(schema).parquet(path)
    if timeframe:
        df = df.where(F.col("timeframe") == timeframe)
    if symbols:
        df = df.where(F.col("symbol").isin(*symbols))
    if snapshot == "latest":
        df = df.where(F.col("snapshot_date") == newest_snapshot(spark, path, timeframe, symbols))
    elif snapshot:
        df = df.where(F.col("snapshot_date") == snapshot)
    return require_symbols(df, symbols) if symbols else df


def newest_snapshot(
    spark: SparkSession, path: str, timeframe: str | None = None, symbols: list[str] | None = None
) -> str | None:
    """The largest ``snapshot_date`` among the partition folders of ``path``, wherever it stands among them."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest = None
    for above in ("", "/*", "/*/*"):
        for found in files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}{above}/snapshot_date=*")) or ():
            of = dict(unquote(x).split("=", 1) for x in found.getPath().toString().split("/") if "=" in x)
            wanted = of.get("timeframe") in (None, timeframe or of.get("timeframe"))
            wanted &= not symbols or of.get("symbol") is None or of["symbol"] in symbols
            if wanted and (newest is None or of["snapshot_date"] > newest):
                newest = of["snapshot_date"]
    return newest


def require_symbols(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Fail if a configured symbol has no bars; the check reads one row per symbol."""
    found = {
        r[0] for r in symbol_catalogue(bars.where(F.col("symbol").isin(*symbols))).collect()
    }
    absent = sorted(set(symbols) - found)
    if absent:
        raise FileNotFoundError(f"no bars for {', '.join(absent)}")
    return bars.where(F.col("symbol").isin(*symbols))


def read_bar_files(spark: SparkSession, pattern: str, timeframe: str) -> DataFrame:
    """Bars from files named ``<symbol>_<timeframe>...``; the symbol comes from the name."""
    columns = "ts timestamp, open double, high double, low double, close double, volume bigint"
    df = spark.read.schema(columns).parquet(pattern)
    stem = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/=]+)_{timeframe}[^/]*(?:/[^/]*)?$", 1)
    return df.select(
        pair_name(F.replace(stem, F.lit("_"), F.lit(""))).alias("symbol"),
        F.lit(timeframe).alias("timeframe"),
        "ts",
        *OHLCV,
    )


def symbol_catalogue(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct().orderBy("symbol")


def flatten_candles(raw: DataFrame, json: str = "body", keys: list[str] | None = None) -> DataFrame:
    """Bars from nested candle messages; candles that are not complete are left out."""
    keys = keys or ["symbol"]
    parsed = raw.select(*keys, F.from_json(json, NESTED_CANDLES).alias("_p"))
    return (
        parsed.select(*keys, F.inline("_p.candles"))
        .where(F.coalesce("complete", F.lit(True)))
        .select(
            *keys,
            F.try_to_timestamp("time").alias("ts"),
            F.col("mid.o").try_cast("double").alias("open"),
            F.col("mid.h").try_cast("double").alias("high"),
            F.col("mid.l").try_cast("double").alias("low"),
            F.col("mid.c").try_cast("double").alias("close"),
            F.coalesce("volume", F.lit(0)).alias("volume"),
        )
    )


def normalise_rates(rates: DataFrame, arrival: list[str], keys: list[str] | None = None) -> DataFrame:
    """Bars from broker rates; of rows with the same time the first to arrive stays."""
    keys = keys or ["symbol"]
    kept = first_per(rates, [*keys, "time"], arrival)
    return kept.select(
        *keys,
        F.timestamp_seconds("time").alias("ts"),
        "open",
        "high",
        "low",
        "close",
        F.col("tick_volume").alias("volume"),
    )


def parse_requests(raw: DataFrame, json: str = "body", key: str = "request_id") -> DataFrame:
    return raw.select(key, F.from_json(json, SCORING_REQUEST).alias("r")).select(key, "r.*")


FRAMES = {"M5": "ohlcv_m5", "H1": "ohlcv_h1", "H4": "ohlcv_h4"}


def _accepted(min_bars: int) -> Column:
    ok = F.col("pair").isNotNull() & F.col("events").isNotNull()
    for n in FRAMES.values():
        ok = ok & (F.coalesce(F.size(n), F.lit(0)) >= min_bars)
    return ok


def request_rejects(requests: DataFrame, key: str = "request_id", min_bars: int = MIN_REQUEST_BARS) -> DataFrame:
    """Requests that cannot be scored, with the reason."""
    frames = list(FRAMES.values())
    missing = F.array_compact(
        F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in ["pair", *frames, "events"]])
    )
    short = F.array_compact(
        F.array(*[F.when(F.size(n) < min_bars, F.lit(n)) for n in frames])
    )
    reason = F.when(
        F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))
    ).when(F.size(short) > 0, F.concat(F.lit("too few bars in "), F.array_join(short, ",")))
    return requests.select(key, "pair", reason.alias("reason")).where(F.col("reason").isNotNull())


def request_bars(requests: DataFrame, key: str = "request_id", min_bars: int = MIN_REQUEST_BARS) -> DataFrame:
    """Bar rows of the requests that pass; validity is a property of the row, no join needed."""
    frames = FRAMES

    def tag(name: str, timeframe: str) -> Column:
        named = lambda b: F.struct(F.lit(timeframe).alias("timeframe"), b.alias("bar"))
        return F.transform(name, named)

    tagged = F.concat(*[tag(n, tf) for tf, n in frames.items()])
    return (
        requests.where(_accepted(min_bars))
        .select(key, F.col("pair").alias("symbol"), F.inline(tagged))
        .select(
            key, "symbol", "timeframe", F.timestamp_seconds("bar.time").alias("ts"),
            *[F.col(f"bar.{n}").alias(n) for n in OHLCV],
        )
    )


def request_events(requests: DataFrame, key: str = "request_id", min_bars: int = MIN_REQUEST_BARS) -> DataFrame:
    """Event rows of the requests that pass."""
    return requests.where(_accepted(min_bars)).select(key, F.inline("events")).withColumn(
        "ts", F.timestamp_seconds("time")
    ).drop("time")


def parse_responses(raw: DataFrame, json: str = "body", keys: list[str] | None = None) -> DataFrame:
    """Direction and confidence from a scoring response; no label means HOLD."""
    keys = keys or []
    codes = F.create_map(F.lit("BUY"), F.lit(1), F.lit("SELL"), F.lit(-1), F.lit("HOLD"), F.lit(0))
    r = raw.select(*keys, F.from_json(json, SCORING_RESPONSE).alias("r"))
    label = F.coalesce(F.col("r.prediction"), F.lit("HOLD"))
    zero = F.lit(0.0)
    return r.select(
        *keys,
        label.alias("prediction"),
        F.coalesce(F.try_element_at(codes, label), F.lit(0)).alias("direction"),
        F.coalesce("r.confidence", zero).alias("confidence"),
        *[
            F.coalesce(f"r.probabilities.{n}", zero).alias(f"p_{n.lower()}")
            for n in ("BUY", "SELL", "HOLD")
        ],
    )
