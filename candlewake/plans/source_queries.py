"""Queries that go through the readers, normalisers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.functions import scoring
from candlewake.plans import inputs
from candlewake.plans import sqltext as q
from candlewake.plans.registry import Registry, rounded
from candlewake.session import fresh_path
from candlewake.sources import bars as bar_source
from candlewake.sources import feeds, sinks

R = Registry()


def _iso(ts: str) -> object:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


@R.add(
    f"""{q.with_(q.BARS)} SELECT symbol, '1D' AS timeframe, ts, open, high, low, close, volume FROM bars
    WHERE symbol IN ('EUR_USD', 'USD_JPY')"""
)
def bar_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Written by timeframe and symbol, two symbols read back."""
    path = fresh_path(spark, "bars")
    sinks.write_bars(inputs.bars(spark, sf).withColumn("timeframe", F.lit("1D")), path)
    out = bar_source.read_bars(spark, path, "1D", ["EUR_USD", "USD_JPY"])
    return out.select("symbol", "timeframe", "ts", *bar_source.OHLCV)


_SNAPSHOTS = ["1994-01-01", "1996-01-01", "1998-01-01"]


@R.add(
    f"""{q.with_(q.BARS)} SELECT symbol, '1D' AS timeframe, ts, open, high, low, close, volume, '{_SNAPSHOTS[-1]}' AS snapshot_date
    FROM bars WHERE ts < TIMESTAMP '{_SNAPSHOTS[-1]}'"""
)
def bar_table_newest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Three snapshots of what was known by then; the newest is read back."""
    path = fresh_path(spark, "snapshots")
    known = F.filter(F.array(*[F.lit(d) for d in _SNAPSHOTS]), lambda d: F.col("ts") < d.cast("timestamp"))
    bars = inputs.bars(spark, sf).withColumn("timeframe", F.lit("1D"))
    bars.withColumn("snapshot_date", F.explode(known)).write.partitionBy("snapshot_date", "timeframe").parquet(path)
    out = bar_source.read_bars(spark, path, "1D", snapshot="latest")
    return out.select("symbol", "timeframe", "ts", *bar_source.OHLCV, "snapshot_date")


@R.add(
    f"""{q.with_(q.BARS)} SELECT symbol, '1D' AS timeframe, ts, open, high, low, close, volume FROM bars"""
)
def bar_files_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """One folder of files per symbol, named ``EURUSD_1D``; the symbol comes from the name."""
    path = fresh_path(spark, "barfiles")
    named = inputs.bars(spark, sf).withColumn(
        "file", F.concat(F.replace("symbol", F.lit("_"), F.lit("")), F.lit("_1D"))
    )
    spread = named.drop("symbol").repartition("file", F.trunc("ts", "month"))
    spread.write.partitionBy("file").parquet(path)
    return bar_source.read_bar_files(spark, f"{path}/*_1D*", "1D")




@R.add(
    f"""{q.with_(q.BARS)} SELECT symbol, ts, open, high, low, close, CASE WHEN volume % 7 = 0 THEN 0 ELSE volume END AS volume
    FROM bars WHERE volume % 5 <> 0"""
)
def nested_candles(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly messages of nested candles, some not complete, some without volume."""
    price = lambda n: F.col(n).cast("string").alias(n[0])
    candle = F.struct(
        _iso("ts").alias("time"),
        (F.col("volume") % 5 != 0).alias("complete"),
        F.when(F.col("volume") % 7 != 0, F.col("volume")).alias("volume"),
        F.struct(price("open"), price("high"), price("low"), price("close")).alias("mid"),
    )
    raw = inputs.bars(spark, sf).groupBy("symbol", F.trunc("ts", "month").alias("m")).agg(
        F.to_json(F.struct(F.collect_list(candle).alias("candles"))).alias("body")
    )
    return bar_source.flatten_candles(raw)


@R.add(
    f"""{q.with_(q.TICKS)} SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, first(price ORDER BY event_id) AS open,
      first(price + 1 ORDER BY event_id) AS high, first(price - 1 ORDER BY event_id) AS low, first(price ORDER BY event_id) AS close,
      first(event_id % 10 ORDER BY event_id) AS volume FROM ticks GROUP BY symbol, date_trunc('hour', ts)"""
)
def broker_rates(spark: SparkSession, sf: str) -> DataFrame:
    t = inputs.ticks(spark, sf)
    rates = t.select(
        "symbol",
        (F.floor(F.unix_seconds("ts") / 3600) * 3600).alias("time"),
        F.col("price").alias("open"),
        (F.col("price") + 1).alias("high"),
        (F.col("price") - 1).alias("low"),
        F.col("price").alias("close"),
        (F.col("event_id") % 10).alias("tick_volume"),
        "event_id",
    )
    return bar_source.normalise_rates(rates, ["event_id"])


@R.add(
    f"""{q.with_(q.CALENDAR)} SELECT date_trunc('second', ts)::TIMESTAMP AS ts, country, event_name, actual_value, consensus_forecast, previous_value,
      impact_level FROM calendar WHERE impact_level >= 3"""
)
def calendar_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Daily messages of a calendar feed; minor events are left out."""
    item = F.struct(
        F.unix_seconds("ts").alias("time"),
        "country",
        F.col("event_name").alias("title"),
        F.col("actual_value").alias("actual"),
        F.col("consensus_forecast").alias("forecast"),
        F.col("previous_value").alias("previous"),
        F.col("impact_level").alias("importance"),
    )
    # A message holds an hour of a country, split by the event's number; a feed's pages are short.
    page = F.pmod(F.xxhash64("event_id"), F.lit(64))
    raw = inputs.calendar(spark, sf).groupBy(F.date_trunc("hour", "ts"), "country", page).agg(
        F.to_json(F.struct(F.collect_list(item).alias("result"))).alias("body")
    )
    return feeds.normalise_calendar(raw)


@R.add(
    f"""{q.with_(q.NEWS)} SELECT doc_id, ts, text, CASE WHEN doc_id % 2 = 0 THEN 'general' ELSE 'forex' END AS category FROM news"""
)
def news_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Landed JSON lines of two feeds."""
    n = inputs.news(spark, sf).select(
        "doc_id", F.unix_seconds("ts").alias("datetime"), F.col("text").alias("headline")
    )
    parts = []
    for i, category in enumerate(("general", "forex")):
        path = fresh_path(spark, f"news-{category}")
        n.where(F.col("doc_id") % 2 == i).write.json(path)
        landed = spark.read.schema("doc_id bigint, datetime bigint, headline string").json(path)
        parts.append(feeds.normalise_news(landed, category, ["doc_id"]))
    return parts[0].unionByName(parts[1])


@R.add(
    f"""{q.with_(q.NEWS)} SELECT ts, text FROM news WHERE doc_id % 13 <> 0
    AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"""
)
def news_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV with a column that is not read and some bad dates."""
    path = fresh_path(spark, "newscsv")
    bad = F.when(F.col("doc_id") % 13 == 0, "not a date")
    n = inputs.news(spark, sf).select(
        F.coalesce(bad, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date"),
        F.col("text").alias("title"),
    )
    sinks.write_csv(n, path)
    return feeds.read_news_csv(spark, path, "2024-01-05 00:00:00", "2024-01-20 12:00:00")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """One scoring request per symbol and year; some lack a field or bars."""
    bar = F.struct(F.unix_seconds("ts").alias("time"), *bar_source.OHLCV)
    weekday = F.dayofweek("ts") < 7
    y = F.year("ts").alias("y")
    per_year = inputs.bars(spark, sf).groupBy("symbol", y).agg(
        F.collect_list(bar).alias("ohlcv_m5"),
        F.collect_list(F.when(weekday, bar)).alias("ohlcv_h4"),
    )
    event = F.struct(
        F.lit(1704067200).alias("time"), F.lit("release").alias("event_name"),
        F.lit("US").alias("country"), F.col("y").cast("double").alias("actual"),
        F.lit(1.0).alias("forecast"), F.lit(2.0).alias("previous"),
    )
    body = F.struct(
        F.when(F.col("y") != 1997, F.col("symbol")).alias("pair"),
        "ohlcv_m5",
        F.col("ohlcv_m5").alias("ohlcv_h1"),
        F.when(F.col("y") != 1998, F.col("ohlcv_h4")).alias("ohlcv_h4"),
        F.array(event).alias("events"),
    )
    rid = F.concat_ws("-", "symbol", F.col("y").cast("string"))
    return bar_source.parse_requests(per_year.select(rid.alias("request_id"), F.to_json(body).alias("body")))


_REQ = f"""{q.with_(q.BARS)}, req AS (SELECT symbol, year(ts) AS y, symbol || '-' || year(ts) AS request_id, count(*) AS n,
  count(*) FILTER (WHERE isodow(ts) <> 6) AS n4 FROM bars GROUP BY ALL)"""


@R.add(
    f"""{_REQ}, ok AS (SELECT * FROM req WHERE y NOT IN (1997, 1998) AND n >= 250 AND n4 >= 250),
    x AS (SELECT ok.request_id, b.* FROM ok JOIN bars b ON b.symbol = ok.symbol AND year(b.ts) = ok.y)
    SELECT request_id, symbol, 'M5' AS timeframe, ts, open, high, low, close, volume FROM x
    UNION ALL SELECT request_id, symbol, 'H1', ts, open, high, low, close, volume FROM x
    UNION ALL SELECT request_id, symbol, 'H4', ts, open, high, low, close, volume FROM x WHERE isodow(ts) <> 6"""
)
def scoring_request_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bar_source.request_bars(_requests(spark, sf))


@R.add(
    f"""{_REQ} SELECT request_id, CASE WHEN y <> 1997 THEN symbol END AS pair, CASE WHEN y = 1997 THEN 'missing pair' WHEN y = 1998 THEN 'missing ohlcv_h4'
      ELSE 'too few bars in ' || concat_ws(',', CASE WHEN n < 250 THEN 'ohlcv_m5' END, CASE WHEN n < 250 THEN 'ohlcv_h1' END,
        CASE WHEN n4 < 250 THEN 'ohlcv_h4' END) END AS reason
    FROM req WHERE y IN (1997, 1998) OR n < 250 OR n4 < 250"""
)
def scoring_request_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return bar_source.request_rejects(_requests(spark, sf))


@R.add(
    f"""{_REQ} SELECT request_id, 'release' AS event_name, 'US' AS country, y::DOUBLE AS actual, TIMESTAMP '2024-01-01' AS ts FROM req
    WHERE y NOT IN (1997, 1998) AND n >= 250 AND n4 >= 250"""
)
def scoring_request_events(spark: SparkSession, sf: str) -> DataFrame:
    return bar_source.request_events(_requests(spark, sf)).select(
        "request_id", "event_name", "country", "actual", "ts"
    )


@R.add(
    f"""{q.with_(q.BARS, q.PREDICTIONS)} SELECT symbol, ts, CASE WHEN day(ts) = 1 THEN 'HOLD' ELSE signal END AS prediction,
      CASE WHEN day(ts) = 1 THEN 0 WHEN signal = 'BUY' THEN 1 WHEN signal = 'SELL' THEN -1 ELSE 0 END AS direction,
      {q.r('confidence', 6)} AS confidence, {q.r('pred_buy_prob', 6)} AS p_buy, {q.r('pred_sell_prob', 6)} AS p_sell, {q.r('pred_hold_prob', 6)} AS p_hold
    FROM predictions"""
)
def scoring_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses as JSON, some without a label."""
    p = inputs.predictions(spark, sf)
    probs = F.struct(*[F.col(f"pred_{n.lower()}_prob").alias(n) for n in ("BUY", "SELL", "HOLD")])
    body = F.to_json(
        F.struct(
            F.col("symbol").alias("pair"),
            F.when(F.dayofmonth("ts") != 1, F.col("signal")).alias("prediction"),
            "confidence",
            probs.alias("probabilities"),
        )
    )
    out = bar_source.parse_responses(p.select("symbol", "ts", body.alias("body")), keys=["symbol", "ts"])
    return rounded(out, ["confidence", "p_buy", "p_sell", "p_hold"], 6)


@R.add(f"{q.with_(q.BARS, q.PREDICTIONS)} SELECT symbol, ts, signal, predicted_class FROM predictions")
def predictions_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "predictions")
    sinks.write_csv(inputs.predictions(spark, sf).select("symbol", "ts", "signal", "predicted_class"), path)
    return spark.read.csv(
        path, schema="symbol string, ts timestamp, signal string, predicted_class int", header=True
    )


@R.add(
    f"""{q.with_(q.BARS, q.PREDICTIONS)} SELECT symbol, ts, strftime(ts, '%Y-%m') AS month, signal AS action, close AS entry, close * 0.99 AS sl, close * 1.02 AS tp
    FROM predictions WHERE signal <> 'HOLD'"""
)
def trade_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to the log, read back."""
    path = fresh_path(spark, "tradelog")
    p = inputs.predictions(spark, sf).where("signal <> 'HOLD'")
    none = F.lit(None).cast("double")
    log = p.select(
        "ts", "symbol", F.col("signal").alias("action"), "confidence", F.col("close").alias("entry"),
        (F.col("close") * 0.99).alias("sl"), (F.col("close") * 1.02).alias("tp"),
        F.lit("").alias("ob_context"), F.lit("").alias("fvg_context"), F.lit("MEDIUM").alias("regime"),
        none.alias("atr"), none.alias("spread"),
    )
    by_month = log.repartition(F.trunc("ts", "month"))
    sinks.append_trade_log(by_month.where(scoring.direction(F.col("action")) == 1), path)
    sinks.append_trade_log(by_month.where(scoring.direction(F.col("action")) == -1), path)
    return sinks.read_trade_log(spark, path).select("symbol", "ts", "month", "action", "entry", "sl", "tp")


@R.add(
    """SELECT 'events' AS dataset, 1::BIGINT AS files, count(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts FROM events
    UNION ALL SELECT 'lineitem', 1, count(*), min(l_shipdate), max(l_shipdate) FROM lineitem
    UNION ALL SELECT 'orders', 1, count(*), min(o_orderdate), max(o_orderdate) FROM orders
    UNION ALL SELECT 'documents', 1, count(*), NULL, NULL FROM documents"""
)
def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    times = {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate", "documents": None}
    inputs.configure(spark)
    paths = {n: (f"{sf}/{n}.parquet", t) for n, t in times.items()}
    return sinks.manifest(spark, paths).drop("bytes")


@R.add(
    f"{q.with_(q.BARS)} SELECT symbol, 0 AS position, 'close' AS name, 'double' AS type, 0::BIGINT AS nulls, min(close) AS min, max(close) AS max FROM bars GROUP BY symbol"
)
def feature_profile_json(spark: SparkSession, sf: str) -> DataFrame:
    from candlewake.operators.quality import feature_profile

    path = fresh_path(spark, "profile")
    sinks.write_profile(feature_profile(inputs.bars(spark, sf), ["close"]), path)
    schema = "symbol string, position int, name string, type string, nulls bigint, min double, max double"
    return spark.read.schema(schema).json(path)


