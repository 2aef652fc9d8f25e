"""Streaming queries, run over the given tables until nothing new is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.operators import indicators as ind
from candlewake.operators import scan
from candlewake.operators.blocks import Blocks
from candlewake.plans import inputs
from candlewake.plans import sqltext as q
from candlewake.plans.registry import Registry, rounded
from candlewake.session import configure, fresh_path, stage
from candlewake.streaming import live
from candlewake.streaming.carried import Scoring, carried_scores

R = Registry()


def tick_stream(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    e = live.read_table_stream(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("symbol"),
        "ts",
        (1 + F.col("value") / 100).alias("price"),
        F.lit(1).alias("size"),
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _final(every: str) -> str:
    return f"bar + INTERVAL {every} <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM ticks)"


@R.add(
    f"""WITH {q.TICKS}, b AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS bar, first(price ORDER BY ts, event_id) AS open,
      max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(size)::BIGINT AS volume
      FROM ticks GROUP BY symbol, time_bucket(INTERVAL 5 MINUTE, ts))
    SELECT * EXCLUDE (bar), bar AS ts FROM b WHERE {_final('5 MINUTE')}"""
)
def live_bars(spark: SparkSession, sf: str) -> DataFrame:
    bars = live.live_bars(tick_stream(spark, sf), "5 minutes", ["ts", "event_id"], "10 minutes")
    return live.run_to_table(bars, "live-bars")


@R.add(
    f"""WITH {q.TICKS} SELECT DISTINCT symbol, CASE WHEN k % 3 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
      time_bucket(INTERVAL 1 HOUR, ts) AS bar_ts FROM ticks WHERE k % 3 < 2"""
)
def live_duplicate_guard(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("k") % 3 == 0, "BUY").otherwise("SELL")
    s = tick_stream(spark, sf).where("k % 3 < 2").select("symbol", side.alias("side"), "ts")
    out = live.without_repeats(s, "1 hour", "1 hour").select("symbol", "side", "bar_ts")
    return live.run_to_table(out, "live-guard")


_MOVES = """moves AS (SELECT symbol, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, ts, event_id AS id,
  CASE WHEN k < 40 THEN 0 ELSE 1 END AS kind, (k % 7 - 3)::DOUBLE AS profit FROM ticks),
isl AS (SELECT *, sum((kind = 0 AND profit > 0)::INT) OVER w AS island FROM moves
  WINDOW w AS (PARTITION BY symbol, side ORDER BY ts, kind, id)),
cnt AS (SELECT *, sum((kind = 0 AND profit < 0)::INT) OVER (PARTITION BY symbol, side, island ORDER BY ts, kind, id) AS losses FROM isl)"""


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    """Deals and signals of the tick stream."""
    k = F.col("k")
    return tick_stream(spark, sf).select(
        "symbol",
        F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        "ts",
        F.when(k < 40, 0).otherwise(1).alias("kind"),
        F.col("event_id").alias("id"),
        (k % 7 - 3).cast("double").alias("profit"),
    )


@R.add(
    f"""WITH {q.TICKS}, {_MOVES} SELECT symbol, side, ts, id FROM cnt WHERE kind = 1 AND losses = 0
    QUALIFY row_number() OVER (PARTITION BY symbol, side, ts::DATE ORDER BY ts, id) = 1"""
)
def live_daily_limit(spark: SparkSession, sf: str) -> DataFrame:
    return live.daily_limit(_moves(spark, sf))


@R.add(
    f"""WITH {q.TICKS}, {_MOVES}, passed AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS passed FROM moves)
    SELECT symbol, side, ts, id FROM cnt, passed WHERE kind = 1 AND losses = 0 AND ts < passed
    QUALIFY row_number() OVER (PARTITION BY symbol, side, ts::DATE ORDER BY ts, id) = 1"""
)
def live_daily_limit_by_state(spark: SparkSession, sf: str) -> DataFrame:
    """The daily limit with its state in the operator; signals the watermark has passed."""
    return live.run_to_table(live.stateful_limit(_moves(spark, sf), "1 hour"), "live-limit-state")


@R.add(
    f"""{q.with_(q.TICKS, q.CALENDAR)}, marked AS (SELECT ts FROM calendar WHERE event_name = 'release 2' AND country = 'GB')
    SELECT event_id, symbol, ts FROM ticks t WHERE NOT EXISTS (SELECT 1 FROM marked m
      WHERE t.ts BETWEEN m.ts - INTERVAL 30 MINUTE AND m.ts + INTERVAL 30 MINUTE)"""
)
def live_news_blackout(spark: SparkSession, sf: str) -> DataFrame:
    marked = inputs.calendar(spark, sf).where("event_name = 'release 2' AND country = 'GB'")
    t = tick_stream(spark, sf).select("event_id", "symbol", "ts")
    return live.run_to_table(live.live_blackout(t, marked), "live-blackout")


@R.add(
    f"""{q.with_(q.HOURS, q.smoothed('hours'))} SELECT symbol, ts, {q.r('rsi')} AS rsi, {q.r('atr_14', 6)} AS atr_14 FROM feat0
    WHERE ts >= TIMESTAMP '2024-01-25'"""
)
def live_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Bars from 25 January on arrive as a stream and are scored with the bars before them."""
    hours = stage(inputs.hours(spark, sf), "hours")
    history = hours.where("ts < '2024-01-25'")
    path = fresh_path(spark, "arriving")
    # Some days at a time, in order, one file for each micro-batch.
    for first, end in (("2024-01-25", "2024-01-27"), ("2024-01-27", "2024-01-29"), ("2024-01-29", "9999-01-01")):
        part = hours.where(F.col("ts").between(first, end) & (F.col("ts") < end))
        part.coalesce(1).write.mode("append").parquet(path)
    arriving = spark.readStream.schema(hours.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = fresh_path(spark, "live-scores")

    def rsi_and_atr(bars: DataFrame) -> DataFrame:
        names = {"_avg_gain", "_avg_loss", "atr_14"}
        b = ind.smoothed(ind.with_moves(ind.feature_blocks(bars)), names)
        return b.add_sql({"rsi": ind.RSI}).close().select("symbol", "ts", "rsi", "atr_14")

    live.run_batches(arriving, "live-scores", live.score_each_batch(history, rsi_and_atr, out, fresh_path(spark, "live-known")))
    scored = spark.read.schema("symbol string, ts timestamp, rsi double, atr_14 double").parquet(out)
    return rounded(rounded(scored.select("symbol", "ts", "rsi", "atr_14"), ["rsi"]), ["atr_14"], 6)


def _frames(b: Blocks) -> Blocks:
    """What the recursions read, and the average of a band."""
    b = ind.with_moves(b)
    return b.add_sql({"bb_middle": ind.since(ind.BB_PERIOD - 1, f"avg(close) {b.over_last(ind.BB_PERIOD)}")})


LIVE = Scoring(
    inputs=_frames,
    recursions=[
        scan.wilder("_avg_gain", "_gain", ind.RSI_PERIOD),
        scan.wilder("_avg_loss", "_loss", ind.RSI_PERIOD),
        scan.wilder("atr_14", "_tr", ind.ATR_PERIOD),
        scan.ema("ema_200", "close", 200),
    ],
    outputs={"rsi": ind.RSI, "atr_14": "atr_14", "ema_200": "ema_200", "bb_middle": "bb_middle"},
    frame=ind.BB_PERIOD,
)


@R.add(
    f"""{q.with_(q.HOURS, q.smoothed('hours'))} SELECT symbol, ts, {q.r('rsi')} AS rsi, {q.r('atr_14', 6)} AS atr_14, {q.r('ema_200')} AS ema_200,
      {q.r(q.from_row(19, f'avg(close) OVER {q.frame(20)}'), 6)} AS bb_middle
    FROM feat0 QUALIFY ts >= TIMESTAMP '2024-01-25'"""
)
def live_scoring_by_state(spark: SparkSession, sf: str) -> DataFrame:
    """Bars from 25 January on arrive two days at a time; each batch reads its own bars and the
    state of the one before."""
    hours = stage(inputs.hours(spark, sf), "hours")
    live_ = carried_scores(spark, LIVE, hours.schema, "live-carried")
    live_.begin(hours.where("ts < '2024-01-25'"))
    path, checkpoint = fresh_path(spark, "arriving"), fresh_path(spark, "arriving-state")
    for first, end in (("2024-01-25", "2024-01-27"), ("2024-01-27", "2024-01-29"), ("2024-01-29", "9999-01-01")):
        hours.where((F.col("ts") >= first) & (F.col("ts") < end)).write.mode("append").parquet(path)
        live.run_batches(spark.readStream.schema(hours.schema).parquet(path), "live-carried", live_, checkpoint)
    scored = live_.scores(spark, "symbol string, ts timestamp, rsi double, atr_14 double, ema_200 double, bb_middle double")
    return rounded(rounded(scored, ["rsi", "ema_200"]), ["atr_14", "bb_middle"], 6)
