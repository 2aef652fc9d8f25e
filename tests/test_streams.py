"""Streams against their batch results, late data, repeated batches."""

import pandas as pd
from pyspark.sql import functions as F

from candlewake.operators import indicators as ind, scan
from candlewake.session import fresh_path
from candlewake.streaming import live
from candlewake.streaming.carried import Scoring, carried_scores
from tests.helpers import random_bars, same


def feed(spark, parts, schema):
    """One file per part, read one file per micro-batch in the order of writing."""
    path = fresh_path(spark, "feed")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


TICK = "symbol string, ts timestamp, price double, size int, event_id int"


def ts(text):
    return pd.Timestamp(f"2024-01-01 {text}").to_pydatetime()


def test_bars_close_after_the_watermark_and_late_ticks_drop(spark):
    parts = [
        [("a", ts("00:01"), 1.0, 1, 1), ("a", ts("00:04"), 3.0, 1, 2)],
        [("a", ts("00:30"), 5.0, 1, 3)],
        # A batch drops what was late for the batch before it, hence one batch in between.
        [("a", ts("00:31"), 5.0, 1, 6)],
        [("a", ts("00:02"), 9.0, 1, 4), ("a", ts("00:50"), 7.0, 1, 5)],
    ]
    bars = live.live_bars(feed(spark, parts, TICK), "5 minutes", ["ts", "event_id"], "10 minutes")
    got = live.run_to_table(bars, "t-bars").orderBy("ts").collect()
    assert [(r["ts"].minute, r["open"], r["close"], r["volume"]) for r in got] == [(0, 1.0, 3.0, 2), (30, 5.0, 5.0, 2)]


def test_sliding_bars_overlap(spark):
    parts = [[("a", ts("00:07"), 1.0, 1, 1)], [("a", ts("03:00"), 1.0, 1, 2)]]
    bars = live.live_bars(feed(spark, parts, TICK), "10 minutes", ["ts"], "1 minute", slide="5 minutes")
    got = live.run_to_table(bars, "t-slide").where(F.col("ts") < "2024-01-01 01:00").orderBy("ts").collect()
    assert [r["ts"].minute for r in got] == [0, 5]


MOVE = "symbol string, side string, ts timestamp, kind int, id long, profit double"


def test_daily_limit_keeps_state_across_batches(spark):
    parts = [
        [("a", "BUY", ts("08:00"), 1, 1, None), ("a", "BUY", ts("10:00"), 1, 2, None)],
        [("a", "BUY", ts("11:00"), 1, 3, None), ("a", "SELL", ts("12:00"), 0, 4, -1.0)],
        [("a", "SELL", ts("14:00"), 1, 5, None), ("a", "SELL", ts("15:00"), 0, 6, 2.0)],
        [("a", "SELL", ts("16:00"), 1, 7, None), ("a", "SELL", ts("17:00"), 1, 8, None)],
    ]
    out = live.daily_limit(feed(spark, parts, MOVE), "t-limit")
    assert sorted(r["id"] for r in out.collect()) == [1, 7]


def test_limit_by_state_takes_rows_out_of_order(spark):
    """Deals that arrive after later signals still block them; the day turns at midnight."""
    later = lambda text: pd.Timestamp(f"2024-01-02 {text}").to_pydatetime()
    parts = [
        [("a", "BUY", ts("10:20"), 1, 2, None), ("b", "BUY", ts("10:00"), 1, 20, None)],
        [("a", "BUY", ts("10:10"), 0, 1, -1.0), ("a", "BUY", ts("10:40"), 0, 3, 2.0)],
        [("a", "BUY", ts("10:50"), 1, 5, None), ("a", "BUY", ts("10:45"), 1, 4, None), ("b", "BUY", ts("10:00"), 0, 19, 0.0)],
        [("a", "BUY", ts("23:50"), 1, 6, None), ("a", "BUY", later("00:05"), 1, 7, None), ("b", "SELL", later("00:06"), 1, 21, None)],
        [("a", "BUY", later("00:01"), 0, 8, -3.0), ("a", "BUY", later("00:30"), 0, 9, 1.0), ("a", "BUY", later("00:40"), 1, 10, None)],
        [("c", "BUY", later("09:00"), 1, 30, None)],
    ]
    out = live.run_to_table(live.stateful_limit(feed(spark, parts, MOVE), "1 hour"), "t-state")
    assert sorted((r["symbol"], r["side"], r["id"]) for r in out.collect()) == [("a", "BUY", 4), ("a", "BUY", 10), ("b", "BUY", 20), ("b", "SELL", 21)]


def test_repeats_in_a_bar_are_dropped_across_batches(spark):
    schema = "symbol string, side string, ts timestamp"
    parts = [[("a", "BUY", ts("00:01"))], [("a", "BUY", ts("00:03")), ("a", "BUY", ts("00:06"))]]
    out = live.without_repeats(feed(spark, parts, schema), "5 minutes", "1 hour")
    assert live.run_to_table(out, "t-repeat").count() == 2


def test_blackout_ends_are_included(spark):
    schema = "id int, ts timestamp"
    parts = [[(1, ts("11:29:59")), (2, ts("11:30")), (3, ts("12:30")), (4, ts("12:30:01"))]]
    marks = spark.createDataFrame([(ts("12:00"),)], "ts timestamp")
    out = live.run_to_table(live.live_blackout(feed(spark, parts, schema), marks), "t-black")
    assert sorted(r["id"] for r in out.collect()) == [1, 4]


def test_a_repeated_batch_replaces_its_own_output(spark):
    schema = "symbol string, ts timestamp, close double"
    history = spark.createDataFrame([("a", ts("00:00"), 1.0)], schema)
    batch = spark.createDataFrame([("a", ts("01:00"), 3.0)], schema)
    out = fresh_path(spark, "t-each")
    each = live.score_each_batch(history, lambda df: df.withColumn("n", F.lit(1)), out, fresh_path(spark, "t-known"))
    each(batch, 0)
    each(batch, 0)
    assert spark.read.parquet(out).count() == 1


def test_scores_of_a_stream_equal_the_batch_job(spark):
    """Four batches over 600 bars, far more than any warm-up."""
    bars = random_bars(600, ["a", "b"])
    table = spark.createDataFrame(bars)

    def score(df):
        b = ind.smoothed(ind.with_moves(ind.feature_blocks(df)), {"_avg_gain", "_avg_loss", "atr_14"})
        return b.add_sql({"rsi": ind.RSI}).close().select("symbol", "ts", "rsi", "atr_14")

    cuts = [bars.ts.sort_values().unique()[i] for i in (200, 330, 331, 480)]
    out, known = fresh_path(spark, "t-scores"), fresh_path(spark, "t-known")
    each = live.score_each_batch(table.where(F.col("ts") < F.lit(cuts[0])), score, out, known)
    for i, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], None])):
        part = bars[(bars.ts >= lo) & ((bars.ts < hi) if hi is not None else True)]
        each(spark.createDataFrame(part), i)
        each(spark.createDataFrame(part), i)
    got = spark.read.parquet(out).orderBy("symbol", "ts").toPandas()
    want = score(table).where(F.col("ts") >= F.lit(cuts[0])).orderBy("symbol", "ts").toPandas()
    assert len(got) == len(want) == 800
    same(got["rsi"], want["rsi"])
    same(got["atr_14"], want["atr_14"])


def test_repeats_in_a_bar_longer_than_the_delay_are_dropped(spark):
    parts = [[("a", "BUY", ts("00:01"))], [("a", "BUY", ts("00:20"))], [("a", "BUY", ts("00:40"))], [("a", "BUY", ts("00:59"))]]
    out = live.without_repeats(feed(spark, parts, "symbol string, side string, ts timestamp"), "1 hour", "5 minutes")
    assert live.run_to_table(out, "t-repeat-long").count() == 1


def _carried(spark, bars, name):
    scoring = Scoring(
        inputs=lambda b: (m := ind.with_moves(b)).add_sql({"mean_5": ind.since(4, f"avg(close) {m.over_last(5)}")}),
        recursions=[scan.wilder("atr_14", "_tr", 14), scan.ema("ema_300", "close", 300)],
        outputs={"atr_14": "atr_14", "ema_300": "ema_300", "mean_5": "mean_5"},
        frame=5,
    )
    return carried_scores(spark, scoring, spark.createDataFrame(bars).schema, name)


CARRIED_SCORES = "symbol string, ts timestamp, atr_14 double, ema_300 double, mean_5 double"


def test_carried_state_gives_the_scores_of_one_batch(spark):
    """Cuts inside the warm-up, a batch of one bar, a symbol that pauses, one that comes late, batches run twice."""
    bars = random_bars(600, ["a", "b", "c"])
    times = bars.ts.sort_values().unique()
    bars = bars[~((bars.symbol == "b") & (bars.ts >= times[330]) & (bars.ts < times[480]))]
    bars = bars[~((bars.symbol == "c") & (bars.ts < times[331]))]
    whole, parts = _carried(spark, bars, "t-whole"), _carried(spark, bars, "t-parts")
    whole.begin(spark.createDataFrame(bars).limit(0))
    whole(spark.createDataFrame(bars), 0)
    cuts = [times[i] for i in (7, 9, 330, 331, 480)]
    parts.begin(spark.createDataFrame(bars[bars.ts < cuts[0]]))
    for i, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], None])):
        part = spark.createDataFrame(bars[(bars.ts >= lo) & ((bars.ts < hi) if hi is not None else True)])
        parts(part, i)
        if i in (0, 3):
            parts(part, i)
    want = whole.scores(spark, CARRIED_SCORES).where(F.col("ts") >= F.lit(cuts[0])).orderBy("symbol", "ts").toPandas()
    got = parts.scores(spark, CARRIED_SCORES).orderBy("symbol", "ts").toPandas()
    assert len(got) == len(want) == len(bars[bars.ts >= cuts[0]])
    b = ind.smoothed(ind.with_moves(ind.feature_blocks(spark.createDataFrame(bars))), {"atr_14"})
    blocked = b.close().where(F.col("ts") >= F.lit(cuts[0])).orderBy("symbol", "ts").toPandas()
    for n in ("atr_14", "ema_300", "mean_5"):
        same(got[n], want[n])
    same(got["atr_14"], blocked["atr_14"])
    # The state holds a row for each symbol and as many bars as the frame needs.
    assert spark.read.parquet(f"{parts.ends}/batch=4").count() == 3
    assert spark.read.parquet(f"{parts.tail}/batch=4").count() == 15


def test_carried_state_sets_late_and_repeated_bars_aside(spark):
    bars = random_bars(40, ["a"])
    live_ = _carried(spark, bars, "t-late")
    live_.begin(spark.createDataFrame(bars[:30]))
    rows = spark.createDataFrame(bars[25:35])
    nameless = rows.limit(1).withColumn("symbol", F.lit(None).cast("string"))
    live_(rows.unionByName(rows).unionByName(nameless), 0)
    live_(rows.limit(0), 1)
    live_(spark.createDataFrame(bars[35:]), 2)
    assert live_.scores(spark, CARRIED_SCORES).count() == 10
    assert spark.read.schema(live_.bars).parquet(live_.late).count() == 6
