"""Live versions of bar building, duplicate guard, daily limits, blackout and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import LongType, StructField, StructType

from candlewake.operators.timeline import HOUR, asof_join
from candlewake.session import fresh_path

MINUTE = 60


def live_bars(
    ticks: DataFrame, every: str, order: list[str], delay: str, slide: str | None = None
) -> DataFrame:
    """Bars from a tick stream; a bar is final once the watermark passes its end.

    Ticks that come later than ``delay`` are dropped. ``slide`` gives overlapping bars.
    """
    rank = F.struct(*order)
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", window.alias("_bin"))
        .agg(
            F.min_by("price", rank).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", rank).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select("symbol", F.col("_bin.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def without_repeats(signals: DataFrame, every: str, delay: str) -> DataFrame:
    """At most one signal per symbol, side and bar.

    The state of a bar lives as long as the watermark's delay, so the delay is a bar at least.
    """
    binned = signals.withColumn("bar_ts", F.window("ts", every).start)
    lasting = max(every, delay, key=pd.Timedelta)
    return binned.withWatermark("ts", lasting).dropDuplicatesWithinWatermark(
        ["symbol", "side", "bar_ts"]
    )


LIMIT_OUTPUT = "symbol string, side string, ts timestamp, id long"
LIMIT_STATE = "symbol string, side string, day int, losses long"


def limit_each_batch(out: str, state: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for the daily limit: signals that pass the loss block and are
    the first of their symbol and side that day.

    A batch mixes closed deals (kind 0, with profit) and signals (kind 1) with columns
    symbol, side, ts, kind, id, profit; deals come before signals of their time. A signal is
    free if the last deal before it that won or lost was a win, or if there is none and the
    losses carried from earlier batches are zero. Batches hold what is later in time than the
    batches before. What is carried is a day and a count for each symbol and side, one
    folder of ``state`` for each batch, so a batch that is run again replaces its own.
    """
    keys = ["symbol", "side"]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        spark.createDataFrame([], LIMIT_STATE).write.mode("append").parquet(f"{state}/batch=-1")
        kept = spark.read.schema(LIMIT_STATE + ", batch long").parquet(state).where(F.col("batch") < batch_id)
        last = F.max_by(F.struct("day", "losses"), "batch").alias("_s")
        kept = kept.groupBy(*keys).agg(last).select(*keys, "_s.*")
        deals = batch.where((F.col("kind") == 0) & (F.col("profit") != 0))
        signals = batch.where(F.col("kind") == 1).select(*keys, "ts", "id")
        won = deals.select(*keys, "ts", F.col("id").alias("_id"), (F.col("profit") > 0).alias("_won"))
        placed = asof_join(signals, won, keys, ["_won"], bucket_us=HOUR, tie=["_id"]).join(kept, keys, "left")
        free = F.coalesce("_won", F.coalesce("losses", F.lit(0)) == 0)
        today = F.unix_date(F.to_date("ts"))
        taken = placed.where(free & ~today.eqNullSafe(F.col("day"))).groupBy(*keys, today.alias("_day"))
        taken = taken.agg(F.min(F.struct("ts", "id")).alias("_first")).select(*keys, "_first.*")
        taken.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        taken = spark.read.schema(LIMIT_OUTPUT).parquet(f"{out}/batch={batch_id}")

        at = F.struct("ts", "id")
        wins = deals.where("profit > 0").groupBy(*keys).agg(F.max(at).alias("_win"))
        since = F.col("_win").isNull() | (at > F.col("_win"))
        losses = deals.join(wins, keys, "left").groupBy(*keys).agg(
            F.count_if((F.col("profit") < 0) & since).alias("_new"), F.max(F.col("_win").isNotNull()).alias("_reset")
        )
        days = taken.groupBy(*keys).agg(F.max(today).alias("_taken"))
        seen = batch.select(*keys).distinct()
        now = seen.join(kept, keys, "left").join(losses, keys, "left").join(days, keys, "left")
        carried = F.when(F.coalesce("_reset", F.lit(False)), 0).otherwise(F.coalesce("losses", F.lit(0)))
        now = now.select(
            *keys,
            F.coalesce("_taken", "day").alias("day"),
            (carried + F.coalesce("_new", F.lit(0))).cast("long").alias("losses"),
        )
        now.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        batch.unpersist()

    return run


def daily_limit(moves: DataFrame, name: str = "live-limit") -> DataFrame:
    """Run the daily limit over what a stream holds now; the signals that pass."""
    spark = moves.sparkSession
    out = fresh_path(spark, name)
    run_batches(moves, name, limit_each_batch(out, fresh_path(spark, f"{name}-carried")))
    return spark.read.schema(LIMIT_OUTPUT).parquet(out).select("symbol", "side", "ts", "id")


CARRIED = "day int, losses long, us array<long>, kind array<int>, id array<long>, profit array<double>"


def stateful_limit(moves: DataFrame, delay: str) -> DataFrame:
    """The daily limit as a stateful operator: rows may come out of order by up to ``delay``.

    A symbol and side keeps its last day and its losses, and the rows the watermark has not
    passed; those are worked off in order of time as soon as it has. So a batch reads its own
    rows and one state for each symbol and side, however many batches there were. Signals at
    the end of a stream come out when later rows move the watermark beyond them.
    """

    def run(
        key: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        day, losses, *waiting = state.get if state.exists else (None, 0, [], [], [], [])
        rows = list(zip(*waiting, strict=True))
        for part in parts:
            rows += part[["us", "kind", "id", "profit"]].itertuples(index=False, name=None)
        passed = state.getCurrentWatermarkMs() * 1000
        taken = []
        for us, kind, id_, profit in sorted((r for r in rows if r[0] < passed), key=lambda r: r[:3]):
            today = us // 86_400_000_000
            if kind == 0:
                losses = 0 if profit > 0 else losses + (profit < 0)
            elif losses == 0 and today != day:
                taken.append((us, id_))
                day = today
        rows = [r for r in rows if r[0] >= passed]
        state.update((day, int(losses), *([r[k] for r in rows] for k in range(4))))
        if rows:
            state.setTimeoutTimestamp(min(r[0] for r in rows) // 1000 + 1)
        yield pd.DataFrame({"symbol": key[0], "side": key[1], "us": [t[0] for t in taken], "id": [t[1] for t in taken]})

    named = moves.withWatermark("ts", delay).select(
        "symbol", "side", "ts", F.unix_micros("ts").alias("us"), F.col("kind").cast("int"), F.col("id").cast("long"),
        F.coalesce(F.col("profit").cast("double"), F.lit(0.0)).alias("profit"),
    )
    kept = named.groupBy("symbol", "side").applyInPandasWithState(
        run, "symbol string, side string, us long, id long", CARRIED, "append", "EventTimeTimeout"
    )
    return kept.select("symbol", "side", F.timestamp_micros("us").alias("ts"), "id")


def live_blackout(
    signals: DataFrame, events: DataFrame, before_min: int = 30, after_min: int = 30
) -> DataFrame:
    """Signals of a stream that no static event lies close to.

    Each event is listed under the minutes it blocks, which turns the range condition
    into an equality on the minute with an exact check behind it.
    """
    te = F.unix_micros("ts")
    first = F.floor((te / 1e6 - before_min * MINUTE) / MINUTE)
    last = F.floor((te / 1e6 + after_min * MINUTE) / MINUTE)
    times = events.select("ts").distinct()
    marks = times.select(te.alias("_te"), F.explode(F.sequence(first, last)).alias("_b"))
    at = F.unix_micros(signals["ts"])
    minute = 60_000_000
    near = (
        (F.floor(at / minute) == marks["_b"])
        & (at >= marks["_te"] - before_min * minute)
        & (at <= marks["_te"] + after_min * minute)
    )
    return signals.join(marks, near, "left_anti")


def score_each_batch(
    history: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    known: str,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that scores new bars like one job over all bars so far.

    The history of a batch is ``history`` and what earlier batches brought, which is kept
    in the folder ``known``; of it the whole series of the batch's symbols are read, since
    recursions reach back without an end. Each batch owns one folder of ``out`` and of
    ``known``, so a batch that is run again replaces its own and nothing else. A bar that
    comes again replaces what is known of its time.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        # The batch is read several times; what is lost with an executor is read again.
        batch = batch.persist()
        if batch.isEmpty():
            batch.unpersist()
            return
        new = batch.select("symbol", "ts")
        bars = batch.select(*history.columns)
        bars.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{known}/batch={batch_id}")
        schema = StructType([*bars.schema, StructField("_batch", LongType()), StructField("batch", LongType())])
        stored = batch.sparkSession.read.schema(schema).parquet(known)
        stored = stored.where(F.col("batch") < batch_id)
        row = F.struct("_batch", *bars.columns)
        earlier = history.withColumn("_batch", F.lit(-1)).unionByName(stored.drop("batch"))
        earlier = earlier.join(new, ["symbol", "ts"], "left_anti").join(new.select("symbol").distinct(), "symbol", "left_semi")
        earlier = earlier.groupBy("symbol", "ts").agg(F.max_by(row, "_batch").alias("_row"))
        together = earlier.select(*[F.col(f"_row.{n}").alias(n) for n in bars.columns]).unionByName(bars)
        scored = score(together).join(new, ["symbol", "ts"], "left_semi")
        scored.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.unpersist()

    return run


def run_to_table(stream: DataFrame, name: str, schema: str | None = None) -> DataFrame:
    """Run a stream over what is there now, into files; returns the result as a table."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", fresh_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema or stream.schema).parquet(out)


def run_batches(
    stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], checkpoint: str | None = None
) -> None:
    """Run over what is there now; with the ``checkpoint`` of an earlier run, over what came since."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_table_stream(
    spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None
) -> DataFrame:
    """One of the given tables as a stream, times read as UTC instants."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(folder)
    for field in schema:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df
