"""Calendar events: attachment to pairs, surprise measures, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewake.operators.blocks import day_of, indexed_blocks
from candlewake.schema import CURRENCY_COUNTRY

SURPRISE_WINDOW, SURPRISE_MIN, SURPRISE_CAP = 52, 5, 5.0


def pair_countries(pairs: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Base and quote currency of each pair with their country; unknown currencies drop out."""
    country = F.create_map(*[F.lit(x) for kv in CURRENCY_COUNTRY.items() for x in kv])
    s = F.col(symbol)
    roles = F.array(
        F.struct(F.substring(s, 1, 3).alias("currency"), F.lit("base").alias("currency_role")),
        F.struct(F.right(s, F.lit(3)).alias("currency"), F.lit("quote").alias("currency_role")),
    )
    return (
        pairs.select(symbol, F.inline(roles))
        .withColumn("country", F.try_element_at(country, F.col("currency")))
        .where(F.col("country").isNotNull())
    )


def attach_to_pairs(events: DataFrame, pairs: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Events of the base and of the quote country of each pair."""
    return events.join(pair_countries(pairs.select(symbol).distinct(), symbol), "country")


def union_events(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def surprise_factor(actual: Column, consensus: Column) -> Column:
    return F.coalesce((actual - consensus) / (F.abs(consensus) + 0.01), F.lit(0.0))


def surprise_zscore(
    events: DataFrame,
    keys: list[str] | None = None,
    order: list[str] | None = None,
    bucket: Column | None = None,
    **block_sizes: int,
) -> DataFrame:
    """Forecast error over its recent deviation per event name, cut to plus or minus five.

    Where the recent deviation is unknown (too few releases, or 0/0) the error is
    standardised over all releases of the name, and is 0 if these do not vary.
    """
    keys = keys or ["event_name"]
    order = order or ["ts"]
    err = F.col("actual_value") - F.col("consensus_forecast")
    src = events.withColumn("_e", err)
    whole = src.groupBy(*keys).agg(F.avg("_e").alias("_m"), F.stddev_samp("_e").alias("_s"))
    b = indexed_blocks(
        src, keys, order, day_of("ts") if bucket is None else bucket, SURPRISE_WINDOW, **block_sizes
    )
    recent = b.last(SURPRISE_WINDOW)
    rolled = b.add(
        {"_sd": F.stddev_samp("_e").over(recent), "_n": F.count("_e").over(recent)}
    ).close()
    # A non-zero error over no deviation is infinite, so it ends at the cap.
    steep = F.when(
        F.col("_sd") == 0,
        F.when(F.col("_e") > 0, SURPRISE_CAP).when(F.col("_e") < 0, -SURPRISE_CAP),
    ).otherwise(F.try_divide("_e", "_sd"))
    z = F.when(F.col("_n") >= SURPRISE_MIN, steep)
    fallback = F.when(F.col("_s") > 0, (F.col("_e") - F.col("_m")) / F.col("_s"))
    z = F.coalesce(z, fallback, F.lit(0.0))
    capped = F.greatest(F.lit(-SURPRISE_CAP), F.least(F.lit(SURPRISE_CAP), z))
    return rolled.join(whole, keys).select(*events.columns, capped.alias("surprise_zscore"))


def request_surprise(events: DataFrame, request: str) -> DataFrame:
    """Surprise at scoring time: error over the deviation of ``previous`` in the request."""
    sd = events.groupBy(request).agg(F.stddev_samp("previous").alias("_sd"))
    z = (F.col("actual") - F.col("forecast")) / (F.col("_sd") + 1e-8)
    return events.join(sd, request).select(*events.columns, z.alias("surprise_zscore"))


def event_summary(events: DataFrame, key: str = "symbol") -> DataFrame:
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.array_join(F.sort_array(F.collect_set("country")), ", ").alias("countries"),
    )
