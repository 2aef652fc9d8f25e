"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.session import stage

#: White space that separates words: space, tab, line feed, vertical tab, form feed, return.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a table that may be sent whole to every executor; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once however often it is used."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text in order; no text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def sized(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Stage ``df`` (narrow rows) and mark it for broadcasting if it has few rows; else it is shuffled."""
    kept = stage(df, name)
    return F.broadcast(kept) if kept.count() <= most else kept


#: Parts over which the rows of a frequent key are dealt.
PARTS = 256


def spread_join(
    rows: DataFrame, lookup: DataFrame, on: list[str], weight: str, total: int, by: Column, how: str = "inner"
) -> DataFrame:
    """``rows`` joined to ``lookup`` without ``weight``'s frequent keys falling to one task.

    ``lookup`` is staged and has one row for each key ``on``, which ``weight`` of the ``total`` rows carry.
    A small one is broadcast. Else keys of over ``total / PARTS`` rows, fewer than ``PARTS`` of them, are
    dealt over ``PARTS`` copies by the hash ``by``.
    """
    if lookup.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lookup), on, how)
    heavy = F.col(weight) * PARTS > total
    hot = F.broadcast(lookup.filter(heavy).select(*on, F.lit(True).alias("__hot")))
    part = F.when(F.col("__hot"), F.pmod(by, F.lit(PARTS))).otherwise(0).cast("int")
    dealt = rows.join(hot, on, "left").withColumn("__part", part)
    copies = F.when(heavy, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(lookup.withColumn("__part", F.explode(copies)), [*on, "__part"], how).drop("__hot", "__part")


def row_id(key: str, text: str) -> Column:
    """A number for a row by its key, which may be null or repeated, and its text; no text counts as an empty one."""
    return F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary"))


def crc_bucket(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))
