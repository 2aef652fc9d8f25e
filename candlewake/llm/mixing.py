"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / size`` times, sizes counted in
words over the source. The expected copies are summed up along the documents of
the source, ordered by size, one random offset is added, and a document is
taken once for each whole number that the sum crosses at it. Neighbours in the
order are about equally long, so that the words taken are close to the target.

The order of a source is cut into blocks (size class, hash of the key), so that no
task holds a whole source: a window ranks the rows of a block, and the ranks where
blocks begin come from sums over the small table of block counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewake.llm.common import WORD
from candlewake.session import stage

#: Weights dealt to the sources in the order of their names, again and again.
WEIGHTS = (5, 2, 1)
#: Size of the mix, as a share of all words.
SHARE = 1.5
#: Times that a source, and so any document, may be taken at most.
MOST = 2.0
SEED = "mix-1"


def text_size(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``__target`` to a table with a row per source (``__src``, ``__source_size``).

    Targets are the common level times the weight, or ``most`` times the size if
    that is less: the level at which they add up is where handing the excess of
    full sources to the others ends. It is found along the sources ordered by the
    level that fills them.
    """
    by_name = Window.orderBy("__src")
    every = Window.partitionBy()
    deal = F.array(*[F.lit(float(w)) for w in weights])
    at = (F.row_number().over(by_name) - 1) % len(weights)
    df = sources.withColumn("__w", F.get(deal, at)).withColumn("__cap", most * F.col("__source_size"))
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "__src").rowsBetween(
        Window.unboundedPreceding, -1
    )
    df = df.withColumns(
        {
            "__rest": share * F.sum("__source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
            "__rest_w": F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
        }
    ).withColumn("__level", F.col("__rest") / F.col("__rest_w"))
    short = F.col("__level") * F.col("__w") < F.col("__cap")
    df = df.withColumn("__level", F.max(F.when(short, F.col("__level"))).over(every))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap")))
    return df.select("__src", "__source_size", target.alias("__target"))


def mix(
    docs: DataFrame,
    size: Column,
    source: str = "source",
    key: str = "doc_id",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
) -> DataFrame:
    """All rows of ``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__copies``.

    ``size`` is an expression over ``docs``. A null source is a source of its own,
    last in the order. Rows without words are never taken. Rows that repeat a key
    are dealt with one by one; equal ones are interchangeable. An empty table gives
    an empty result. The draw depends on keys, sizes and ``seed`` alone.
    """
    n = docs.count()
    salts = max(1, math.ceil(math.sqrt(n) / 8))
    src = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    draw = lambda text: F.conv(F.substring(text, 1, 8), 16, 10).cast("long")
    rows = docs.withColumns({"__src": src, "__size": size, "__salt": F.pmod(draw(digest), F.lit(salts))})
    rows = rows.withColumn("__bits", F.length(F.bin("__size")))
    rows = rows.withColumn("__bin", F.col("__bits") * 16 + F.expr("shiftright(__size * 16, __bits)"))
    block = ["__src", "__bin", "__salt"]
    blocks = stage(rows.groupBy(*block).agg(F.count("*").alias("__n"), F.sum("__size").alias("__words")), "mix-blocks")
    plan = targets(blocks.groupBy("__src").agg(F.sum("__words").alias("__source_size")), weights, share, most)
    order = Window.partitionBy("__src").orderBy("__bin", "__salt")
    starts = (
        blocks.withColumn("__before", F.sum("__n").over(order) - F.col("__n"))
        .join(plan, "__src")
        .withColumns(
            {
                "__rate": F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0),
                "__offset": draw(F.md5(F.concat(F.lit(seed), F.substring("__src", 2, 1 << 30)).cast("binary")))
                / float(1 << 32),
            }
        )
        .select(*block, "__before", "__source_size", "__target", "__rate", "__offset")
    )
    inside = Window.partitionBy(*block).orderBy("__size", key)
    rank = F.col("__before") + F.col("__rank")
    upto = lambda k: F.floor(k * F.col("__rate") + F.col("__offset"))
    copies = F.least(upto(rank) - upto(rank - 1), F.ceil("__rate"))
    return (
        rows.withColumn("__rank", F.row_number().over(inside))
        .join(starts, block)
        .withColumn("__copies", F.when(F.col("__size") > 0, copies).otherwise(F.lit(0)).cast("long"))
        .select(*docs.columns, "__size", "__source_size", "__target", "__copies")
    )


def mixture(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    planned = mix(docs, text_size(F.col(text)), **options)
    copies = planned.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int"))))
    return copies.select(*docs.columns)
