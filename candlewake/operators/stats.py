"""Correlation, pruning and scaling of feature columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CORRELATION = 0.95
CONSTANT = 1e-12
SUM_NAMES = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def feature_correlation(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """Absolute Pearson correlation of every pair of features, long form; null with a constant feature.

    Each task reduces its batches to sums of products, which Spark adds up. Rows are
    never paired.
    """
    keys = keys or ["symbol"]
    names = F.array(*[F.lit(n) for n in features])
    return _correlation_sums(df, features, keys).select(
        *keys,
        "i",
        "j",
        F.element_at(names, F.col("i") + 1).alias("a"),
        F.element_at(names, F.col("j") + 1).alias("b"),
        F.abs("_r").alias("r"),
    )


def _correlation_sums(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Pairwise-complete sums per batch and key, added up per pair.

    Values are shifted by the mean of their key first, which keeps the sums accurate; a
    constant feature has none, and so no sums.
    """
    value = lambda n: F.col(n).cast("double")
    means = df.groupBy(*keys).agg(
        F.array(
            *[F.when(F.min(value(n)) < F.max(value(n)), F.avg(value(n))) for n in features]
        ).alias("_m")
    )
    values = F.transform(
        F.arrays_zip(F.array(*[F.col(n).cast("double") for n in features]).alias("v"), F.col("_m").alias("m")),
        lambda z: z["v"] - z["m"],
    )
    shifted = df.join(means, keys).select(*keys, values.alias("_x"))
    first, second = np.triu_indices(len(features), 1)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, group in batch.groupby(keys, sort=False):
                x = np.array(group["_x"].tolist(), dtype="float64")
                have = ~np.isnan(x)
                x, m = np.where(have, x, 0.0), have.astype("float64")
                sums = [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x]
                out.append([*key, *[s[first, second] for s in sums]])
            if out:
                yield pd.DataFrame(out, columns=[*keys, *SUM_NAMES])

    key_schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)
    partial = shifted.mapInPandas(
        reduce, f"{key_schema}, " + ", ".join(f"{n} array<double>" for n in SUM_NAMES)
    )
    flat = partial.select(*keys, F.posexplode(F.arrays_zip(*SUM_NAMES))).groupBy(*keys, "pos").agg(
        *[F.sum(f"col.{n}").alias(n) for n in SUM_NAMES]
    )
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in SUM_NAMES)
    # What is left of a constant after rounding is no variance.
    varies = lambda s, ss: F.when(n * ss - s * s > CONSTANT * n * ss, n * ss - s * s)
    spread = F.sqrt(varies(sx, sxx) * varies(sy, syy))
    at = lambda a: F.element_at(F.array(*[F.lit(int(v)) for v in a]), F.col("pos") + 1)
    return flat.select(
        *keys,
        at(first).alias("i"),
        at(second).alias("j"),
        F.try_divide(n * sxy - sx * sy, spread).alias("_r"),
    )


def correlated_features(
    correlations: DataFrame, keys: list[str] | None = None, limit: float = MAX_CORRELATION
) -> DataFrame:
    """Features to drop: those too close to an earlier one, with all such partners."""
    keys = keys or ["symbol"]
    return (
        correlations.where(F.col("r") > limit)
        .groupBy(*keys, F.col("b").alias("feature"))
        .agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]
        ), ",").alias("partners"))
    )


def column_stats(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Minimum, maximum, mean and population deviation per key, wide form."""
    aggs = []
    for n in features:
        aggs += [
            F.min(n).alias(f"_min_{n}"), F.max(n).alias(f"_max_{n}"),
            F.avg(n).alias(f"_avg_{n}"), F.stddev_pop(n).alias(f"_std_{n}"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def scale_min_max(df: DataFrame, fitted: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Scale to [0, 1] with the fitted range; a constant feature is only shifted."""
    span = lambda n: F.col(f"_max_{n}") - F.col(f"_min_{n}")
    return df.join(fitted, keys).select(
        *[c for c in df.columns if c not in features],
        *[
            (
                (F.col(n) - F.col(f"_min_{n}"))
                / F.when(span(n) == 0, 1.0).otherwise(span(n))
            ).alias(n)
            for n in features
        ],
    )


def scale_standard(df: DataFrame, fitted: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Centre and divide by the population deviation; a constant feature is only centred."""
    sd = lambda n: F.when(F.col(f"_std_{n}") == 0, 1.0).otherwise(F.col(f"_std_{n}"))
    return df.join(fitted, keys).select(
        *[c for c in df.columns if c not in features],
        *[((F.col(n) - F.col(f"_avg_{n}")) / sd(n)).alias(n) for n in features],
    )


def top_n(df: DataFrame, by: str, n: int, then: str) -> DataFrame:
    """The ``n`` largest; ties by ``then``."""
    return df.orderBy(F.desc(by), then).limit(n)
