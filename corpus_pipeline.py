"""A training corpus in five stages: clean, deduplicate, decontaminate, hide secrets, mix.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All stages keep the columns of ``documents``.
Where a stage changes ``text``, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.llm import decontamination, line_quality, mixing, near_dedup, secret_scan
from candlewake.llm.common import table
from candlewake.session import scratch, stage

#: Two stages are not expressible in SQL (secret spans by position, groups by reachability over all texts).
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are removed; documents that lose too much, and rejected ones, go.

    Null and empty texts go. Rows are judged one by one.
    """
    return _counted(line_quality.cleaned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays; one without an id if none has one."""
    return near_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets are replaced in their texts."""
    return _counted(secret_scan.without_secrets(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice."""
    return mixing.mixture(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", secrets),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` applied to ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        with scratch(spark):
            docs = stage(apply(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}", keep=True)
    return docs
