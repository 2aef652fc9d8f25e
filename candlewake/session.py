"""Session settings and staged tables."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders this process has staged tables in, by application.
_made: dict[str, set[str]] = {}
#: The folders of the open ``scratch`` scopes of this thread, innermost last.
_scopes: ContextVar[tuple[set[str], ...]] = ContextVar("scopes", default=())


def configure(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC everywhere; AQE re-plans skewed and tiny partitions."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables and stream checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, only a
    local master is served, from its warehouse folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder, removed with its ``scratch`` scope or when the process ends.

    With ``keep`` it belongs to the scope around the innermost one.
    """
    path = f"{shared_dir(spark)}/candlewake/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = set()
        atexit.register(_at_exit, spark)
    _made[app].add(path)
    scopes = _scopes.get()[:-1] if keep else _scopes.get()
    if scopes:
        scopes[-1].add(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made.get(spark.sparkContext.applicationId, set()).discard(path)


def _at_exit(spark: SparkSession) -> None:
    # The JVM may be gone already; a cluster's shared folder is then cleaned by its owner.
    with contextlib.suppress(Exception):
        discard(spark, *_made.get(spark.sparkContext.applicationId, set()).copy())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end, also after an error, what this thread staged inside.

    Tables staged with ``keep`` pass to the scope around this one.
    """
    inside: set[str] = set()
    token = _scopes.set((*_scopes.get(), inside))
    try:
        yield
    finally:
        _scopes.reset(token)
        discard(spark, *inside)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` once and read it back, so that several consumers share one run.

    Unlike a cache the table survives the loss of executors, and unlike an RDD
    checkpoint its readers still prune columns.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name, keep)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
