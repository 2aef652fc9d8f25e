"""Staged tables and the scopes that remove them."""

import threading

import pytest
from pyspark.errors import AnalysisException

from candlewake.session import scratch, stage


def test_scope_removes_its_own_tables_and_hands_kept_ones_on(spark):
    with scratch(spark):
        with scratch(spark):
            own, kept = stage(spark.range(3), "own"), stage(spark.range(4), "kept", keep=True)
            where = [df.inputFiles()[0].rsplit("/", 1)[0] for df in (own, kept)]
        assert kept.count() == 4
        with pytest.raises(AnalysisException):
            spark.read.parquet(where[0])
    with pytest.raises(AnalysisException):
        spark.read.parquet(where[1])


def test_scope_removes_after_an_error(spark):
    with pytest.raises(ValueError), scratch(spark):
        where = stage(spark.range(3), "own").inputFiles()[0].rsplit("/", 1)[0]
        raise ValueError
    with pytest.raises(AnalysisException):
        spark.read.parquet(where)


def test_scope_leaves_tables_of_other_threads(spark):
    made, go, done = [], threading.Event(), threading.Event()

    def other():
        with scratch(spark):
            made.append(stage(spark.range(7), "other"))
            go.set()
            done.wait(60)
            made.append(made[0].count())

    thread = threading.Thread(target=other)
    with scratch(spark):
        thread.start()
        go.wait(60)
    done.set()
    thread.join()
    assert made[1] == 7
