"""Recursions with exact carry against a loop over the rows."""

import pytest
from pyspark.sql import functions as F

from candlewake.operators import carry, scan
from candlewake.session import stage


def looped(rows, r):
    """One recursion by the book; raw values are compared once the seed is complete."""
    out, y, seed = [], 0.0, 0.0
    for i, x in enumerate(rows):
        if i < r.first:
            out.append(None)
            continue
        if i <= r.seed_at:
            seed += x
            y = seed / r.seed_div
            out.append(y if i == r.seed_at else None)
        else:
            y = r.beta * y + r.gain * x
            out.append(y)
    return out


SPANS = [
    scan.ema("fast", "x", 3),
    scan.ema("long", "x", 10_000),
    scan.ema_unseeded("plain", "x", 10_000),
    scan.wilder("wild", "x", 14),
    scan.wilder_sum("total", "x", 14, 14),
]


@pytest.fixture(scope="module")
def series(spark):
    rows = spark.range(24_000).select(
        F.when(F.col("id") < 23_000, "A").otherwise("B").alias("symbol"),
        (F.col("id") % 23_000).alias("_idx"),
        (1 + (F.hash("id") % 1000) / 1000).alias("x"),
    )
    return stage(rows, "series")


@pytest.mark.parametrize(("cell_rows", "group"), [(None, carry.GROUP), (64, 1024), (64, 8), (1, 32)])
def test_equal_to_a_loop_for_spans_longer_than_a_cell(spark, series, cell_rows, group):
    out = carry.shown(carry.running(series, ["symbol"], SPANS, cell_rows=cell_rows, group=group), SPANS)
    got = out.orderBy("symbol", "_idx").collect()
    for symbol in ("A", "B"):
        mine = [r for r in got if r.symbol == symbol]
        assert [r._idx for r in mine] == list(range(len(mine)))
        for r in SPANS:
            want = looped([m.x for m in mine], r)
            show = r.seed_at if r.show_from is None else r.show_from
            for m, w in zip(mine, want, strict=True):
                if m._idx < show:
                    assert m[r.name] is None
                else:
                    assert m[r.name] == pytest.approx(w, rel=1e-11)


def test_goes_on_from_a_stored_state(spark, series):
    whole = carry.running(series, ["symbol"], SPANS)
    cut = F.when(F.col("symbol") == "A", 7_001).otherwise(5)
    early = carry.running(stage(series.where(F.col("_idx") < cut), "early"), ["symbol"], SPANS)
    names = [r.name for r in SPANS]
    state = early.groupBy("symbol").agg(*[F.max_by(n, "_idx").alias(n) for n in names])
    late = stage(series.where(F.col("_idx") >= cut).withColumn("_before", cut), "late")
    went_on = carry.running(late, ["symbol"], SPANS, stage(state, "state"), "_before", cell_rows=100)
    both = went_on.join(whole.select("symbol", "_idx", *[F.col(n).alias(f"w_{n}") for n in names]), ["symbol", "_idx"])
    off = F.greatest(*[F.abs(F.col(n) / F.col(f"w_{n}") - 1) for n in names if n != "wild"])
    row = both.agg(F.count("*").alias("n"), F.max(off).alias("off")).first()
    assert row.n == 24_000 - 7_001 - 5
    assert row.off < 1e-11


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "symbol string, _idx long, x double")
    assert carry.running(none, ["symbol"], SPANS).count() == 0
    some = spark.createDataFrame([("A", 0, 1.0), ("A", 1, None), ("A", 2, 1.0)], none.schema)
    plain = scan.ema_unseeded("y", "x", 3)
    got = [r.y for r in carry.running(some, ["symbol"], [plain]).orderBy("_idx").collect()]
    assert got == [1.0, 0.5, 0.75]
