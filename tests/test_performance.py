"""Drawdowns and ratios of deals against plain loops."""

import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candlewake.operators import performance

SCHEMA = "symbol string, close_ts timestamp, ticket long, profit double"
profits = st.lists(st.integers(-9, 9), max_size=40)


def deals(spark, series):
    rows = [(s, i, float(p)) for s, ps in series.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "symbol string, ticket long, profit double")
    # Three deals share a time, eight times share a day.
    seconds = F.lit(1_700_000_000) + F.floor(F.col("ticket") / 3) * 10_800
    return df.select("symbol", F.timestamp_seconds(seconds).alias("close_ts"), "ticket", "profit")


def worst(ps):
    equity = peak = fall = 0.0
    for p in ps:
        equity += p
        peak = max(peak, equity)
        fall = max(fall, peak - equity)
    return fall


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(a=profits, b=profits, block_rows=st.sampled_from([1, 3, 7, 1000]))
def test_curve_and_worst_fall_equal_a_loop(spark, a, b, block_rows):
    df = deals(spark, {"A": a, "B": b})
    order = ["close_ts", "ticket"]
    falls = {r.symbol: r.max_drawdown for r in performance.max_drawdown(df, ["symbol"], order=order, block_rows=block_rows).collect()}
    assert falls == {s: worst(ps) for s, ps in (("A", a), ("B", b)) if ps}
    curve = performance.equity_curve(df, ["symbol"], order=order, block_rows=block_rows).orderBy("symbol", "ticket").collect()
    want = [(s, i, sum(ps[: i + 1])) for s, ps in (("A", a), ("B", b)) for i in range(len(ps))]
    assert [(r.symbol, r.ticket, r.equity) for r in curve] == want
    assert {s: max(r.drawdown for r in curve if r.symbol == s) for s in falls} == falls


def test_ratios(spark):
    rows = [("A", f"2024-01-0{d}", d, p) for d, p in ((1, 5.0), (1, 1.0), (2, -8.0), (4, None), (5, 4.0))] + [("B", "2024-01-01", 1, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, day string, ticket long, profit double")
    df = df.select("symbol", F.to_timestamp("day").alias("close_ts"), "ticket", "profit")
    df = df.unionByName(spark.createDataFrame([("A", None, 9, 50.0), (None, None, 9, 50.0)], SCHEMA))
    a, b = performance.trade_metrics(df, ["symbol"]).orderBy("symbol").collect()
    assert (a.deals, a.won, a.lost, a.profit, a.profit_factor, a.max_drawdown) == (5, 3, 1, 2.0, 1.25, 8.0)
    daily = [6.0, -8.0, 0.0, 4.0]
    assert a.sharpe == pytest.approx(statistics.mean(daily) / statistics.stdev(daily) * 252**0.5)
    assert a.calmar == pytest.approx(2.0 * 365.25 / 4 / 8.0)
    assert (b.profit_factor, b.sharpe, b.calmar, b.max_drawdown) == (None, None, None, 0.0)


def test_no_deals(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert performance.trade_metrics(none, ["symbol"]).count() == 0
    assert performance.equity_curve(none, ["symbol"]).count() == 0
