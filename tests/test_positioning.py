"""The range of positioning reports against a loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from candlewake.operators.positioning import positioning, positioning_on_bars

SCHEMA = "symbol string, ts timestamp, long double, short double, open_interest double"


def test_index_equals_a_loop(spark):
    rng = random.Random(3)
    start = dt.datetime(2020, 1, 1)
    rows = [
        (s, start + dt.timedelta(days=rng.randrange(0, 900), hours=rng.choice([0, 12])), rng.randrange(90), rng.randrange(90), rng.choice([0, 50, 100]))
        for s in "AB" for _ in range(150)
    ]
    rows = [(s, t, float(a), float(b), float(c)) for s, t, a, b, c in rows] + [(None, start, 1.0, 1.0, 1.0), ("A", None, 1.0, 1.0, 1.0), ("A", start, None, 1.0, 1.0)]
    got = positioning(spark.createDataFrame(rows, SCHEMA), ["symbol"], weeks=9).collect()
    assert len(got) == 301
    week = lambda t: (t.date() - dt.date(1970, 1, 1)).days // 7
    net = lambda r: (r[2] - r[3]) / r[4] if r[4] and r[2] is not None else None
    for g in got:
        assert g.net_position == (pytest.approx(net(g)) if net(g) is not None else None)
        seen = [net(r) for r in rows if r[0] == g.symbol and r[1] and r[1] <= g.ts and week(r[1]) > week(g.ts) - 9 and net(r) is not None]
        if g.net_position is None or max(seen) == min(seen):
            assert g.position_index is None
        else:
            assert g.position_index == pytest.approx((net(g) - min(seen)) / (max(seen) - min(seen)))


def test_bars_take_the_latest_report(spark):
    reports = spark.createDataFrame([("A", dt.datetime(2024, 1, d), float(d), 0.0, 10.0) for d in (2, 9, 16)], SCHEMA)
    bars = spark.createDataFrame([("A", dt.datetime(2024, 1, d)) for d in (1, 2, 8, 20)] + [("B", dt.datetime(2024, 1, 9))], "symbol string, ts timestamp")
    out = positioning_on_bars(bars, positioning(reports, ["symbol"]), ["symbol"])
    got = {(r.symbol, r.ts.day): (r.net_position, r.position_index) for r in out.collect()}
    assert got == {("A", 1): (None, None), ("A", 2): (0.2, None), ("A", 8): (0.2, None), ("A", 20): (1.6, 1.0), ("B", 9): (None, None)}
    assert positioning(reports.limit(0), ["symbol"]).count() == 0
