"""Worked cases of the scoring, gate, risk and comparison rules."""

import pandas as pd
from pyspark.sql import functions as F

from candlewake.functions import gates, risk, scoring
from candlewake.operators import events, folds, labels, metrics, portfolio, quality, trading
from candlewake.plans.features import feature_table
from tests.helpers import random_bars


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_quality_score_worked_example(spark):
    row = {
        n: F.lit(v)
        for n, v in dict(
            close=1.05, ema_50=1.048, ema_200=1.045, macd=0.0005, macd_signal=0.0003, atr_zscore=0.8, stoch_k=60.0
        ).items()
    }
    parts = scoring.quality_parts(F.lit(0.75), F.lit(0), row, F.lit(55.0))
    got = one(spark, **parts)
    assert [round(got[n], 9) for n in ("confidence", "trend", "volatility", "momentum")] == [24, 20, 16, 12]
    size = one(spark, s=scoring.position_size(F.lit(72.0)), t=scoring.should_trade(F.lit(72.0)))
    assert size["s"] == 0.75 and size["t"]


def test_momentum_at_exactly_30_and_70(spark):
    for r in (30.0, 70.0):
        got = one(spark, m=scoring.momentum_score(F.lit(0), F.lit(r), F.lit(90.0)))
        assert got["m"] == 0.0


def test_session_past_midnight(spark):
    hours = {21: False, 22: True, 23: True, 0: True, 1: True, 2: False}
    got = one(spark, **{f"h{h}": gates.in_hours(F.lit(h), 22, 2) for h in hours})
    assert all(got[f"h{h}"] == want for h, want in hours.items())


def test_symbol_names(spark):
    got = one(
        spark,
        a=gates.pair_name(F.lit("EURUSD.ecn")),
        b=gates.pair_name(F.lit("DE40")),
        c=gates.is_allowed(F.lit("eurusd.ecn")),
        d=gates.is_allowed(F.lit("XAUUSD")),
    )
    assert (got["a"], got["b"], got["c"], got["d"]) == ("EUR_USD", "DE40", True, False)


def test_daily_limit_scenario(spark):
    times = ["08:00", "10:00", "14:00", "16:00", "18:00"]
    sides = ["BUY", "BUY", "SELL", "SELL", "BUY"]
    pdf = pd.DataFrame(
        {"symbol": "EUR_USD", "side": sides, "ts": pd.to_datetime([f"2024-01-02 {t}" for t in times])}
    )
    got = trading.daily_first(spark.createDataFrame(pdf), ["ts"]).orderBy("ts").collect()
    assert [(r["side"], r["ts"].hour) for r in got] == [("BUY", 8), ("SELL", 14)]


def test_loss_blocks_its_own_side_until_a_win(spark):
    deals = pd.DataFrame(
        {
            "symbol": "a", "side": "BUY", "ticket": [1, 2],
            "close_ts": pd.to_datetime(["2024-01-01", "2024-01-03"]), "profit": [-5.0, 4.0],
        }
    )
    streaks = trading.loss_streaks(
        spark.createDataFrame(deals), ["symbol", "side"], ["close_ts", "ticket"], F.to_date("close_ts")
    )
    sig = pd.DataFrame(
        {"symbol": "a", "side": ["BUY", "SELL", "BUY"], "ts": pd.to_datetime(["2024-01-02", "2024-01-02", "2024-01-04"])}
    )
    got = trading.block_after_loss(spark.createDataFrame(sig), streaks).orderBy("ts").collect()
    assert [(r["side"], r["ts"].day) for r in got] == [("SELL", 2), ("BUY", 4)]


def test_deploy_when_two_of_four_improve(spark):
    gains = [0.035, 0.018, 0.042, -0.005]
    base = dict(accuracy=0.5, f1=0.5, sharpe=1.0, total_return=1.0)
    old = pd.DataFrame([{"pair": f"p{i}", **base} for i in range(4)])
    new = pd.DataFrame(
        [{"pair": f"p{i}", **{k: v * (1 + g) for k, v in base.items()}} for i, g in enumerate(gains)]
    )
    c = metrics.compare_models(spark.createDataFrame(old), spark.createDataFrame(new))
    d = metrics.deploy_decision(c).first()
    assert (d["improved_count"], d["total_pairs"], d["should_deploy"]) == (2, 4, True)


def test_missing_side_is_not_improved(spark):
    row = dict(accuracy=0.5, f1=0.5, sharpe=1.0, total_return=1.0)
    a = spark.createDataFrame(pd.DataFrame([{"pair": "x", **row}]))
    b = spark.createDataFrame(pd.DataFrame([{"pair": "y", **row}]))
    assert all(r["reason"] == "Missing metrics" for r in metrics.compare_models(a, b).collect())


def test_sequence_count(spark):
    df = spark.createDataFrame(random_bars(1000, symbols=("EUR_USD",)))
    assert labels.sequences(df, ["close"], 22, block_rows=64, segment_rows=64).count() == 979


def test_risk_and_lots(spark):
    spec = {
        n: F.lit(v)
        for n, v in dict(
            volume_min=0.01, volume_max=50.0, volume_step=0.01, point=1e-5, tick_size=1e-5, tick_value=1.0,
            margin_initial=1000.0,
        ).items()
    }
    r = one(
        spark,
        top=risk.risk_percent(F.lit(0.8), F.lit(0)),
        capped=risk.risk_percent(F.lit(0.9), F.lit(9)),
        none=risk.risk_percent(F.lit(0.5), F.lit(2)),
        lots=risk.lot_size(F.lit(10000.0), F.lit(1.0), F.lit(200.0), spec),
        poor=risk.lot_size(F.lit(9.0), F.lit(1.0), F.lit(200.0), spec),
        margin=risk.lot_size(F.lit(10000.0), F.lit(5.0), F.lit(20.0), spec, 50),
    )
    assert r["top"] == 2.0 and r["capped"] == 5.0 and r["none"] == 0.0
    assert r["lots"] == 0.5 and r["poor"] == 0.01 and r["margin"] == 5.0


def test_surprise_needs_five_releases_and_caps(spark):
    pdf = pd.DataFrame(
        {
            "event_name": "cpi",
            "ts": pd.date_range("2024-01-01", periods=8),
            "actual_value": [1.0, 1, 1, 1, 1, 1, 1, 99],
            "consensus_forecast": 0.0,
        }
    )
    got = events.surprise_zscore(spark.createDataFrame(pdf)).orderBy("ts").collect()
    z = [r["surprise_zscore"] for r in got]
    assert z[4] == 5.0  # a constant non-zero error has no deviation
    assert abs(z[0] - (1 - pdf.actual_value.mean()) / pdf.actual_value.std()) < 1e-12
    assert -5 <= min(z) and max(z) <= 5


def test_folds_keep_time_order(spark):
    df = spark.createDataFrame(random_bars(500, symbols=("EUR_USD",), step="1D"))
    b = folds.fold_bounds(df, ["symbol"])
    got = folds.assign_folds(df, b, ["symbol"]).groupBy("fold", "role").agg(F.min("ts"), F.max("ts")).collect()
    spans = {(r["fold"], r["role"]): (r[2], r[3]) for r in got}
    assert len(spans) == 2 * b.count() > 4
    for fold in range(1, b.count() + 1):
        assert spans[(fold, "train")][1] < spans[(fold, "test")][0]
    assert folds.fold_sizes(df, ["symbol"]).count() == 0  # fewer than the default training rows


def test_votes_need_agreement_and_confidence(spark):
    rows = [("a", "BUY", 0.7), ("b", "BUY", 0.65), ("c", "BUY", 0.6), ("d", "SELL", 0.99), ("e", "BUY", 0.59)]
    pdf = pd.DataFrame(
        [
            dict(symbol=s, ts=pd.Timestamp("2024-01-01"), signal=d, pred_buy_prob=p, pred_sell_prob=0.0, pred_hold_prob=0.0)
            for s, d, p in rows
        ]
    )
    v = portfolio.vote(spark.createDataFrame(pdf)).first()
    assert (v["buy_votes"], v["sell_votes"], v["portfolio_signal"], v["num_active_pairs"]) == (3, 1, 1, 4)
    assert abs(v["portfolio_confidence"] - 0.65) < 1e-12


def test_required_fields_split(spark):
    df = spark.createDataFrame([("1.5", "7"), ("x", "7"), (None, None)], "open string, volume string")
    good, bad = quality.split_required(df, {"open": "double", "volume": "bigint"})
    assert good.collect() == [(1.5, 7)]
    assert sorted(r["missing_fields"] for r in bad.collect()) == ["open", "open,volume"]


def test_feature_table_contract(spark):
    bars = spark.createDataFrame(random_bars(2600, symbols=("EUR_USD",), step="5min"))
    out = feature_table(bars, {"H": "15 minutes", "Q": "1 hour"}, block_rows=2048)
    assert len(out.columns) - 7 == 96
    assert out.columns[7] == "ema_50" and out.columns[-1] == "weighted_surprise"
    assert out.count() > 0


def test_bars_without_a_time_are_counted_and_latest_rows_agree(spark):
    from candlewake.operators import labels, quality

    t = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"
    day = lambda d: pd.Timestamp(f"2024-01-{d:02d}").to_pydatetime()
    rows = [("a", day(d), 1.0, 2.0, 0.5, 1.5, 1) for d in (1, 2, 2, 5)] + [("a", None, 1.0, 2.0, 0.5, 1.5, 1), (None, day(1), 1.0, 2.0, 0.5, 1.5, 1)]
    got = {r["symbol"]: r for r in quality.quality_report(spark.createDataFrame(rows, t), 86400).collect()}
    assert (got["a"]["total_rows"], got["a"]["missing_values"], got["a"]["duplicate_timestamps"], got["a"]["gaps"]) == (5, 1, 1, 1)
    assert got[None]["missing_values"] == 1
    many = spark.createDataFrame([("a", day(1 + i % 28) + pd.Timedelta(seconds=i // 28).to_pytimedelta(), i) for i in range(2500)], "symbol string, ts timestamp, n int")
    for n in (7, 1500):
        assert labels.latest_rows(many, n).count() == n
    assert labels.latest_rows(many, 1500).agg({"ts": "min"}).first()[0] == sorted(r["ts"] for r in many.collect())[-1500]


def test_a_contract_with_zero_sizes_gets_the_smallest_lot(spark):
    from pyspark.sql import functions as F

    from candlewake.functions import risk

    names = ("point", "tick_size", "tick_value", "volume_min", "volume_max", "volume_step", "margin_initial")
    df = spark.createDataFrame([(0.1, 0.0, 0.0, 0.01, 50.0, 0.0, 0.0)], ", ".join(f"{n} double" for n in names))
    lots = risk.lot_size(F.lit(1000.0), F.lit(1.0), F.lit(20.0), {n: F.col(n) for n in names}, max_margin_percent=50)
    assert df.select(lots).first()[0] == 0.01
