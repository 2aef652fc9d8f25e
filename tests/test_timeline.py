"""Time joins and running totals against brute force, with ties and crowded keys."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from candlewake.operators import stats, timeline, trading
from tests.helpers import random_bars, same


def sort(df, *by):
    return df.toPandas().sort_values(list(by), ignore_index=True)


def test_asof_matches_far_and_equal_times(spark):
    rng = np.random.default_rng(1)
    left = pd.DataFrame(
        {
            "symbol": rng.choice(["a", "a", "b"], 400),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40 * 24, 400), "h"),
            "id": range(400),
        }
    )
    right = pd.DataFrame(
        {
            "symbol": ["a"] * 5 + ["b"] * 2,
            "ts": pd.to_datetime(
                ["2024-01-02", "2024-01-03 05:00", "2024-01-20", "2024-01-20 01:00", "2024-02-05", "2024-01-10", "2024-01-11"],
                format="mixed",
            ),
            "v": range(7),
        }
    )
    for direction in ("backward", "forward"):
        got = sort(
            timeline.asof_join(
                spark.createDataFrame(left), spark.createDataFrame(right), ["symbol"], ["v"], direction=direction
            ),
            "id",
        )
        want = pd.merge_asof(
            left.sort_values("ts"), right.sort_values("ts"), on="ts", by="symbol", direction=direction
        ).sort_values("id")
        same(got["v"], want["v"])


def events_frame(bars, n=60, seed=3):
    rng = np.random.default_rng(seed)
    ts = rng.choice(bars["ts"], n // 2).tolist()
    ts += [t + pd.Timedelta(minutes=17) for t in rng.choice(bars["ts"], n - len(ts))]
    return pd.DataFrame(
        {
            "symbol": rng.choice(["EUR_USD", "USD_JPY"], n, p=[0.9, 0.1]),
            "ts": pd.to_datetime(ts),
            "surprise_zscore": np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n)),
        }
    )


def test_event_proximity_equals_all_pairs(spark):
    bars = random_bars(240)
    ev = events_frame(bars)
    known = spark.createDataFrame(ev).withColumn(
        "surprise_zscore", F.when(~F.isnan("surprise_zscore"), F.col("surprise_zscore"))
    )
    got = sort(timeline.event_proximity(spark.createDataFrame(bars), known), "symbol", "ts")
    for row in got.itertuples():
        mine = ev[(ev["symbol"] == row.symbol) & ev["surprise_zscore"].notna()]
        h = (row.ts - mine["ts"]).dt.total_seconds() / 3600
        post = mine[(h >= 0) & (h < 48)]
        hp = h[(h >= 0) & (h < 48)]
        before = -h[(h < 0) & (h >= -24)]
        assert abs(row.tau_pre - (1 / (1 + before / 24)).max() if len(before) else row.tau_pre) < 1e-12
        assert abs(row.tau_post - np.exp(-0.1 * hp).max() if len(hp) else row.tau_post) < 1e-12
        assert abs(row.weighted_surprise - (post["surprise_zscore"] * np.exp(-0.1 * hp)).sum()) < 1e-9


def test_event_at_bar_time_counts_as_past(spark):
    bars = random_bars(5, symbols=("EUR_USD",))
    ev = pd.DataFrame({"symbol": ["EUR_USD"], "ts": [bars["ts"][2]], "surprise_zscore": [2.0]})
    got = sort(timeline.event_proximity(spark.createDataFrame(bars), spark.createDataFrame(ev)), "ts")
    assert got["tau_post"][2] == 1.0 and got["tau_pre"][2] == 0.0 and got["weighted_surprise"][2] == 2.0
    assert 0.5 <= got["tau_pre"][1] < 1 and got["tau_post"][1] == 0.0


def test_blackout_with_other_buckets_keeps_the_same_rows(spark):
    bars = random_bars(300, symbols=("EUR_USD",), step="7min")
    ev = events_frame(bars, 12)
    ev["symbol"] = "EUR_USD"
    df, marks = spark.createDataFrame(bars), spark.createDataFrame(ev)
    plain = sort(timeline.outside_blackout(df, marks, ["symbol"]), "ts")["ts"]
    salted = sort(
        timeline.outside_blackout(df, marks, ["symbol"], bucket_us=timeline.DAY), "ts"
    )["ts"]
    half = pd.Timedelta(minutes=30)
    want = [t for t in bars["ts"] if not ((ev["ts"] - t).abs() <= half).any()]
    assert list(plain) == list(salted) == want


def deals(seed=5, n=500):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "symbol": rng.choice(["a", "b"], n, p=[0.8, 0.2]),
            "close_ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 60, n), "D"),
            "ticket": range(n),
            "profit": rng.integers(-3, 3, n).astype(float),
        }
    )


def test_loss_streak_and_depth_equal_sequential_counters(spark):
    pdf = deals()
    df = spark.createDataFrame(pdf)
    args = (["symbol"], ["close_ts", "ticket"], F.to_date("close_ts"))
    streak = dict(trading.loss_streaks(df, *args).select("ticket", "loss_count").collect())
    depth = dict(trading.recovery_depth(df, *args).select("ticket", "depth").collect())
    for _, g in pdf.sort_values(["close_ts", "ticket"]).groupby("symbol"):
        losses = walk = 0
        for r in g.itertuples():
            losses = losses + 1 if r.profit < 0 else 0 if r.profit > 0 else losses
            walk = walk + 1 if r.profit < 0 else max(0, walk - 1)
            assert streak[r.ticket] == losses and depth[r.ticket] == walk


def test_open_positions_include_open_and_exclude_close(spark):
    pos = pd.DataFrame(
        {
            "symbol": "a",
            "open_ts": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-02"]),
            "close_ts": pd.to_datetime(["2024-01-03", "2024-01-05", "2024-01-04"]),
        }
    )
    sig = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2023-12-31", periods=7)})
    got = sort(trading.open_position_count(spark.createDataFrame(sig), spark.createDataFrame(pos)), "ts")
    assert list(got["open_positions"]) == [0, 1, 3, 2, 1, 0, 0]


def test_exit_is_strictly_after_opening_and_confident(spark):
    pos = pd.DataFrame({"symbol": ["a"], "side": ["BUY"], "open_ts": pd.to_datetime(["2024-01-02"])})
    sig = pd.DataFrame(
        {
            "symbol": "a",
            "ts": pd.date_range("2024-01-01", periods=5),
            "side": ["SELL", "SELL", "BUY", "SELL", "SELL"],
            "confidence": [0.9, 0.9, 0.9, 0.59, 0.6],
        }
    )
    row = trading.first_exit(spark.createDataFrame(pos), spark.createDataFrame(sig)).first()
    assert str(row["exit_ts"]) == "2024-01-05 00:00:00" and row["exit_confidence"] == 0.6


def test_gap_fill(spark):
    bars = random_bars(60, symbols=("EUR_USD",)).drop(index=[5, 6, 20]).reset_index(drop=True)
    df = spark.createDataFrame(bars)
    grid = bars.set_index("ts")["close"].resample("1h").asfreq()
    wants = {"ffill": grid.ffill(), "bfill": grid.bfill(), "time": grid.interpolate("time")}
    for how, want in wants.items():
        same(sort(timeline.fill_gaps(df, 3600, ["close"], how), "ts")["close"], want, 1e-12)


def test_wide_correlation_equals_pandas(spark):
    rng = np.random.default_rng(0)
    names = [f"f{i}" for i in range(24)]
    pdf = pd.DataFrame(rng.normal(1e4, 1, (600, 24)), columns=names)
    pdf["f1"] = pdf["f0"] + rng.normal(0, 0.01, 600)
    pdf["f2"] = 3.0
    pdf.loc[::7, "f3"] = np.nan
    pdf["symbol"] = ["a", "b"] * 300
    df = spark.createDataFrame(pdf).withColumn("f3", F.when(~F.isnan("f3"), F.col("f3")))
    got = stats.feature_correlation(df, names)
    for s, g in pdf.groupby("symbol"):
        want = g[names].corr().abs()
        for r in got.where(F.col("symbol") == s).collect():
            w = want.loc[r["a"], r["b"]]
            assert (r["r"] is None and np.isnan(w)) or abs(r["r"] - w) < 1e-8
    drop = stats.correlated_features(got).toPandas()
    assert set(drop["feature"]) == {"f1"} and set(drop["partners"]) == {"f0"}
