"""Row index, block copies and recursions against plain sequential code."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewake.operators import indicators as ind
from candlewake.operators import scan
from candlewake.operators.blocks import IDX, indexed_blocks, with_row_index
from tests.helpers import random_bars, same


def by_key(df):
    return df.toPandas().sort_values(["symbol", "ts"], ignore_index=True)


def test_row_index_counts_from_zero_per_key(spark):
    pdf = random_bars(500)
    df = spark.createDataFrame(pdf).repartition(7)
    got = by_key(with_row_index(df, ["symbol"], ["ts"], F.to_date("ts"), "row", "total"))
    assert (got["row"] == got.groupby("symbol").cumcount()).all()
    assert (got["total"] == 500).all()


@pytest.mark.parametrize("block", [64, 256])
def test_small_blocks_see_their_neighbours(spark, block):
    """lag, lead and trailing frames across block borders equal those of the uncut key."""
    pdf = random_bars(700)
    df = spark.createDataFrame(pdf)
    b = indexed_blocks(df, ["symbol"], ["ts"], F.to_date("ts"), 50, 26, block, 64)
    out = b.add(
        {
            "prev": F.lag("close", 7).over(b.rows),
            "next": F.lead("close", 26).over(b.rows),
            "mean": F.avg("close").over(b.last(50)),
        }
    ).close()
    got = by_key(out)
    assert len(got) == len(pdf)
    g = got.groupby("symbol")["close"]
    same(got["prev"], g.shift(7))
    same(got["next"], g.shift(-26))
    same(got["mean"], g.transform(lambda s: s.rolling(50, min_periods=1).mean()))


def sequential(x, r: scan.Recursion):
    y = np.full(len(x), np.nan)
    value = 0.0
    for i, v in enumerate(x):
        if i < r.first:
            continue
        if i < r.seed_at:
            value += v
        elif i == r.seed_at:
            value = (value + v) / r.seed_div
        else:
            value = r.beta * value + r.gain * v
        if i >= (r.seed_at if r.show_from is None else r.show_from):
            y[i] = value
    return y


@pytest.mark.parametrize("block,segment", [(2048, 256), (1024, 512), (32768, 2048)])
def test_recursions_equal_a_sequential_fold(spark, block, segment):
    pdf = random_bars(5000, symbols=("EUR_USD",), step="15min")
    specs = [
        scan.ema("fast", "close", 12, first=14),
        scan.ema("slow", "close", 50),
        scan.wilder("wilder", "close", 14),
        scan.wilder_sum("wsum", "close", 14, 14),
        scan.ema_unseeded("plain", "close", 9),
    ]
    back = max(scan.reach(r.beta) for r in specs)
    b = indexed_blocks(
        spark.createDataFrame(pdf), ["symbol"], ["ts"], F.to_date("ts"), back, 0, block, segment
    )
    got = by_key(scan.apply(b, specs).close())
    for r in specs:
        same(got[r.name], sequential(pdf["close"].to_numpy(), r), 1e-10)


def test_segment_shrinks_for_fast_smoothing():
    assert scan.segment_rows_for(0.5) == 512
    assert scan.segment_rows_for(1 - 2 / 201) == 2048


def test_features_do_not_depend_on_the_block_size(spark):
    df = spark.createDataFrame(random_bars(9000, symbols=("EUR_USD",), step="5min"))
    cols = ["symbol", "ts", "ema_200", "rsi", "adx", "macd_signal", "ichi_chikou", "atr_zscore", "cci"]
    one = by_key(ind.base_features(df).select(*cols))
    many = by_key(ind.base_features(df, block_rows=64).select(*cols))
    assert len(one) == len(many) == 9000
    for n in cols[2:]:
        same(one[n], many[n], 1e-9)


def test_feature_bounds_and_warm_up(spark):
    got = by_key(ind.base_features(spark.createDataFrame(random_bars(400, symbols=("EUR_USD",)))))
    assert got["rsi"].dropna().between(0, 100).all() and got["rsi"].isna().sum() == 14
    assert got["adx"].isna().sum() == 27 and got["ema_200"].isna().sum() == 199
    assert got["macd"].isna().sum() == 33 and got["stoch_d"].isna().sum() == 17
    assert got["ichi_chikou"].tail(26).isna().all()
    assert got["bb_position"].dropna().between(0, 1).all()
    assert set(got["ema_50_200_cross"].head(199)) == {-1}
    assert set(got["rsi_overbought"].head(14)) == {0}
    assert len(ind.BASE_FEATURES) == 74 and len(ind.CROSS_FEATURES) == 3


def test_lookahead_can_be_left_out(spark):
    df = spark.createDataFrame(random_bars(60))
    assert "ichi_chikou" not in ind.base_features(df, drop_lookahead=True).columns


def test_one_row_symbol(spark):
    got = by_key(ind.base_features(spark.createDataFrame(random_bars(1))))
    assert len(got) == 2 and got["rsi"].isna().all() and (got["squeeze_on"] == 0).all()
    assert IDX not in got.columns


def test_no_window_is_partitioned_by_symbol_alone(spark):
    """Every window of the feature job is bounded by a block or a day, or runs on day counts."""
    df = ind.base_features(spark.createDataFrame(random_bars(50)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lone = [
        line
        for line in plan.splitlines()
        if "Window [" in line and "], [symbol#" in line and "_blk" not in line and "_bucket" not in line
    ]
    assert lone == []
    assert pd.Series(plan).str.count("BatchEvalPython|ArrowEvalPython").iloc[0] == 0
