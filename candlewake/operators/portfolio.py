"""Cross-symbol voting, portfolio statistics and signal correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewake.functions.scoring import direction

MIN_CONFIDENCE, MIN_AGREEMENT = 0.60, 3


def common_times(predictions: DataFrame, n_pairs: int) -> DataFrame:
    """Rows at times that every one of the ``n_pairs`` symbols has."""
    times = (
        predictions.groupBy("ts")
        .agg(F.count_distinct("symbol").alias("_n"))
        .where(F.col("_n") == n_pairs)
        .select("ts")
    )
    return predictions.join(times, "ts", "left_semi")


def vote(
    predictions: DataFrame,
    weights: DataFrame | None = None,
    min_confidence: float = MIN_CONFIDENCE,
    min_agreement: int = MIN_AGREEMENT,
) -> DataFrame:
    """One portfolio signal per time from the signals of all symbols.

    ``weights`` (symbol, weight) defaults to 1 for every symbol.
    """
    p = predictions
    if weights is None:
        p = p.withColumn("weight", F.lit(1.0))
    else:
        p = p.join(weights, "symbol", "left").withColumn(
            "weight", F.coalesce("weight", F.lit(1.0))
        )
    probs = {"buy": "pred_buy_prob", "sell": "pred_sell_prob", "hold": "pred_hold_prob"}
    p = p.withColumn("_conf", F.greatest(*probs.values())).withColumn(
        "_dir", direction(F.col("signal"))
    )
    counted = F.col("_conf") >= min_confidence
    word = F.when(F.col("_dir") == 1, "BUY").when(F.col("_dir") == -1, "SELL").otherwise("HOLD")
    buy, sell = counted & (F.col("_dir") == 1), counted & (F.col("_dir") == -1)
    active = F.collect_list(F.when(counted, F.concat_ws(":", "symbol", word)))
    votes = p.groupBy("ts").agg(
        F.count_if(buy).alias("buy_votes"),
        F.count_if(sell).alias("sell_votes"),
        F.count_if(counted & (F.col("_dir") == 0)).alias("hold_votes"),
        F.avg(F.when(buy, F.col("_conf"))).alias("_buy_conf"),
        F.avg(F.when(sell, F.col("_conf"))).alias("_sell_conf"),
        *[
            F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum("weight")).alias(
                f"weighted_{n}_prob"
            )
            for n, c in probs.items()
        ],
        F.array_join(F.sort_array(active), ", ").alias("active_pairs"),
        F.count_if(counted).alias("num_active_pairs"),
    )
    buys, sells = F.col("buy_votes") >= min_agreement, F.col("sell_votes") >= min_agreement
    return votes.withColumns(
        {
            "portfolio_signal": F.when(buys, 1).when(sells, -1).otherwise(0),
            "portfolio_confidence": F.when(buys, F.col("_buy_conf"))
            .when(sells, F.col("_sell_conf"))
            .otherwise(0.0),
        }
    ).drop("_buy_conf", "_sell_conf")


def vote_statistics(votes: DataFrame) -> DataFrame:
    s = F.col("portfolio_signal")
    n = F.count(F.lit(1))
    shares = []
    for name, v in (("buy", 1), ("sell", -1), ("hold", 0)):
        shares += [
            F.count_if(s == v).alias(f"{name}_signals"),
            F.try_divide(F.count_if(s == v) * 100.0, n).alias(f"{name}_percent"),
        ]
    return votes.agg(
        n.alias("total_signals"),
        *shares,
        F.coalesce(F.avg(F.when(s != 0, F.col("portfolio_confidence"))), F.lit(0.0)).alias(
            "avg_confidence"
        ),
        F.avg("num_active_pairs").alias("avg_active_pairs"),
    )


def signal_correlation(predictions: DataFrame, symbols: list[str]) -> DataFrame:
    """Pearson correlation of signals on common times, one row per pair of symbols.

    The configured symbols become columns of one aggregate row per time, so no pairs of
    rows are formed. A constant series has no correlation.
    """
    by_time = predictions.groupBy("ts").agg(
        *[
            F.max(F.when(F.col("symbol") == s, direction(F.col("signal")))).alias(s)
            for s in symbols
        ]
    )
    common = by_time.dropna(how="any", subset=symbols)
    pairs = list(combinations(symbols, 2))
    value = lambda c: F.col(c).cast("double")
    corr = lambda a, b: F.try_divide(
        F.covar_pop(value(a), value(b)), F.stddev_pop(value(a)) * F.stddev_pop(value(b))
    )
    wide = common.agg(F.count(F.lit(1)).alias("_n"), *[corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).where("_n > 0")
    rows = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r"))
        for a, b in pairs
    ]
    return wide.select(F.inline(F.array(*rows)))
