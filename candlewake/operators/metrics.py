"""Classification metrics, fold summaries, model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the improvement score and the deploy rule.
IMPROVEMENT_WEIGHTS = {"accuracy": 0.2, "f1": 0.3, "sharpe": 0.3, "total_return": 0.2}
MIN_IMPROVEMENT, MIN_IMPROVED_PAIRS = 0.02, 2


def confusion(df: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Counts per key, true class and predicted class."""
    return df.groupBy(*keys, truth, pred).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Support, recall, precision and F1 per class that occurs in truth or prediction."""
    cells = confusion(df, keys, truth, pred)
    sides = cells.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.col(truth).alias("cls"), F.col("n").alias("_support"), F.lit(0).alias("_hits"),
                    F.lit(0).alias("_predicted"),
                ),
                F.struct(
                    F.col(pred).alias("cls"), F.lit(0).alias("_support"),
                    F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("_hits"),
                    F.col("n").alias("_predicted"),
                ),
            )
        ),
    )
    per = sides.groupBy(*keys, "cls").agg(
        F.sum("_support").alias("support"),
        F.sum("_hits").alias("_hits"),
        F.sum("_predicted").alias("_predicted"),
    )
    f1 = F.coalesce(
        F.try_divide(2.0 * F.col("_hits"), F.col("support") + F.col("_predicted")), F.lit(0.0)
    )
    return per.select(
        *keys,
        "cls",
        "support",
        F.try_divide(F.col("_hits").cast("double"), "support").alias("recall"),
        F.coalesce(F.try_divide(F.col("_hits").cast("double"), "_predicted"), F.lit(0.0)).alias(
            "precision"
        ),
        f1.alias("f1"),
        "_hits",
    )


def summary_metrics(df: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Balanced accuracy, weighted F1, accuracy and profit factor per key."""
    per = class_metrics(df, keys, truth, pred)
    n, hits = F.sum("support"), F.sum("_hits")
    wrong = n - hits
    return per.groupBy(*keys).agg(
        n.alias("samples"),
        F.avg("recall").alias("balanced_accuracy"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), n).alias("f1_score"),
        F.try_divide(hits.cast("double"), n).alias("accuracy"),
        profit_factor(hits, wrong).alias("profit_factor"),
    )


def profit_factor(correct: Column, wrong: Column) -> Column:
    """Right over wrong predictions; infinite when none is wrong."""
    return F.when(wrong == 0, F.lit(float("inf"))).otherwise(
        F.try_divide(correct.cast("double"), wrong)
    )


def fold_summary(folds: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean and sample deviation of each metric over the folds of a key."""
    keys = keys or ["symbol"]
    aggs = [F.count(F.lit(1)).alias("folds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return folds.groupBy(*keys).agg(*aggs)


def model_averages(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean of each metric per pair and version; optional ones default to 0."""
    keys = keys or ["pair", "version"]
    aggs = [F.avg(m).alias(m) for m in ("accuracy", "precision", "recall", "f1")]
    for source, name in (("sharpe_ratio", "sharpe"), ("total_return", "total_return")):
        value = F.coalesce(F.avg(source), F.lit(0.0)) if source in metrics.columns else F.lit(0.0)
        aggs.append(value.alias(name))
    return metrics.groupBy(*keys).agg(*aggs)


def compare_models(old: DataFrame, new: DataFrame, pair: str = "pair") -> DataFrame:
    """Weighted relative gain per pair; a pair with one side missing is not improved."""
    names = list(IMPROVEMENT_WEIGHTS)
    o = old.select(pair, F.lit(True).alias("_o"), *[F.col(n).alias(f"old_{n}") for n in names])
    n_ = new.select(pair, F.lit(True).alias("_n"), *[F.col(n).alias(f"new_{n}") for n in names])
    both = o.join(n_, pair, "full")
    score = F.lit(0.0)
    for name, weight in IMPROVEMENT_WEIGHTS.items():
        before, after = F.col(f"old_{name}"), F.col(f"new_{name}")
        gain = F.when(before > 0, F.try_divide(after - before, before) * weight)
        score = score + F.coalesce(gain, F.lit(0.0))
    present = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    scored = both.withColumn("improvement_score", F.when(present, score))
    improved = F.coalesce(F.col("improvement_score") > MIN_IMPROVEMENT, F.lit(False))
    reason = (
        F.when(F.col("improvement_score").isNull(), "Missing metrics")
        .when(improved, F.format_string("%.2f%% improvement", F.col("improvement_score") * 100))
        .otherwise("Insufficient improvement")
    )
    return scored.select(
        pair, "improvement_score", improved.alias("improved"), reason.alias("reason")
    )


def deploy_decision(comparison: DataFrame) -> DataFrame:
    improved = F.count_if("improved")
    return comparison.agg(
        improved.alias("improved_count"),
        F.count(F.lit(1)).alias("total_pairs"),
        (improved >= MIN_IMPROVED_PAIRS).alias("should_deploy"),
    )


def quality_summary(signals: DataFrame, keys: list[str] | None = None, high: float = 60) -> DataFrame:
    """Trades other than HOLD and the share of them with high quality."""
    keys = keys or ["symbol"]
    live = F.col("signal") != "HOLD"
    good = live & (F.col("quality_score") >= high)
    return signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count_if(live).alias("signals"),
        F.count_if(good).alias("high_quality"),
        F.coalesce(F.try_divide(F.count_if(good) * 100.0, F.count_if(live)), F.lit(0.0)).alias(
            "high_quality_percent"
        ),
    )
