"""Search over the parameters of boosted trees: a seeded draw and successive halving over folds.

All trials are judged on one fold; the better half goes on to the next fold, until one is
left or the folds for selection are used up. A model sees only times before the fold that
judges it, and the last fold judges nothing but the chosen trial. Trials of a round are
fitted side by side: a fit of a small table leaves most of a cluster idle.
"""

from __future__ import annotations

import contextvars
import hashlib
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewake.operators import trees
from candlewake.operators.learning import PROBS, class_weight
from candlewake.operators.metrics import summary_metrics

# The parameters and their ranges, both ends included.
RANGES: dict[str, tuple[str, float, float]] = {
    "learning_rate": ("log", 0.001, 0.1),
    "max_depth": ("int", 3, 10),
    "n_estimators": ("int", 100, 500),
    "subsample": ("float", 0.6, 1.0),
    "colsample": ("float", 0.6, 1.0),
    "min_child_weight": ("int", 1, 7),
    "gamma": ("float", 0.0, 0.5),
    "reg_alpha": ("float", 0.0, 0.1),
    "reg_lambda": ("float", 0.5, 2.0),
}
SEED = 42
OBJECTIVES = ("balanced_accuracy", "f1_score", "profit_factor")
Params = dict[str, float]


def share(seed: int, trial: int, name: str) -> float:
    """A number in [0, 1) that depends on nothing but its arguments: 48 bits of a digest."""
    return int(hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()[:12], 16) / 2**48


def draw(trials: int, ranges: dict[str, tuple[str, float, float]] = RANGES, seed: int = SEED) -> list[Params]:
    """Parameters of each trial; more trials do not change the first ones."""
    out = []
    for trial in range(trials):
        params = {}
        for name, (kind, low, high) in ranges.items():
            u = share(seed, trial, name)
            if kind == "int":
                params[name] = int(low) + math.floor(u * (int(high) - int(low) + 1))
            elif kind == "log":
                params[name] = math.exp(math.log(low) + u * (math.log(high) - math.log(low)))
            else:
                params[name] = low + u * (high - low)
        out.append(params)
    return out


def fit(train: DataFrame, features: list[str], params: Params, label: str = "target_class", seed: int = SEED) -> PipelineModel:
    """Boosted trees, one class against the others, on the complete rows of ``train``.

    ``colsample`` is drawn for each split. ``gamma`` is the least gain of a split, added up over
    all rows (the learner takes it for each row), and ``min_child_weight`` counts rows.
    ``reg_alpha`` and ``reg_lambda`` act on the exported leaves (:func:`shrunk`).
    """
    weighted = train.dropna(subset=[*features, label]).withColumn("_weight", class_weight(F.col(label)))
    one = GBTClassifier(
        stepSize=params["learning_rate"], maxDepth=int(params["max_depth"]), maxIter=int(params["n_estimators"]),
        subsamplingRate=params["subsample"], featureSubsetStrategy=str(params["colsample"]),
        minInstancesPerNode=int(params["min_child_weight"]), minInfoGain=params["gamma"] / max(1, weighted.count()),
        seed=seed, featuresCol="_features", labelCol=label,
    )
    every = OneVsRest(classifier=one, featuresCol="_features", labelCol=label, weightCol="_weight", predictionCol="_prediction")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), every]).fit(weighted)


def shrunk(nodes: DataFrame, alpha: float, lam: float) -> DataFrame:
    """Node values drawn towards zero: of a node with ``total`` rows the sum is lowered by
    ``alpha`` and divided by ``lam`` rows more."""
    lower = lambda x: F.signum(x) * F.greatest(F.abs(x) * F.col("total") - alpha, F.lit(0.0)) / (F.col("total") + lam)
    return nodes.withColumn("value", F.transform("value", lower))


def predict(train: DataFrame, test: DataFrame, features: list[str], params: Params, label: str = "target_class") -> DataFrame:
    """``test`` with chances and the likeliest class, from a model of ``train``."""
    nodes = trees.nodes(fit(train, features, params, label), train.sparkSession)
    return trees.score(shrunk(nodes, params["reg_alpha"], params["reg_lambda"]), test, features, PROBS)


def halving(
    folded: DataFrame, features: list[str], trials: list[Params], n_splits: int,
    objective: str = "balanced_accuracy", label: str = "target_class", parallel: int = 4,
) -> DataFrame:
    """One row for each trial and fold it was judged on, with its parameters.

    ``folded`` is a table with ``fold`` as by ``learning.common_folds`` (-1: never judged), and
    best a staged one. Columns: ``round``, ``fold``, ``trial``, the parameters, ``samples``,
    the three objectives, ``mean_score`` (of ``objective``, over the trial's folds so far) and
    ``kept`` (goes on; in the last round of selection: is chosen). The better half of the
    trials is kept, rounded up, ties by number. The row of the last fold judges the chosen
    trial; its ``mean_score`` is that fold's alone. An infinite profit factor counts as
    the number of samples. Driver memory holds one row for each trial and round.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"objective must be one of {', '.join(OBJECTIVES)}")
    if n_splits < 2:
        raise ValueError("one fold to select on and one to judge the choice are needed")

    def judged(trial: int, fold: int) -> dict[str, float]:
        test = folded.where(F.col("fold") == fold)
        scored = predict(folded.where(F.col("fold") < fold), test, features, trials[trial], label)
        rows = scored.where(F.col("predicted").isNotNull() & F.col(label).isNotNull())
        got = summary_metrics(
            rows.select(F.lit(0).alias("_all"), F.col(label).alias("truth"), F.col("predicted").alias("pred")), ["_all"]
        ).select("samples", *OBJECTIVES).first()
        if got is None:
            return {"samples": 0} | dict.fromkeys(OBJECTIVES, 0.0)
        return {"samples": got["samples"]} | {n: min(got[n], float(got["samples"])) for n in OBJECTIVES}

    def judged_all(some: list[int], fold: int) -> list[dict[str, float]]:
        with ThreadPoolExecutor(min(parallel, len(some))) as pool:
            # A thread of the pool takes over the session's job settings and the open scope.
            todo = [
                pool.submit(contextvars.copy_context().run, inheritable_thread_target(folded.sparkSession)(judged), trial, fold)
                for trial in some
            ]
            return [t.result() for t in todo]

    rows, past = [], {i: [] for i in range(len(trials))}
    left, fold = list(range(len(trials))), 0
    while True:
        results = dict(zip(left, judged_all(left, fold), strict=True))
        for trial, result in results.items():
            past[trial].append(result[objective])
        means = {t: sum(past[t]) / len(past[t]) for t in left}
        final = fold == n_splits - 2 or len(left) <= 2
        goes_on = sorted(left, key=lambda t: (-means[t], t))[: 1 if final else -(-len(left) // 2)]
        rows += [(fold, fold, t, results[t], means[t], t in goes_on) for t in left]
        left, fold = goes_on, fold + 1
        if final:
            break
    last = judged_all(left, n_splits - 1)[0]
    rows.append((fold, n_splits - 1, left[0], last, last[objective], True))

    names = list(trials[0])
    whole = {n: all(isinstance(t[n], int) for t in trials) for n in names}
    schema = ", ".join([
        "round int, fold int, trial int",
        *[f"{n} {'int' if whole[n] else 'double'}" for n in names],
        "samples long", *[f"{n} double" for n in OBJECTIVES], "mean_score double, kept boolean",
    ])
    flat = [
        (rnd, f, t, *[trials[t][n] if whole[n] else float(trials[t][n]) for n in names], int(res["samples"]), *[float(res[n]) for n in OBJECTIVES], float(mean), kept)
        for rnd, f, t, res, mean, kept in rows
    ]
    return folded.sparkSession.createDataFrame(flat, schema)
