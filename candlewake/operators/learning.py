"""Models as Spark ML jobs: tabular and sequence learners, stacking, search, topics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewake.operators import online_topics
from candlewake.operators.labels import sequences, time_series_folds
from candlewake.operators.metrics import summary_metrics
from candlewake.schema import CLASS_BUY, CLASS_HOLD, CLASS_SELL

# Class weights, sequence length, topic model settings.
CLASS_WEIGHTS = {CLASS_BUY: 3.0, CLASS_SELL: 3.0, CLASS_HOLD: 1.0}
SEQUENCE_ROWS = 22
TOPICS, TOPIC_SEED, TOPIC_MIN_DOCS, TOPIC_MAX_SHARE = 10, 42, 5.0, 0.5
UNIFORM = 1.0 / 3
PROBS = ["p_buy", "p_sell", "p_hold"]


@dataclass(frozen=True)
class Settings:
    """Sizes of the models; the defaults are the sizes of a full training."""

    splits: int = 5
    trees: int = 300
    depth: int = 6
    meta_trees: int = 100
    meta_depth: int = 3
    hidden: int = 16
    iterations: int = 100
    boosts: int = 100
    topic_iterations: int = 20
    #: Words of the topic model, by frequency; the vocabulary is held by the driver.
    topic_words: int = 1 << 18
    #: Share of a training period, at its end, that selects parameters.
    holdout: float = 0.2


FULL = Settings()


def class_weight(cls: Column) -> Column:
    out = F.lit(None).cast("double")
    for c, w in CLASS_WEIGHTS.items():
        out = F.when(cls == c, w).otherwise(out)
    return out


def tabular_learner(
    features: list[str], label: str = "target_class", trees: int = FULL.trees, depth: int = FULL.depth, seed: int = 42
) -> Pipeline:
    """Weighted tree ensemble on three classes."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="_features"),
            RandomForestClassifier(
                featuresCol="_features", labelCol=label, weightCol="_weight", numTrees=trees,
                maxDepth=depth, seed=seed, probabilityCol="_probability",
                rawPredictionCol="_raw", predictionCol="_prediction",
            ),
        ]
    )


def fit_tabular(train: DataFrame, features: list[str], label: str = "target_class", **kw: int) -> PipelineModel:
    """Fitted on the complete rows of ``train``."""
    complete = train.dropna(subset=[*features, label])
    weighted = complete.withColumn("_weight", class_weight(F.col(label)))
    return tabular_learner(features, label, **kw).fit(weighted)


def fit_boosted(
    train: DataFrame, features: list[str], label: str = "target_class",
    boosts: int = FULL.boosts, depth: int = FULL.depth, step: float = 0.1, sample: float = 1.0, seed: int = 42,
) -> PipelineModel:
    """Boosted trees, one class against the others, beside the forest; ``step`` is the learning rate."""
    complete = train.dropna(subset=[*features, label])
    weighted = complete.withColumn("_weight", class_weight(F.col(label)))
    one = GBTClassifier(
        maxIter=boosts, maxDepth=depth, stepSize=step, subsamplingRate=sample, seed=seed,
        featuresCol="_features", labelCol=label,
    )
    every = OneVsRest(
        classifier=one, featuresCol="_features", labelCol=label, weightCol="_weight",
        predictionCol="_prediction",
    )
    assemble = VectorAssembler(inputCols=features, outputCol="_features")
    return Pipeline(stages=[assemble, every]).fit(weighted)


def fit_sequence(
    train: DataFrame, features: list[str], label: str = "target_class", length: int = SEQUENCE_ROWS,
    hidden: int = FULL.hidden, max_iter: int = FULL.iterations, seed: int = 42,
) -> PipelineModel:
    """Perceptron on the scaled, flattened rows of a sequence (a table of :func:`flat_sequences`)."""
    return Pipeline(
        stages=[
            MinMaxScaler(inputCol="_sequence", outputCol="_features"),
            MultilayerPerceptronClassifier(
                featuresCol="_features", labelCol=label, seed=seed, maxIter=max_iter,
                layers=[length * len(features), hidden, 3], probabilityCol="_probability",
                rawPredictionCol="_raw", predictionCol="_prediction",
            ),
        ]
    ).fit(train)


def flat_sequences(
    df: DataFrame, features: list[str], label: str = "target_class", length: int = SEQUENCE_ROWS
) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    seq = sequences(df, features, length, label)
    return seq.withColumn("_sequence", array_to_vector(F.flatten("sequence"))).drop("sequence")


def score(model: PipelineModel, df: DataFrame, prefix: str = "") -> DataFrame:
    """Class probabilities and the most likely class of every row.

    Rows with a null among the model's inputs get one third for each class, and no class.
    """
    first = model.stages[0]
    needed = first.getInputCols() if isinstance(first, VectorAssembler) else [first.getInputCol()]
    whole = F.lit(True)
    for n in needed:
        whole = whole & F.col(n).isNotNull()
    out = model.transform(df.where(whole))
    if "_probability" in out.columns:
        p = vector_to_array("_probability")
    else:  # one against the others: the margins as chances of their own, made to add up
        own = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        p = F.transform(own, lambda x: x / F.aggregate(own, F.lit(0.0), lambda a, v: a + v))
    scored = out.select(
        *df.columns,
        *[p[i].alias(prefix + n) for i, n in enumerate(PROBS)],
        F.col("_prediction").cast("int").alias(prefix + "predicted"),
    )
    rest = df.where(~whole).select(
        *df.columns,
        *[F.lit(UNIFORM).alias(prefix + n) for n in PROBS],
        F.lit(None).cast("int").alias(prefix + "predicted"),
    )
    return scored.unionByName(rest)


def pad_probabilities(rows: DataFrame, scored: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """Scores joined to all rows; rows without a score, as in the warm-up, get one third each."""
    names = [prefix + n for n in PROBS]
    return rows.join(scored.select(*keys, *names), keys, "left").select(
        *rows.columns, *[F.coalesce(F.col(n), F.lit(UNIFORM)).alias(n) for n in names]
    )


def out_of_fold(
    folded: DataFrame, features: list[str], sequence_features: list[str], n_splits: int,
    keys: list[str] | None = None, label: str = "target_class", **kw: int,
) -> DataFrame:
    """Probabilities of both base learners for every row, each from a model of earlier rows.

    Folds are cut at dates that all symbols share (:func:`common_folds`).

    ``folded`` carries ``fold`` (-1 before the first test fold); rows of fold -1 have no
    earlier model and get zeros. The loop is over folds, which are few and fixed.
    """
    keys = keys or ["symbol", "ts"]
    seq = flat_sequences(folded, sequence_features, label).join(folded.select(*keys, "fold"), keys)
    scored = None
    for fold in range(n_splits):
        trees = fit_tabular(folded.where(F.col("fold") < fold), features, label, **kw)
        net = fit_sequence(seq.where(F.col("fold") < fold), sequence_features, label)
        test = folded.where(F.col("fold") == fold)
        tab = score(trees, test, "tab_").drop("tab_predicted")
        net_scores = score(net, seq.where(F.col("fold") == fold), "seq_")
        both = pad_probabilities(tab, net_scores, keys, "seq_")
        scored = both if scored is None else scored.unionByName(both)
    first = folded.where(F.col("fold") == -1).withColumns(
        {p + n: F.lit(0.0) for p in ("tab_", "seq_") for n in PROBS}
    )
    return first.unionByName(scored)


META = [p + n for p in ("tab_", "seq_") for n in PROBS]


def fit_stack(oof: DataFrame, label: str = "target_class", **kw: int) -> PipelineModel:
    """Second classifier on the six out-of-fold probabilities."""
    return fit_tabular(oof, META, label, **{"trees": FULL.meta_trees, "depth": FULL.meta_depth} | kw)


def common_folds(df: DataFrame, n_splits: int, ts: str = "ts") -> DataFrame:
    """``fold`` of each row by its time, the same for all symbols.

    The distinct times are cut into equal test folds; so no model sees a time at or
    after its test fold, of whatever symbol.
    """
    times = df.select(ts, F.lit(0).alias("_all")).distinct()
    cut = time_series_folds(times, n_splits, ["_all"], [ts], F.to_date(ts)).select(ts, "fold", "row")
    return df.join(cut.withColumnRenamed("row", "time_row"), ts)


def feature_importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """Importance per feature; the values are model metadata, as many as the features."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    from pyspark.sql import SparkSession

    rows = list(zip(features, values, strict=True))
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def search(
    folded: DataFrame, features: list[str], grid: list[dict[str, int]], n_splits: int,
    objective: str = "balanced_accuracy", label: str = "target_class", holdout: float = FULL.holdout,
) -> DataFrame:
    """The best parameter row of each fold, and how it does on the fold's test rows.

    ``folded`` is a table of :func:`common_folds`. Of the times before a fold the last
    share ``holdout`` selects among the rows of ``grid``; the test rows only judge the
    model that is then fitted on all earlier rows. Folds and grid are short lists.
    """
    judge = lambda df: summary_metrics(
        df.where(F.col("predicted").isNotNull()).select(
            "trial", "fold", F.col(label).alias("truth"), F.col("predicted").alias("pred")
        ),
        ["trial", "fold"],
    )
    text = F.create_map(*[
        x for i, p in enumerate(grid)
        for x in (F.lit(i), F.lit(", ".join(f"{k}={v}" for k, v in sorted(p.items()))))
    ])
    out = None
    for fold in range(n_splits):
        earlier = folded.where(F.col("fold") < fold)
        times = earlier.agg(F.count_distinct("ts")).first()[0]
        split = int(times * (1 - holdout))
        fit, select = earlier.where(F.col("time_row") < split), earlier.where(F.col("time_row") >= split)
        tried = None
        for i, params in enumerate(grid):
            scored = score(fit_tabular(fit, features, label, **params), select)
            scored = scored.withColumns({"trial": F.lit(i), "fold": F.lit(fold)})
            tried = scored if tried is None else tried.unionByName(scored)
        ranked = judge(tried).select("trial", "samples", objective).collect()  # a row per parameter row
        best = max(ranked, key=lambda r: (r[objective], -r["trial"]))
        model = fit_tabular(earlier, features, label, **grid[best["trial"]])
        test = score(model, folded.where(F.col("fold") == fold)).withColumn("trial", F.lit(best["trial"]))
        one = judge(test).select(
            "fold",
            "trial",
            F.lit(best["samples"]).alias("selection_rows"),
            F.lit(best[objective]).alias("selection_" + objective),
            F.col("samples").alias("test_rows"),
            F.col(objective).alias("test_" + objective),
        )
        out = one if out is None else out.unionByName(one)
    return out.withColumn("params", text[F.col("trial")])


def fit_topics(
    docs: DataFrame, tokens: str = "tokens", topics: int = TOPICS, max_iter: int = FULL.topic_iterations,
    words: int = FULL.topic_words,
) -> online_topics.TopicModel:
    """Topic model on token arrays; rare and too common words are left out.

    Every iteration takes all documents. The ``words`` most frequent words count.
    """
    return online_topics.fit(docs, tokens, topics, max_iter, words, TOPIC_MIN_DOCS, TOPIC_MAX_SHARE, TOPIC_SEED)


def topic_distribution(
    model: online_topics.TopicModel, docs: DataFrame, keys: list[str], tokens: str = "tokens"
) -> DataFrame:
    return online_topics.distribution(model, docs, keys, tokens)


def top_topics(dist: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The ``n`` most likely topics of each document, by a sort of its own short array."""
    pairs = F.transform("topics", lambda p, i: F.struct((-p).alias("p"), i.alias("topic")))
    best = F.slice(F.array_sort(pairs), 1, n)
    return dist.select(*keys, F.posexplode(best)).select(
        *keys,
        (F.col("pos") + 1).alias("rank"),
        F.col("col.topic").alias("topic"),
        (-F.col("col.p")).alias("probability"),
    )
