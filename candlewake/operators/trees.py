"""Fitted tree ensembles as tables of nodes, and everything that can be read from these rows.

``nodes`` exports a fitted forest or one-against-the-rest boosted trees: a row for each node with
``cls, tree, weight, node, feature, threshold, left, right, value, total, gain``. A value of ``feature`` up to
``threshold`` goes left. ``value`` holds a node's class chances (forest) or its part of a class's
margin (boosted trees, one set of trees for each ``cls``). Leaves have no feature. The table is as large as
the model, trees * 2^(depth + 1) rows at most, whatever the data; so it may be sent to every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.session import fresh_path

#: Rows of a batch that walk down all trees together.
WALK_ROWS = 512


def nodes(model: PipelineModel, spark: SparkSession | None = None) -> DataFrame:
    """The node table of a pipeline of an assembler and a tree ensemble, read from the saved model.

    A thread without a session of its own names one.
    """
    spark = spark or SparkSession.getActiveSession()
    path = fresh_path(spark, "trees")
    fitted = model.stages[-1]
    fitted.write().save(path)
    names = F.array(*[F.lit(n) for n in model.stages[0].getInputCols()])
    if not isinstance(fitted, OneVsRestModel):
        return _exported(spark, path, names, F.lit(None).cast("int"), boosted=False)
    parts = [_exported(spark, f"{path}/model_{k}", names, F.lit(k), boosted=True) for k in range(len(fitted.models))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _exported(spark: SparkSession, path: str, names, cls, boosted: bool) -> DataFrame:
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
    data = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*").join(weights, "tree")
    counts = F.col("impurityStats")
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    inner = F.col("leftChild") >= 0
    return data.select(
        cls.alias("cls"),
        "tree",
        "weight",
        F.col("id").alias("node"),
        F.when(inner, names[F.greatest("split.featureIndex", F.lit(0))]).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        (F.array("prediction") if boosted else F.transform(counts, lambda x: x / total)).alias("value"),
        (counts[0] if boosted else total).alias("total"),
        F.when(inner, F.col("gain")).alias("gain"),
    )


class Ensemble:
    """A node table as arrays."""

    def __init__(self, table: DataFrame, features: list[str]) -> None:
        rows = sorted(table.collect(), key=lambda r: (r.cls or 0, r.tree, r.node))
        at = {(r.cls, r.tree, r.node): i for i, r in enumerate(rows)}
        child = lambda r, k: at[r.cls, r.tree, r[k]] if r.feature else at[r.cls, r.tree, r.node]
        self.feature = np.array([features.index(r.feature) if r.feature else 0 for r in rows])
        self.threshold = np.array([r.threshold if r.feature else 0.0 for r in rows])
        self.left = np.array([child(r, "left") for r in rows])
        self.right = np.array([child(r, "right") for r in rows])
        self.value = np.array([list(r.value) for r in rows])
        self.roots = [(r.cls, r.weight, i) for i, r in enumerate(rows) if r.node == 0]
        self.boosted = rows[0].cls is not None

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Class chances of each row of ``x``, added up tree by tree."""
        every = np.arange(len(x))
        at = np.tile([i for _, _, i in self.roots], (len(x), 1))
        while True:
            goes = np.where(x[every[:, None], self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            if (goes == at).all():
                break
            at = goes
        if not self.boosted:
            votes = np.zeros((len(x), self.value.shape[1]))
            for t in range(at.shape[1]):
                votes += self.value[at[:, t]]
            return votes / votes.sum(axis=1, keepdims=True)
        margins = np.zeros((len(x), 1 + max(c for c, _, _ in self.roots)))
        for t, (cls, weight, _) in enumerate(self.roots):
            margins[:, cls] += weight * self.value[at[:, t], 0]
        own = 1 / (1 + np.exp(-2 * margins))
        return own / own.sum(axis=1, keepdims=True)


def score(table: DataFrame, df: DataFrame, features: list[str], names: list[str]) -> DataFrame:
    """``df`` with a chance for each class as ``names`` and the likeliest class ``predicted``, from a node table.

    Rows with a null among ``features`` get equal chances and no class.
    """
    model = Ensemble(table, features)

    @F.arrow_udf("array<double>")
    def chances(*columns: pa.Array) -> pa.Array:
        x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
        parts = [model.chances(x[i : i + WALK_ROWS]) for i in range(0, len(x), WALK_ROWS)]
        flat = np.concatenate([np.empty((0, len(names))), *parts]).reshape(-1)
        return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(names), dtype=np.int32), flat).cast(pa.list_(pa.float64()))

    whole = F.lit(True)
    for n in features:
        whole = whole & F.col(n).isNotNull()
    found = df.withColumn("_p", chances(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in features]))
    found = found.withColumn("_p", F.when(whole, F.col("_p")))
    best = F.array_position("_p", F.array_max("_p")).cast("int") - 1
    return found.select(
        *df.columns,
        *[F.coalesce(F.col("_p")[i], F.lit(1.0 / len(names))).alias(n) for i, n in enumerate(names)],
        best.alias("predicted"),
    )


def importance(table: DataFrame) -> DataFrame:
    """``feature, importance``: gains weighted by the rows of their nodes, adding up to one within a tree, and over all."""
    gains = table.where(F.col("feature").isNotNull()).groupBy("cls", "tree", "feature")
    gains = gains.agg(F.sum(F.col("gain") * F.col("total")).alias("g"))
    of_tree = gains.groupBy("cls", "tree").agg(F.sum("g").alias("tree_gain")).where("tree_gain > 0")
    share = F.col("g") / F.col("tree_gain")
    shares = gains.join(of_tree, (gains.tree == of_tree.tree) & gains.cls.eqNullSafe(of_tree.cls)).groupBy("feature").agg(F.sum(share).alias("share"))
    return shares.crossJoin(F.broadcast(shares.agg(F.sum("share").alias("all")))).select("feature", (F.col("share") / F.col("all")).alias("importance"))
