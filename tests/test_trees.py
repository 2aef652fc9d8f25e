"""Exported trees, walked in SQL and by arrays, against the fitted models."""

import subprocess
import sys

import duckdb
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from candlewake.operators import learning, sentiment, trees

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    a, b, c = F.col("id") % 17 - F.col("id") % 5, F.sin(F.col("id").cast("double")), F.cos(F.col("id") * 3.7)
    cls = F.when(a + 8 * b > 8, 0).when(c > 0.4, 1).otherwise(2)
    made = spark.range(900).select("id", a.cast("double").alias("a"), b.alias("b"), c.alias("c"), cls.alias("target_class"))
    return spark.createDataFrame(made.toPandas())


WALK = """
WITH RECURSIVE x AS (UNPIVOT (SELECT id, a, b, c FROM r) ON a, b, c INTO NAME feature VALUE v),
w AS (
  SELECT id, n.* FROM r, n WHERE node = 0
  UNION ALL
  SELECT w.id, n.* FROM w JOIN x USING (id, feature) JOIN n ON n.tree = w.tree AND n.cls IS NOT DISTINCT FROM w.cls
    AND n.node = CASE WHEN x.v <= w.threshold THEN w."left" ELSE w."right" END
)
"""


def tables(con, nodes, rows):
    con.register("n0", nodes.toPandas().assign(value=lambda d: d["value"].map(list)))
    con.execute('CREATE TABLE n AS SELECT cls::INT AS cls, tree, weight, node, feature, threshold, "left"::INT AS "left", "right"::INT AS "right", value, total, gain FROM n0')
    con.register("r", rows.toPandas())
    return con


def test_forest_scores_are_those_of_the_nodes_in_sql(rows):
    model = learning.fit_tabular(rows, FEATURES, trees=7, depth=4)
    nodes = trees.nodes(model)
    got = {r.id: r for r in trees.score(nodes, rows, FEATURES, learning.PROBS).collect()}
    fitted = {r.id: r for r in learning.score(model, rows).collect()}
    con = tables(duckdb.connect(), nodes, rows)
    sql = WALK + "SELECT id, sum(value[1]) / 7, sum(value[2]) / 7, sum(value[3]) / 7 FROM w WHERE feature IS NULL GROUP BY id"
    walked = {r[0]: r[1:] for r in con.execute(sql).fetchall()}
    assert set(got) == set(fitted) == set(walked)
    for k, r in got.items():
        p = [r.p_buy, r.p_sell, r.p_hold]
        assert p == pytest.approx([fitted[k].p_buy, fitted[k].p_sell, fitted[k].p_hold], abs=1e-12)
        assert p == pytest.approx(list(walked[k]), abs=1e-12)
        assert r.predicted == fitted[k].predicted or sorted(p)[-1] - sorted(p)[-2] < 1e-12
    assert len({round(r.p_buy, 6) for r in got.values()}) > 5
    found = {r.feature: r.importance for r in trees.importance(nodes).collect()}
    want = dict(zip(FEATURES, model.stages[-1].featureImportances.toArray(), strict=True))
    assert found == pytest.approx({k: v for k, v in want.items() if v > 0})
    sums = con.execute(
        """WITH g AS (SELECT tree, feature, sum(gain * total) AS g FROM n WHERE feature IS NOT NULL GROUP BY ALL),
        s AS (SELECT feature, sum(g / t) AS s FROM g JOIN (SELECT tree, sum(g) AS t FROM g GROUP BY tree) USING (tree) GROUP BY feature)
        SELECT feature, s / sum(s) OVER () FROM s"""
    ).fetchall()
    assert dict(sums) == pytest.approx(found)


def test_boosted_margins_are_sums_of_weighted_leaves(rows):
    model = learning.fit_boosted(rows, FEATURES, boosts=4, depth=3)
    nodes = trees.nodes(model)
    got = {r.id: r for r in trees.score(nodes, rows, FEATURES, learning.PROBS).collect()}
    fitted = {r.id: r for r in learning.score(model, rows).collect()}
    con = tables(duckdb.connect(), nodes, rows)
    sql = WALK + """, m AS (SELECT id, cls, 1 / (1 + exp(-2 * sum(weight * value[1]))) AS p FROM w WHERE feature IS NULL GROUP BY ALL)
        SELECT id, list(p / t ORDER BY cls) FROM m JOIN (SELECT id, sum(p) AS t FROM m GROUP BY id) USING (id) GROUP BY id"""
    walked = dict(con.execute(sql).fetchall())
    assert set(got) == set(walked)
    for k, r in got.items():
        p = [r.p_buy, r.p_sell, r.p_hold]
        assert p == pytest.approx([fitted[k].p_buy, fitted[k].p_sell, fitted[k].p_hold], abs=1e-9)
        assert p == pytest.approx(walked[k], abs=1e-9) and r.predicted == fitted[k].predicted


def test_rows_with_nulls_and_no_rows(spark, rows):
    nodes = trees.nodes(learning.fit_tabular(rows, FEATURES, trees=3, depth=2))
    odd = rows.limit(3).withColumn("b", F.lit(None).cast("double"))
    got = trees.score(nodes, odd, FEATURES, learning.PROBS).collect()
    assert [(r.p_buy, r.predicted) for r in got] == [(pytest.approx(1 / 3), None)] * 3
    assert trees.score(nodes, rows.limit(0), FEATURES, learning.PROBS).collect() == []
    constant = rows.withColumn("target_class", F.lit(2))
    alone = trees.nodes(learning.fit_tabular(constant, FEATURES, trees=2, depth=2))
    assert {(r.p_hold, r.predicted) for r in trees.score(alone, rows, FEATURES, learning.PROBS).collect()} == {(1.0, 2)}
    assert trees.importance(alone).collect() == []


def test_functions_for_tasks_load_without_the_package(tmp_path):
    sent = [cloudpickle.dumps(f) for f in (trees.Ensemble.chances, sentiment.word_scorer)]
    (tmp_path / "sent").write_bytes(cloudpickle.dumps(sent))
    load = "import pickle; [pickle.loads(x) for x in pickle.load(open('sent', 'rb'))]"
    got = subprocess.run([sys.executable, "-I", "-c", load], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert got.returncode == 0, got.stderr


def test_stack_metrics_follow_from_its_predictions(spark):
    from candlewake.plans import catalog

    queries, sf = catalog.queries(), "/root/testdata/sf0.001"
    rows = queries["stacked_model_probabilities"](spark, sf).toPandas()
    assert (rows.predicted.notna() == (rows.fold == rows.fold.max())).all() and rows.p_buy.nunique() > 3
    con = duckdb.connect()
    con.register("p", rows)
    want = con.execute(
        """WITH j AS (SELECT symbol, target_class AS t, predicted AS p FROM p WHERE predicted IS NOT NULL),
        c AS (SELECT symbol, t, avg((p = t)::INT) AS recall FROM j GROUP BY ALL)
        SELECT symbol, count(*), avg((p = t)::INT), any_value(b) FROM j JOIN (SELECT symbol, avg(recall) AS b FROM c GROUP BY symbol) USING (symbol) GROUP BY symbol"""
    ).fetchall()
    got = {r.symbol: r for r in queries["stacked_model_metric_values"](spark, sf).collect()}
    assert len(got) == len(want)
    for symbol, n, accuracy, balanced in want:
        assert (got[symbol].samples, got[symbol].accuracy) == (n, pytest.approx(accuracy))
        assert got[symbol].balanced_accuracy == pytest.approx(balanced)


def test_only_the_newest_snapshot_is_read(spark, tmp_path):
    from candlewake.sources.bars import newest_snapshot, read_bars

    path = str(tmp_path / "bars")
    made = spark.createDataFrame(
        [(s, t, d, 1.0) for s, t, d in [("A", "H1", "2024-01-01"), ("A", "H1", "2024-03-01"), ("B", "H1", "2024-02-01"), ("B", "D1", "2024-04-01")]],
        "symbol string, timeframe string, snapshot_date string, close double",
    )
    made.write.partitionBy("timeframe", "symbol", "snapshot_date").parquet(path)
    assert newest_snapshot(spark, path) == "2024-04-01"
    assert newest_snapshot(spark, path, "H1") == "2024-03-01"
    assert newest_snapshot(spark, path, "H1", ["B"]) == "2024-02-01"
    assert newest_snapshot(spark, str(tmp_path / "none")) is None
    got = read_bars(spark, path, "H1", snapshot="latest")
    assert [(r.symbol, r.snapshot_date) for r in got.collect()] == [("A", "2024-03-01")]
    long = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(long)
    spark.conf.set(long, "2000")
    try:
        scan = read_bars(spark, path, "H1", snapshot="latest")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(long, before)
    assert "(snapshot_date#" in scan.split("PartitionFilters:")[1] and "= 2024-03-01" in scan
