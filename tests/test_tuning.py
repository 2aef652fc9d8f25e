"""The draw, the halving and the shrinking of leaves."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from candlewake.operators import trees, tuning
from candlewake.operators.learning import PROBS
from candlewake.session import stage

SMALL = tuning.RANGES | {"n_estimators": ("int", 2, 4), "max_depth": ("int", 1, 3), "learning_rate": ("log", 0.05, 0.5), "gamma": ("float", 0.0, 0.01)}


@pytest.fixture(scope="module")
def folded(spark):
    x = spark.range(600).select(
        (F.floor(F.col("id") / 150) - 1).cast("int").alias("fold"),
        (F.hash("id") % 100 / 100).alias("a"),
        (F.hash(F.col("id") + 7) % 100 / 100).alias("b"),
    )
    cls = F.when(F.col("a") > 0.3, 0).when(F.col("b") > 0, 1).otherwise(2)
    return stage(x.withColumn("target_class", cls), "folded")


def test_draw_stays_in_its_ranges_and_does_not_move():
    many = tuning.draw(2000)
    assert many[:5] == tuning.draw(5)
    assert many != tuning.draw(2000, seed=1)
    for name, (kind, low, high) in tuning.RANGES.items():
        got = [p[name] for p in many]
        assert low <= min(got) and max(got) <= high
        if kind == "int":
            assert set(got) == set(range(int(low), int(high) + 1)) or name == "n_estimators"
        if kind == "log":
            half = math.sqrt(low * high)
            assert 0.45 < sum(g < half for g in got) / len(got) < 0.55


@pytest.mark.parametrize("objective", ["balanced_accuracy", "profit_factor"])
def test_choice_follows_from_the_recorded_scores(spark, folded, objective):
    out = tuning.halving(folded, ["a", "b"], tuning.draw(4, SMALL), 3, objective).toPandas()
    con = duckdb.connect()
    con.register("trials", out)
    # Four trials on fold 0, two on fold 1, the chosen one on fold 2.
    assert con.execute("SELECT fold, count(*) FROM trials GROUP BY fold ORDER BY fold").fetchall() == [(0, 4), (1, 2), (2, 1)]
    again = con.execute(f"""WITH m AS (SELECT *, avg({objective}) OVER (PARTITION BY trial ORDER BY round) AS mean FROM trials WHERE fold < 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY mean DESC, trial) AS place FROM m)
      SELECT count(*), count_if(kept = (place <= 2 - round)), count_if(abs(mean - mean_score) < 1e-12) FROM r""").fetchone()
    assert again == (6, 6, 6)
    chosen = set(out[(out["fold"] == 1) & out.kept].trial)
    assert chosen == set(out[out["fold"] == 2].trial)
    assert (out.samples == 150).all()
    assert out.balanced_accuracy.max() > 0.6


def test_leaves_shrink_by_both_penalties(spark, folded):
    params = tuning.draw(1, SMALL)[0]
    nodes = stage(trees.nodes(tuning.fit(folded, ["a", "b"], params)), "nodes")
    same = tuning.shrunk(nodes, 0.0, 0.0).join(nodes.select("cls", "tree", "node", F.col("value").alias("was")), ["cls", "tree", "node"])
    assert same.where(F.abs(F.col("value")[0] - F.col("was")[0]) > 1e-12).count() == 0
    for r in tuning.shrunk(nodes, 2.0, 10.0).join(nodes.select("cls", "tree", "node", F.col("value").alias("was")), ["cls", "tree", "node"]).collect():
        want = math.copysign(max(abs(r.was[0]) * r.total - 2.0, 0.0) / (r.total + 10.0), r.was[0])
        assert r.value[0] == pytest.approx(want, abs=1e-12)
    flat = trees.score(tuning.shrunk(nodes, 1e9, 0.0), folded, ["a", "b"], PROBS)
    assert flat.where(F.abs(F.col("p_buy") - 1 / 3) > 1e-9).count() == 0


def test_wrong_calls(folded):
    with pytest.raises(ValueError):
        tuning.halving(folded, ["a"], tuning.draw(2, SMALL), 3, "luck")
    with pytest.raises(ValueError):
        tuning.halving(folded, ["a"], tuning.draw(2, SMALL), 1)
