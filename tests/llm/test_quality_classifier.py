"""Held-out accuracy, and the dual solution against its optimality conditions."""

import duckdb
import numpy as np

from candlewake.llm import quality_classifier as Q
from candlewake.llm.queries import R

SF = "/root/testdata/sf0.01"


def test_held_out_labels_are_predicted(spark):
    labels = dict(duckdb.execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    got = [r for r in R.queries["op6_quality_classifier"](spark, SF).collect()]
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95
    bad = [p for p, y in held if y == 0]
    assert np.mean(bad) < 0.35


def test_descent_reaches_the_optimum(monkeypatch):
    monkeypatch.setattr(Q, "ROUNDS", 300)
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 6)) for _ in range(60)]
    labels = np.array([int(r.min() < 5) for r in rows])
    scale = np.zeros(Q.SPACE)
    scale[:40] = rng.normal(size=40)
    w, b = Q.descend(rows, labels, scale)

    def loss(w, b):
        sign = np.where(labels > 0, 1, -1)
        m = np.array([Q.margin(r, scale, w, b) for r in rows])
        share = np.where(labels > 0, labels.mean(), 1 - labels.mean())
        return 0.5 * (w @ w + b * b) + (Q.PENALTY * 0.5 / share * np.maximum(0, 1 - sign * m) ** 2).sum()

    best = loss(w, b)
    for _ in range(200):
        d = np.zeros(Q.SPACE)
        d[:40] = rng.normal(size=40) * 0.01
        assert loss(w + d, b + rng.normal() * 0.01) >= best - 1e-6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x " * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, None)], "doc_id long, quality int")
    assert Q.classify(docs, labels).count() == 5
    assert Q.classify(docs, labels.limit(0)).count() == 5
    assert Q.classify(docs.limit(0), labels).collect() == []
