"""Online topic model against a plain fit, document by document."""

from __future__ import annotations

import math

import numpy as np
import pytest

from candlewake.operators import learning
from candlewake.operators import online_topics as O

WORDS = {"metal": ["gold", "silver", "copper"], "grain": ["wheat", "maize", "barley"]}


def documents(n=24, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [str(w) for w in rng.choice(WORDS["metal" if i % 2 else "grain"], 3 + i)]
        out.append((i, [*words, str(rng.choice(WORDS["metal"] + WORDS["grain"])), "common"]))
    return [*out, (100, ["gold"] * 40 + ["rare"]), (100, []), (None, None), (103, ["", None, "wheat"])]


def digamma(x):
    out = 0.0
    while x < 60:
        out, x = out - 1 / x, x + 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x * x)


psi = np.vectorize(digamma)


def plain(n, w, prior, rest):
    """Gammas of one document by plain steps."""
    g = prior + n.sum() / len(prior)
    while True:
        e = np.exp(psi(g) - psi(g.sum()))
        new = prior + e * (w.T @ (n / (w @ e)))
        if np.abs(new - g).mean() <= rest:
            return new
        g = new


def test_documents_come_to_rest_where_plain_steps_do(monkeypatch):
    rng = np.random.default_rng(3)
    weights = rng.gamma(100, 0.01, (60, 4)) + 20 * rng.random((60, 4)) ** 6
    w, prior = O.chances(weights), np.array([0.1, 0.2, 0.05, 0.3])
    lens = np.array([0, 1, 40, 7, 0, 60, 7])
    at = np.concatenate([rng.choice(60, m, replace=False) for m in lens])
    n = rng.integers(1, 9, len(at))
    monkeypatch.setattr(O, "REST", 1e-9)
    monkeypatch.setattr(O.at_rest, "__defaults__", (1e-9,))
    for size in (1, 50, 1 << 14):
        monkeypatch.setattr(O, "CELLS", size)
        found = np.zeros_like(w)
        got = O.infer(at, n, lens, w, prior, found)
        want = np.zeros_like(w)
        for i, b in enumerate(np.cumsum(lens) - lens):
            own = slice(b, b + lens[i])
            g = plain(n[own], w[at[own]], prior, 1e-9) if lens[i] else prior
            np.testing.assert_allclose(got[i], g, atol=1e-5)
            e = np.exp(psi(g) - psi(g.sum()))
            want[at[own]] += np.outer(n[own] / (w[at[own]] @ e), e)
        np.testing.assert_allclose(found, want, atol=1e-5)


def test_every_document_is_at_rest_in_far_fewer_steps(monkeypatch):
    """Weights that hardly differ, as in the first round, took hundreds of plain steps a document."""
    rng = np.random.default_rng(5)
    w, prior = O.chances(rng.gamma(100, 0.01, (3000, 10))), np.full(10, 0.1)
    at = np.concatenate([rng.choice(3000, 200, replace=False) for _ in range(40)])
    n, lens, taken, step = np.ones(len(at)), np.full(40, 200), [0], O._step

    def counted(cells, counts, g, prior):
        taken[0] += len(g)
        return step(cells, counts, g, prior)

    monkeypatch.setattr(O, "_step", counted)
    got = O.infer(at, n, lens, w, prior)
    leaping = taken[0]
    again = step(w[at].reshape(40, 200, 10), n.reshape(40, 200), got, prior)
    assert np.abs(again - got).mean(1).max() < 2 * O.REST
    taken[0] = 0
    monkeypatch.setattr(O, "LEAPS", 0)
    O.infer(at, n, lens, w, prior)
    assert 5 * leaping < taken[0]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), "id long, tokens array<string>")


def fit(docs, words=100, rounds=4):
    seen = []
    model = O.fit(docs, "tokens", 2, rounds, words, 2, 0.6, 3, lambda w, p: seen.append((w, p)))
    return model, seen


def test_rounds_agree_with_a_plain_fit(docs):
    model, seen = fit(docs)
    assert sorted(model.words) == sorted([*WORDS["metal"], *WORDS["grain"]]) and len(seen) == 4
    n = np.array([[(ws or []).count(w) for w in model.words] for _, ws in documents()])
    n = n[n.sum(1) > 0]
    weights, prior = np.random.default_rng(3).gamma(100, 0.01, (6, 2)), np.full(2, 0.5)
    for i, (got_w, got_p) in enumerate(seen, 1):
        w = np.exp(psi(weights) - psi(weights.sum(0)))
        g = np.array([plain(row, w, prior, 1e-9) for row in n])
        logs = psi(g) - psi(g.sum(1, keepdims=True))
        e = np.exp(logs)
        rate = (1024 + i) ** -0.51
        weights = (1 - rate) * weights + rate * (0.5 + w * ((n / (e @ w.T)).T @ e))
        # The Newton step of Spark's online LDA.
        tri = lambda x: (digamma(x + 1e-4) - digamma(x - 1e-4)) / 2e-4
        slope = len(n) * (logs.mean(0) - (psi(prior) - digamma(prior.sum())))
        q = -len(n) * np.array([tri(x) for x in prior])
        b = (slope / q).sum() / (1 / (len(n) * tri(prior.sum())) + (1 / q).sum())
        prior = prior - rate * (slope - b) / q
        np.testing.assert_allclose(got_w, weights, atol=0.02)
        np.testing.assert_allclose(got_p, prior, atol=0.002)


def test_shares_of_all_rows_and_the_same_model_from_other_partitions(docs):
    model, _ = fit(docs, rounds=8)
    again, _ = fit(docs.repartition(7), rounds=8)
    assert again.words == model.words
    np.testing.assert_allclose(again.weights, model.weights, rtol=0, atol=1e-6)
    np.testing.assert_allclose(again.prior, model.prior, rtol=0, atol=1e-6)
    rows = learning.topic_distribution(model, docs, ["id"]).collect()
    assert sorted(r["id"] or -1 for r in rows) == sorted(i or -1 for i, _ in documents())
    shares = {(r["id"], sum(r["topics"]) > 0): r["topics"] for r in rows}
    assert shares[(None, False)] == shares[(100, False)] == [0.0, 0.0]
    assert all(abs(sum(s) - 1) < 1e-9 for (_, known), s in shares.items() if known)
    assert (100, True) in shares and (103, True) in shares


def test_the_most_frequent_words_count_and_none_may_be_left(spark, docs):
    assert fit(docs, words=1, rounds=1)[0].words == ["gold"]
    for rows in ([], [(1, ["once"]), (2, None)]):
        few = spark.createDataFrame(rows, "id long, tokens array<string>")
        model, seen = fit(few)
        assert model.words == [] and not seen
        assert [r["topics"] for r in O.distribution(model, few, ["id"], "tokens").collect()] == [[0.0, 0.0]] * len(rows)
