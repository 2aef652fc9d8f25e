"""Queries on folds, metrics, model comparison and learned models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewake.functions.text import topic_tokens
from candlewake.operators import folds, labels, learning, metrics, sentiment, stats, topics, trees, tuning
from candlewake.operators import indicators as ind
from candlewake.plans import inputs
from candlewake.plans import sqltext as q
from candlewake.plans.registry import Registry, rounded
from candlewake.session import stage

R = Registry()

#: Daily bars of half a year; symbols with gaps have fewer.
_LEAST_ROWS = 150
_BOUNDS = f"""span AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY symbol),
bounds AS (SELECT symbol, lo AS train_start, i + 1 AS fold, lo + to_months((6 + 2 * i)::INT) AS test_start,
    lo + to_months((8 + 2 * i)::INT) AS test_end
  FROM span, range(0, 600) r(i) WHERE lo + to_months((6 + 2 * i)::INT) < hi AND lo + to_months((8 + 2 * i)::INT) <= hi)"""


@R.add(
    f"""{q.with_(q.BARS, _BOUNDS)}, sizes AS (SELECT b.symbol, b.fold::INT AS fold, b.train_start, b.test_start, b.test_end,
      count(*) FILTER (WHERE ts < test_start) AS train_rows, count(*) FILTER (WHERE ts >= test_start AND ts < test_end) AS test_rows
    FROM bounds b JOIN bars x ON b.symbol = x.symbol GROUP BY ALL)
    SELECT * FROM sizes QUALIFY min(train_rows) OVER (PARTITION BY symbol ORDER BY fold) >= {_LEAST_ROWS}"""
)
def walk_forward_folds(spark: SparkSession, sf: str) -> DataFrame:
    """A symbol whose first half year has too few bars has no folds."""
    return folds.fold_sizes(inputs.bars(spark, sf), ["symbol"], min_train_rows=_LEAST_ROWS)


@R.add(
    f"""{q.with_(q.BARS)}, n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row,
      count(*) OVER (PARTITION BY symbol) AS t FROM bars)
    SELECT symbol, ts, row, (CASE WHEN row < t - 5 * (t // 6) THEN -1 ELSE (row - (t - 5 * (t // 6))) // (t // 6) END)::INT AS fold FROM n"""
)
def time_series_folds(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.bars(spark, sf).select("symbol", "ts")
    return labels.time_series_folds(b, 5, ["symbol"], ["ts"], F.to_date("ts"))


@R.add(
    f"""{q.with_(q.BARS, q.PREDICTIONS)} SELECT symbol, ts, predicted_class,
      (CASE predicted_class WHEN 2 THEN 1.0 ELSE 3.0 END)::DOUBLE AS weight FROM predictions"""
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    p = inputs.predictions(spark, sf).select("symbol", "ts", "predicted_class")
    return p.withColumn("weight", learning.class_weight(F.col("predicted_class")))


_TRUTH = """judged AS MATERIALIZED (SELECT symbol, year(ts)::INT AS fold, predicted_class AS pred,
  CASE WHEN nx > close * 1.05 THEN 0 WHEN nx < close * 0.95 THEN 1 ELSE 2 END AS truth
  FROM (SELECT *, lead(close, 6) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM predictions) WHERE nx IS NOT NULL),
per AS (SELECT symbol, fold, c AS cls, count(*) FILTER (WHERE truth = c) AS support, count(*) FILTER (WHERE truth = c AND pred = c) AS hits,
    count(*) FILTER (WHERE pred = c) AS predicted, hits::DOUBLE / nullif(support, 0) AS recall,
    coalesce(2.0::DOUBLE * hits / nullif(support + predicted, 0), 0.0) AS f1
  FROM judged, (VALUES (0), (1), (2)) k(c) GROUP BY symbol, fold, c HAVING support + predicted > 0),
summary AS MATERIALIZED (SELECT symbol, fold, sum(support)::BIGINT AS samples, avg(recall) AS balanced_accuracy,
    sum(f1 * support) / sum(support) AS f1_score, sum(hits)::DOUBLE / sum(support) AS accuracy,
    CASE WHEN sum(support) = sum(hits) THEN 'inf'::DOUBLE ELSE sum(hits)::DOUBLE / (sum(support) - sum(hits)) END AS profit_factor
  FROM per GROUP BY symbol, fold)"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in predictions against the move over the next six bars."""
    p = inputs.predictions(spark, sf)
    future = labels.forward_label(p, 6, pip_threshold=0)
    ratio = F.col("forward_close")
    truth = (
        F.when(ratio > F.col("close") * 1.05, 0).when(ratio < F.col("close") * 0.95, 1).otherwise(2)
    )
    return future.select(
        "symbol",
        F.year("ts").alias("fold"),
        F.col("predicted_class").alias("pred"),
        truth.alias("truth"),
    )


_SUMMARY = ["balanced_accuracy", "f1_score", "accuracy", "profit_factor"]


@R.add(
    f"""{q.with_(q.BARS, q.PREDICTIONS, _TRUTH)} SELECT symbol, fold, cls, support::BIGINT AS support, {q.r('recall', 6)} AS recall,
      {q.r('coalesce(hits::DOUBLE / nullif(predicted, 0), 0.0)', 6)} AS precision, {q.r('f1', 6)} AS f1 FROM per"""
)
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.class_metrics(judged(spark, sf), ["symbol", "fold"]).drop("_hits")
    return rounded(out, ["recall", "precision", "f1"], 6)


@R.add(f"{q.with_(q.BARS, q.PREDICTIONS, _TRUTH)} SELECT symbol, fold, samples, {q.rounded(_SUMMARY, 6)} FROM summary")
def fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced accuracy, weighted F1, accuracy and profit factor."""
    return rounded(metrics.summary_metrics(judged(spark, sf), ["symbol", "fold"]), _SUMMARY, 6)


@R.add(
    f"""{q.with_(q.BARS, q.PREDICTIONS, _TRUTH)} SELECT symbol, count(*) AS folds,
      {', '.join(f"{q.r(f'avg({m})', 6)} AS {m}_mean, {q.r(f'stddev_samp({m})', 6)} AS {m}_std" for m in ('balanced_accuracy', 'f1_score'))}
    FROM summary GROUP BY symbol"""
)
def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    names = ["balanced_accuracy", "f1_score"]
    out = metrics.fold_summary(metrics.summary_metrics(judged(spark, sf), ["symbol", "fold"]), names)
    return rounded(out, [f"{n}_{s}" for n in names for s in ("mean", "std")], 6)


_METRIC_TABLE = f"""mt AS (SELECT {q.pair_of('o_custkey')} AS pair, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS version,
    (o_orderkey % 7 + 40 + o_custkey % 8 * (o_orderkey % 2))::DOUBLE / 100 AS accuracy, 0.5::DOUBLE AS precision, 0.4::DOUBLE AS recall,
    (o_orderkey % 11 + 30)::DOUBLE / 100 AS f1, (o_orderkey % 5 - 1)::DOUBLE / 4 AS sharpe_ratio,
    o_totalprice / 1e6 AS total_return FROM orders),
ma AS MATERIALIZED (SELECT pair, version, avg(accuracy) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1,
    avg(sharpe_ratio) AS sharpe, avg(total_return) AS total_return FROM mt
  WHERE NOT (pair = 'NZD_USD' AND version = 'new') GROUP BY ALL)"""


def _model_averages(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    table = inputs.table(spark, sf, "orders").select(
        inputs.pair_of("o_custkey").alias("pair"),
        F.when(k % 2 == 0, "old").otherwise("new").alias("version"),
        ((k % 7 + 40 + c % 8 * (k % 2)).cast("double") / 100).alias("accuracy"),
        F.lit(0.5).alias("precision"),
        F.lit(0.4).alias("recall"),
        ((k % 11 + 30).cast("double") / 100).alias("f1"),
        ((k % 5 - 1).cast("double") / 4).alias("sharpe_ratio"),
        (F.col("o_totalprice") / 1e6).alias("total_return"),
    )
    return metrics.model_averages(table.where("NOT (pair = 'NZD_USD' AND version = 'new')"))


_MEANS = ["accuracy", "precision", "recall", "f1", "sharpe", "total_return"]


@R.add(f"WITH {_METRIC_TABLE} SELECT pair, version, {q.rounded(_MEANS, 6)} FROM ma")
def model_averages(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_model_averages(spark, sf), _MEANS, 6)


_GAIN = lambda n, w: f"coalesce(CASE WHEN o.{n} > 0 THEN (n.{n} - o.{n}) / o.{n} * {w} END, 0)"
_COMPARED = f"""cmp AS (SELECT pair, CASE WHEN o.version IS NOT NULL AND n.version IS NOT NULL THEN
    {' + '.join(_GAIN(n, w) for n, w in metrics.IMPROVEMENT_WEIGHTS.items())} END::DOUBLE AS improvement_score
  FROM (SELECT * FROM ma WHERE version = 'old') o FULL JOIN (SELECT * FROM ma WHERE version = 'new') n USING (pair)),
judg AS (SELECT pair, improvement_score, coalesce(improvement_score > 0.02, false) AS improved FROM cmp)"""


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    m = _model_averages(spark, sf)
    return metrics.compare_models(m.where("version = 'old'"), m.where("version = 'new'"))


@R.add(
    f"""WITH {_METRIC_TABLE}, {_COMPARED} SELECT pair, {q.r('improvement_score', 6)} AS improvement_score, improved,
      CASE WHEN improvement_score IS NULL THEN 'Missing metrics' WHEN improved THEN printf('%.2f%% improvement', improvement_score * 100)
      ELSE 'Insufficient improvement' END AS reason FROM judg"""
)
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_compared(spark, sf), ["improvement_score"], 6)


@R.add(
    f"""WITH {_METRIC_TABLE}, {_COMPARED} SELECT count(*) FILTER (WHERE improved) AS improved_count, count(*) AS total_pairs,
      count(*) FILTER (WHERE improved) >= 2 AS should_deploy FROM judg"""
)
def deploy_decision(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.deploy_decision(_compared(spark, sf))


# Learned models. Two libraries never grow the same trees, so the twins check what any model must fulfil.

FEATURES = ["rsi", "macd_hist", "adx", "bb_position", "atr_zscore", "return_5", "realized_vol_10", "stoch_k"]
SEQUENCE_FEATURES = ["return_1", "rsi_norm", "bb_position"]
SIZES = learning.FULL
SPLITS = SIZES.splits
_WANTED = list(dict.fromkeys([*FEATURES, *SEQUENCE_FEATURES, "atr_14"]))


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled, complete feature rows with their test fold, written once for all fits."""
    known = (spark.sparkContext.applicationId, sf)
    if known not in _training:
        feats = ind.base_features(inputs.bars(spark, sf))
        rows = feats.select("symbol", "ts", "close", *_WANTED).dropna(how="any")
        labelled = labels.forward_label(rows, 6, atr_multiplier=1.0)
        labelled = stage(labelled.select("symbol", "ts", *_WANTED, "target_class"), "labelled")
        _training[known] = stage(learning.common_folds(labelled, SPLITS), "training")
    return _training[known]


_training: dict[tuple[str, str], DataFrame] = {}

_ROWS = f"""clean AS (SELECT symbol, ts, close, {', '.join(_WANTED)} FROM feats WHERE {' AND '.join(f'{n} IS NOT NULL' for n in _WANTED)}),
labelled AS MATERIALIZED (SELECT symbol, ts FROM clean QUALIFY lead(close, 6) OVER (PARTITION BY symbol ORDER BY ts) IS NOT NULL),
times AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS row, count(*) OVER () AS n, n // {SPLITS + 1} AS size, n - {SPLITS} * size AS first
  FROM (SELECT DISTINCT ts FROM labelled)),
training AS MATERIALIZED (SELECT symbol, ts, row, (CASE WHEN row < first THEN -1 ELSE (row - first) // nullif(size, 0) END)::INT AS fold FROM labelled JOIN times USING (ts))"""


def _checked(df: DataFrame, *more: str) -> DataFrame:
    """What holds for the probabilities of any model: they add up, and the class is the likeliest."""
    p = [F.col(n) for n in learning.PROBS]
    names = F.array(*[F.round(x, 9) for x in p])
    likeliest = F.element_at(names, F.col("predicted") + 1) == F.array_max(names)
    return df.select("symbol", "ts", *more, F.round(p[0] + p[1] + p[2], 6).alias("total"), likeliest.alias("likeliest"))


@R.add(f"{q.with_(q.FEATURES, _ROWS)} SELECT symbol, ts, fold, 1.0::DOUBLE AS total, true AS likeliest FROM training")
def tabular_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """What :func:`tabular_model_probabilities` must fulfil."""
    return _checked(tabular_model_probabilities(spark, sf), "fold")


def _early_nodes(spark: SparkSession, sf: str, boosted: bool) -> DataFrame:
    """The trees fitted on all folds but the last, as a node table."""
    early = training_rows(spark, sf).where(F.col("fold") < SPLITS - 1)
    if boosted:
        return trees.nodes(learning.fit_boosted(early, FEATURES, boosts=SIZES.boosts, depth=SIZES.meta_depth))
    return trees.nodes(learning.fit_tabular(early, FEATURES, trees=SIZES.trees, depth=SIZES.depth))


def _probabilities(spark: SparkSession, sf: str, boosted: bool) -> DataFrame:
    rows = training_rows(spark, sf).select("symbol", "ts", "fold", "target_class", *FEATURES)
    scored = trees.score(_early_nodes(spark, sf, boosted), rows, FEATURES, learning.PROBS)
    return scored.select("symbol", "ts", "fold", "target_class", *learning.PROBS, "predicted")


@R.add()
def tabular_model_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Class chances of every row, worked out from the exported nodes of the forest."""
    return _probabilities(spark, sf, boosted=False)


@R.add()
def tabular_model_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted forest as rows."""
    return _early_nodes(spark, sf, boosted=False)


@R.add()
def boosted_model_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Class chances from the margins of boosted trees, one class against the others."""
    return _probabilities(spark, sf, boosted=True)


@R.add(
    f"""{q.with_(q.FEATURES, _ROWS)} SELECT symbol, ts, 1.0::DOUBLE AS total,
      row_number() OVER (PARTITION BY symbol ORDER BY ts) < {learning.SEQUENCE_ROWS} AS padded FROM training"""
)
def sequence_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities of the sequence learner; the warm-up rows get one third each."""
    rows = training_rows(spark, sf)
    seq = learning.flat_sequences(rows, SEQUENCE_FEATURES)
    early = seq.join(rows.where(F.col("fold") < SPLITS - 1).select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    model = learning.fit_sequence(early, SEQUENCE_FEATURES)
    scored = learning.pad_probabilities(rows.select("symbol", "ts"), learning.score(model, seq), ["symbol", "ts"])
    p = [F.col(n) for n in learning.PROBS]
    padded = (p[0] == learning.UNIFORM) & (p[1] == learning.UNIFORM) & (p[2] == learning.UNIFORM)
    return scored.select("symbol", "ts", F.round(p[0] + p[1] + p[2], 6).alias("total"), padded.alias("padded"))


@R.add(f"{q.with_(q.FEATURES, _ROWS)} SELECT symbol, count(*) AS samples, true AS bounded FROM training WHERE fold = {SPLITS - 1} GROUP BY symbol")
def stacked_model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What :func:`stacked_model_metric_values` must fulfil."""
    out = stacked_model_metric_values(spark, sf)
    names = ["balanced_accuracy", "f1_score", "accuracy"]
    bounded = F.forall(F.array(*names), lambda x: x.between(0, 1))
    return out.select("symbol", "samples", bounded.alias("bounded"))


@R.add()
def stacked_model_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold chances of both base learners for every row, and those of the second classifier on the last fold."""
    known = (spark.sparkContext.applicationId, sf)
    if known not in _stacked:
        rows = training_rows(spark, sf)
        oof = stage(
            learning.out_of_fold(rows, FEATURES, SEQUENCE_FEATURES, SPLITS, trees=SIZES.trees, depth=SIZES.depth), "oof"
        )
        stack = learning.fit_stack(oof.where((F.col("fold") >= 0) & (F.col("fold") < SPLITS - 1)))
        test = oof.select("symbol", "ts", "fold", "target_class", *learning.META)
        last = F.col("fold") == SPLITS - 1
        scored = trees.score(trees.nodes(stack), test.where(last), learning.META, learning.PROBS)
        none = {n: F.lit(None).cast("double") for n in learning.PROBS} | {"predicted": F.lit(None).cast("int")}
        _stacked[known] = stage(scored.unionByName(test.where(~last).withColumns(none)), "stacked")
    return _stacked[known]


_stacked: dict[tuple[str, str], DataFrame] = {}


@R.add()
def stacked_model_metric_values(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the stack by symbol, from its predictions on the last fold."""
    test = stacked_model_probabilities(spark, sf).where(F.col("predicted").isNotNull())
    judged_ = test.select("symbol", F.col("target_class").alias("truth"), F.col("predicted").alias("pred"))
    return metrics.summary_metrics(judged_, ["symbol"])


@R.add("SELECT (range + 1)::INT AS rank, true AS known, true AS falling FROM range(5)")
def top_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """What the five largest of :func:`feature_importances` must fulfil."""
    top = stats.top_n(feature_importances(spark, sf), "importance", 5, "feature")
    w = Window.orderBy(F.desc("importance"), "feature")  # five rows
    falling = F.coalesce(F.col("importance") <= F.lag("importance").over(w), F.lit(True))
    return top.select(
        F.row_number().over(w).alias("rank"), F.col("feature").isin(FEATURES).alias("known"), falling.alias("falling")
    )


@R.add()
def feature_importances(spark: SparkSession, sf: str) -> DataFrame:
    """Gains of the exported nodes, added up by feature."""
    model = learning.fit_tabular(training_rows(spark, sf), FEATURES, trees=SIZES.trees, depth=SIZES.depth)
    return trees.importance(trees.nodes(model))


@R.add(
    """SELECT p_brand AS feature, round(avg(p_retailprice), 4) AS importance FROM part GROUP BY p_brand
    ORDER BY importance DESC, feature LIMIT 5"""
)
def top_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The largest of a table of scores."""
    scores = inputs.table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature"))
    scores = scores.agg(F.round(F.avg("p_retailprice"), 4).alias("importance"))
    return stats.top_n(scores, "importance", 5, "feature")


@R.add(
    f"""{q.with_(q.FEATURES, _ROWS)}, f AS (SELECT range AS fold, (SELECT count(*) FROM times WHERE row < first + range * size) AS n FROM range({SPLITS}))
    SELECT f.fold::INT AS fold, count(*) FILTER (WHERE t.fold = f.fold) AS test_rows,
      count(*) FILTER (WHERE t.fold < f.fold AND row >= floor(n * (1 - {SIZES.holdout}))) AS selection_rows, true AS bounded, true AS listed
    FROM f, training t GROUP BY f.fold"""
)
def hyperparameter_search(spark: SparkSession, sf: str) -> DataFrame:
    grid = [{"trees": SIZES.meta_trees, "depth": d} for d in (SIZES.meta_depth, SIZES.depth)]
    out = learning.search(training_rows(spark, sf), FEATURES, grid, SPLITS)
    bounded = F.col("test_balanced_accuracy").between(0, 1) & F.col("selection_balanced_accuracy").between(0, 1)
    listed = F.col("params").isin([f"depth={g['depth']}, trees={g['trees']}" for g in grid])
    return out.select("fold", "test_rows", "selection_rows", bounded.alias("bounded"), listed.alias("listed"))


#: Trials of a search, and its ranges: few and low trees, so that it ends within minutes on one machine.
TRIALS = 4
SEARCHED = tuning.RANGES | {"n_estimators": ("int", 4, 10), "max_depth": ("int", 3, 5)}


def _drawn(name: str) -> str:
    kind, low, high = SEARCHED[name]
    u = f"(('0x' || substr(md5('{tuning.SEED}:' || trial || ':{name}'), 1, 12))::BIGINT / {2**48}::DOUBLE)"
    if kind == "int":
        return f"({int(low)} + floor({u} * {int(high) - int(low) + 1}))::INT AS {name}"
    if kind == "log":
        return f"round(exp(ln({low}::DOUBLE) + {u} * (ln({high}::DOUBLE) - ln({low}::DOUBLE))), 9) AS {name}"
    return f"round({low}::DOUBLE + {u} * {high - low}::DOUBLE, 9) AS {name}"


_trials: dict[tuple[str, str], DataFrame] = {}


@R.add()
def hyperparameter_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Every trial of a search by folds, its parameters and scores, and whether it was kept."""
    known = (spark.sparkContext.applicationId, sf)
    if known not in _trials:
        rows = training_rows(spark, sf).select("fold", "target_class", *FEATURES)
        _trials[known] = tuning.halving(rows, FEATURES, tuning.draw(TRIALS, SEARCHED), SPLITS)
    return _trials[known]


@R.add(
    f"""{q.with_(q.FEATURES, _ROWS)}, drawn AS (SELECT range::INT AS trial, {', '.join(_drawn(n) for n in SEARCHED)} FROM (SELECT range, range AS trial FROM range({TRIALS})))
    SELECT drawn.*, (SELECT count(*) FROM training WHERE fold = 0) AS samples FROM drawn"""
)
def hyperparameter_draws(spark: SparkSession, sf: str) -> DataFrame:
    """The first round of the search: what was drawn, and how many rows judged it."""
    first = hyperparameter_trials(spark, sf).where("round = 0")
    return rounded(first.select("trial", *SEARCHED, "samples"), [n for n, r in SEARCHED.items() if r[0] != "int"], 9)


@R.add(
    f"""SELECT doc_id, (range + 1)::INT AS rank, true AS known, true AS falling FROM documents, range(3)"""
)
def topics_of_news(spark: SparkSession, sf: str) -> DataFrame:
    """Three most likely topics of each document."""
    tokens = topic_tokens(F.col("text"), sentiment.STOP_WORDS)
    docs = stage(inputs.news(spark, sf).select("doc_id", tokens.alias("tokens")), "tokens")
    model = learning.fit_topics(docs)
    top = learning.top_topics(learning.topic_distribution(model, docs, ["doc_id"]), ["doc_id"])
    before = F.lag("probability").over(Window.partitionBy("doc_id").orderBy("rank"))
    return top.select(
        "doc_id",
        "rank",
        F.col("topic").between(0, learning.TOPICS - 1).alias("known"),
        (F.col("probability").between(0, 1) & F.coalesce(F.col("probability") <= before, F.lit(True))).alias("falling"),
    )


@R.add(
    """WITH t AS (SELECT doc_id, unnest(range(10)) AS topic, ((doc_id * 7 + topic * 13) % 11 + 1)::DOUBLE / 100 AS p FROM documents)
    SELECT doc_id, topic::INT AS topic, p AS probability, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, topic)::INT AS rank
    FROM t QUALIFY rank <= 3"""
)
def top_topics_of_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The largest of a table of topic shares, ties by number."""
    share = lambda i: ((F.col("doc_id") * 7 + i * 13) % 11 + 1).cast("double") / 100
    topics = F.transform(F.sequence(F.lit(0), F.lit(9)), share)
    dist = inputs.table(spark, sf, "documents").select("doc_id", topics.alias("topics"))
    return learning.top_topics(dist, ["doc_id"])


# Topics as tables. The twin repeats the whole fit: the first weights come from digests, and no step is random.

#: Rounds over all documents.
TOPIC_ROUNDS = 10
_K = learning.TOPICS


def _digamma(x: str) -> str:
    tail = " - ".join(f"1 / ({x} + {i})" for i in range(6))
    y = f"({x} + 6)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y}**2) + 1 / (120 * {y}**4) - 1 / (252 * {y}**6) - {tail})"


def _listed(cell: str) -> str:
    return "[" + ", ".join(cell.format(k=k, i=k + 1) for k in range(_K)) + "]"


def _topic_rounds() -> str:
    tokens = f"""list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z\\s]', '', 'g'), '\\s+'),
        lambda t: length(t) > 3 AND NOT list_contains({sentiment.STOP_WORDS}, t))"""
    first = f"{1 / _K}::DOUBLE - ln((('0x' || substr(md5('{learning.TOPIC_SEED}:{{k}}:' || word), 1, 12))::BIGINT + 0.5::DOUBLE) / {2**48}::DOUBLE)"
    parts = [
        f"""tc AS MATERIALIZED (SELECT doc_id, word, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({tokens}) AS word FROM news) GROUP BY ALL),
vocab AS (SELECT word FROM tc GROUP BY word HAVING count(*) >= {learning.TOPIC_MIN_DOCS} AND count(*) <= {learning.TOPIC_MAX_SHARE} * (SELECT count(*) FROM news)),
kc AS MATERIALIZED (SELECT * FROM tc JOIN vocab USING (word)),
lam0 AS MATERIALIZED (SELECT word, {_listed(first)} AS l FROM vocab)"""
    ]
    up = f"list_transform(g, lambda x: exp({_digamma('x')})) AS e"
    for r in range(TOPIC_ROUNDS + 1):
        chance = f"exp({_digamma('l[{i}]')} - {_digamma('t[{i}]')})"
        parts.append(
            f"""tot{r} AS MATERIALIZED (SELECT {_listed('sum(l[{i}])')} AS t FROM lam{r}),
cw{r} AS MATERIALIZED (SELECT doc_id, word, n, w FROM kc JOIN (SELECT word, {_listed(chance)} AS w FROM lam{r}, tot{r}) USING (word)),
s{r}_0 AS MATERIALIZED (SELECT *, {up} FROM (SELECT doc_id, {_listed(f'{1 / _K}::DOUBLE + sum(n) / {_K}')} AS g FROM cw{r} GROUP BY doc_id))"""
        )
        for s in range(topics.STEPS):
            parts.append(
                f"""s{r}_{s + 1} AS MATERIALIZED (SELECT *, {up} FROM (SELECT doc_id, {_listed(f'{1 / _K}::DOUBLE + sum(n * e[{{i}}] * w[{{i}}] / d)')} AS g
  FROM (SELECT c.*, e, list_inner_product(e, w) AS d FROM cw{r} c JOIN s{r}_{s} USING (doc_id)) GROUP BY doc_id))"""
            )
        if r < TOPIC_ROUNDS:
            parts.append(
                f"""lam{r + 1} AS MATERIALIZED (SELECT word, {_listed(f'{1 / _K}::DOUBLE + sum(n * e[{{i}}] * w[{{i}}] / d)')} AS l
  FROM (SELECT c.*, e, list_inner_product(e, w) AS d FROM cw{r} c JOIN s{r}_{topics.STEPS} USING (doc_id)) GROUP BY word)"""
            )
    return ",\n".join(parts)


_TOPIC_ROUNDS = _topic_rounds()
_topic_counts: dict[tuple[str, str], tuple[DataFrame, DataFrame, int]] = {}
_topic_model: dict[tuple[str, str], DataFrame] = {}


def _topic_docs(spark: SparkSession, sf: str) -> DataFrame:
    tokens = topic_tokens(F.col("text"), sentiment.STOP_WORDS)
    return inputs.news(spark, sf).select("doc_id", tokens.alias("tokens"))


def _topic_counted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    known = (spark.sparkContext.applicationId, sf)
    if known not in _topic_counts:
        _topic_counts[known] = topics.counted(_topic_docs(spark, sf), "doc_id")
    return _topic_counts[known]


def _topic_weights(spark: SparkSession, sf: str) -> DataFrame:
    known = (spark.sparkContext.applicationId, sf)
    if known not in _topic_model:
        docs, counts = _topic_docs(spark, sf), _topic_counted(spark, sf)
        _topic_model[known] = topics.fit(docs, "doc_id", rounds=TOPIC_ROUNDS, counts=counts)
    return _topic_model[known]


def _topic_shares(spark: SparkSession, sf: str) -> DataFrame:
    docs, counts = _topic_docs(spark, sf), _topic_counted(spark, sf)
    return topics.shares(docs, _topic_weights(spark, sf), "doc_id", counts=counts)


@R.add(
    f"""{q.with_(q.NEWS, _TOPIC_ROUNDS)} SELECT (k - 1)::INT AS topic, word, {q.r('l[k] / t[k]', 7)} AS weight
    FROM lam{TOPIC_ROUNDS}, tot{TOPIC_ROUNDS}, range(1, {_K + 1}) r(k)"""
)
def topic_word_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The chance of every word of the vocabulary in every topic."""
    return rounded(topics.word_chances(_topic_weights(spark, sf)), ["weight"], 7)


@R.add(
    f"""{q.with_(q.NEWS, _TOPIC_ROUNDS)} SELECT doc_id, (k - 1)::INT AS topic, {q.r(f'coalesce(g[k] / list_sum(g), {1 / _K})', 5)} AS share
    FROM news LEFT JOIN s{TOPIC_ROUNDS}_{topics.STEPS} USING (doc_id), range(1, {_K + 1}) r(k)"""
)
def topic_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of every topic in every document."""
    found = _topic_shares(spark, sf)
    out = found.select("doc_id", F.posexplode("topics").alias("topic", "share"))
    return rounded(out, ["share"], 5)


@R.add(
    f"""{q.with_(q.NEWS, _TOPIC_ROUNDS)} SELECT doc_id, topic, probability, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, topic)::INT AS rank
    FROM (SELECT doc_id, (k - 1)::INT AS topic, {q.r(f'coalesce(g[k] / list_sum(g), {1 / _K})', 5)} AS probability
      FROM news LEFT JOIN s{TOPIC_ROUNDS}_{topics.STEPS} USING (doc_id), range(1, {_K + 1}) r(k)) QUALIFY rank <= 3"""
)
def top_topics_of_news(spark: SparkSession, sf: str) -> DataFrame:
    """The three largest topics of every document, of shares to five digits, ties by number."""
    found = _topic_shares(spark, sf)
    digits = F.transform("topics", lambda x: F.round(x, 5))
    return learning.top_topics(found.select("doc_id", digits.alias("topics")), ["doc_id"])
