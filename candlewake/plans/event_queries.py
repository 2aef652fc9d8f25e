"""Queries on calendar events, news text and their joins to bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.functions.text import topic_tokens
from candlewake.operators import events, positioning, sentiment, timeline, wordmodel
from candlewake.plans import inputs
from candlewake.plans import sqltext as q
from candlewake.plans.registry import Registry, rounded
from candlewake.schema import PAIRS
from candlewake.session import stage

R = Registry()

_ROLES = f"""roles AS (
  SELECT symbol, currency, currency_role,
         {q.COUNTRY_LIST}[list_position({q.CURRENCY_LIST}, currency)] AS country
  FROM (SELECT symbol, left(symbol, 3) AS currency, 'base' AS currency_role FROM pairs
        UNION ALL SELECT symbol, right(symbol, 3), 'quote' FROM pairs)
  WHERE list_contains({q.CURRENCY_LIST}, currency))"""
_PAIRS = f"pairs AS (SELECT unnest({q.PAIR_LIST}) AS symbol)"
_SURPRISE = """zs AS MATERIALIZED (
  SELECT * EXCLUDE (e, sd, n, m, s), least(5.0, greatest(-5.0, coalesce(
      CASE WHEN n >= 5 THEN CASE WHEN sd = 0 THEN CASE WHEN e > 0 THEN 5.0 WHEN e < 0 THEN -5.0 END ELSE e / sd END END,
      CASE WHEN s > 0 THEN (e - m) / s END, 0.0))) AS surprise_zscore
  FROM (SELECT *, stddev_samp(e) OVER w AS sd, count(e) OVER w AS n,
               avg(e) OVER (PARTITION BY event_name) AS m, stddev_samp(e) OVER (PARTITION BY event_name) AS s
        FROM (SELECT *, actual_value - consensus_forecast AS e FROM calendar)
        WINDOW w AS (PARTITION BY event_name ORDER BY ts, event_id ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)))"""
_ATTACHED = "attached AS (SELECT z.*, r.symbol, r.currency, r.currency_role FROM zs z JOIN roles r USING (country))"


def _pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PAIRS], "symbol string")


def _surprise(spark: SparkSession, sf: str) -> DataFrame:
    return events.surprise_zscore(inputs.calendar(spark, sf), order=["ts", "event_id"])


def attached_events(spark: SparkSession, sf: str) -> DataFrame:
    return events.attach_to_pairs(_surprise(spark, sf), _pairs(spark))


@R.add(
    f"""{q.with_(q.BARS, 'pairs AS (SELECT DISTINCT symbol FROM bars)', _ROLES)} SELECT * FROM roles"""
)
def pair_currencies(spark: SparkSession, sf: str) -> DataFrame:
    return events.pair_countries(inputs.bars(spark, sf).select("symbol").distinct())


@R.add(
    f"""{q.with_(q.CALENDAR, _PAIRS, _ROLES, _SURPRISE, _ATTACHED)}
    SELECT event_id, symbol, ts, event_name, country, currency, currency_role FROM attached"""
)
def calendar_by_pair(spark: SparkSession, sf: str) -> DataFrame:
    return attached_events(spark, sf).select(
        "event_id", "symbol", "ts", "event_name", "country", "currency", "currency_role"
    )


@R.add(
    f"{q.with_(q.CALENDAR, _SURPRISE)} SELECT event_id, event_name, {q.r('surprise_zscore')} AS surprise_zscore FROM zs"
)
def surprise_zscore(spark: SparkSession, sf: str) -> DataFrame:
    out = _surprise(spark, sf).select("event_id", "event_name", "surprise_zscore")
    return rounded(out, ["surprise_zscore"])


@R.add(
    f"""{q.with_(q.CALENDAR)} SELECT event_id, {q.r('(actual_value - consensus_forecast) / (abs(consensus_forecast) + 0.01::DOUBLE)', 6)}
      AS surprise_factor FROM calendar"""
)
def surprise_factor(spark: SparkSession, sf: str) -> DataFrame:
    c = inputs.calendar(spark, sf)
    f = events.surprise_factor(F.col("actual_value"), F.col("consensus_forecast"))
    return rounded(c.select("event_id", f.alias("surprise_factor")), ["surprise_factor"], 6)


@R.add(
    f"""{q.with_(q.CALENDAR)} SELECT event_id, country, {q.r('''(actual_value - consensus_forecast)
      / (stddev_samp(previous_value) OVER (PARTITION BY country) + 1e-8)''')} AS surprise_zscore FROM calendar"""
)
def surprise_at_scoring(spark: SparkSession, sf: str) -> DataFrame:
    c = inputs.calendar(spark, sf).withColumnsRenamed(
        {"actual_value": "actual", "consensus_forecast": "forecast", "previous_value": "previous"}
    )
    out = events.request_surprise(c, "country").select("event_id", "country", "surprise_zscore")
    return rounded(out, ["surprise_zscore"])


@R.add(
    f"""{q.with_(q.CALENDAR, _PAIRS, _ROLES, _SURPRISE, _ATTACHED)}
    SELECT symbol, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts,
      string_agg(DISTINCT country, ', ' ORDER BY country) AS countries FROM attached GROUP BY symbol"""
)
def event_summary(spark: SparkSession, sf: str) -> DataFrame:
    return events.event_summary(attached_events(spark, sf))


@R.add(
    f"""{q.with_(q.CALENDAR)} SELECT event_id, ts, country, 'US feed' AS feed, actual_value, NULL::DOUBLE AS consensus_forecast
      FROM calendar WHERE country = 'US' UNION ALL
    SELECT event_id, ts, country, 'other feed', NULL, consensus_forecast FROM calendar WHERE country <> 'US'"""
)
def event_union(spark: SparkSession, sf: str) -> DataFrame:
    c = inputs.calendar(spark, sf)
    us = c.where("country = 'US'").select(
        "event_id", "ts", "country", F.lit("US feed").alias("feed"), "actual_value"
    )
    other = c.where("country <> 'US'").select(
        "event_id", "ts", "country", F.lit("other feed").alias("feed"), "consensus_forecast"
    )
    return events.union_events(us, other)


_H = "(epoch_us({a}) - epoch_us({b})) / 3.6e9"


@R.add(
    f"""{q.with_(q.HOURS, q.CALENDAR, _PAIRS, _ROLES, _SURPRISE, _ATTACHED)},
    pre AS (SELECT h.symbol, h.ts, max(1 / (1 + {_H.format(a='e.ts', b='h.ts')} / 24)) AS tau_pre
      FROM hours h JOIN attached e ON h.symbol = e.symbol AND h.ts < e.ts AND h.ts >= e.ts - INTERVAL 24 HOUR GROUP BY ALL),
    post AS (SELECT h.symbol, h.ts, max(exp(-0.1::DOUBLE * {_H.format(a='h.ts', b='e.ts')})) AS tau_post,
        sum(surprise_zscore * exp(-0.1::DOUBLE * {_H.format(a='h.ts', b='e.ts')})) AS weighted_surprise
      FROM hours h JOIN attached e ON h.symbol = e.symbol AND h.ts >= e.ts AND h.ts < e.ts + INTERVAL 48 HOUR GROUP BY ALL)
    SELECT symbol, ts, close, {', '.join(f"{q.r(f'coalesce({n}, 0.0)')} AS {n}" for n in ('tau_pre', 'tau_post', 'weighted_surprise'))}
    FROM hours LEFT JOIN pre USING (symbol, ts) LEFT JOIN post USING (symbol, ts)"""
)
def event_proximity(spark: SparkSession, sf: str) -> DataFrame:
    out = timeline.event_proximity(inputs.hours(spark, sf), attached_events(spark, sf))
    names = ["tau_pre", "tau_post", "weighted_surprise"]
    return rounded(out.select("symbol", "ts", "close", *names), names)


@R.add(
    f"""{q.with_(q.BARS)} SELECT symbol, ts, 0.0::DOUBLE AS tau_pre, 0.0::DOUBLE AS tau_post,
      0.0::DOUBLE AS weighted_surprise FROM bars"""
)
def event_proximity_without_events(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of other years than the events: every column falls back to zero."""
    out = timeline.event_proximity(inputs.bars(spark, sf), attached_events(spark, sf))
    return out.select("symbol", "ts", "tau_pre", "tau_post", "weighted_surprise")


@R.add(
    f"""{q.with_(q.TICKS, q.CALENDAR)}, marked AS (SELECT ts FROM calendar
        WHERE event_name IN ('release 1', 'release 4') AND country IN ('US', 'EU'))
    SELECT event_id, symbol, ts FROM ticks t WHERE NOT EXISTS (SELECT 1 FROM marked m
      WHERE m.ts BETWEEN t.ts - INTERVAL 30 MINUTE AND t.ts + INTERVAL 30 MINUTE)"""
)
def news_blackout(spark: SparkSession, sf: str) -> DataFrame:
    from candlewake.functions.gates import mentions

    marked = inputs.calendar(spark, sf).where(
        mentions(F.col("event_name"), "release 1;release 4") & F.col("country").isin("US", "EU")
    )
    t = inputs.ticks(spark, sf).select("event_id", "symbol", "ts")
    return timeline.outside_blackout(t, marked.select("ts"))


@R.add(
    f"""{q.with_(q.CALENDAR)} SELECT event_id, event_name, country FROM calendar
    WHERE (contains(event_name, 'release 1') OR contains(event_name, '4')) AND country IN ('US', 'JP')"""
)
def news_keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    from candlewake.functions.gates import mentions

    c = inputs.calendar(spark, sf)
    keep = mentions(F.col("event_name"), "release 1, 4;") & F.col("country").isin("US", "JP")
    return c.where(keep).select("event_id", "event_name", "country")


# Text and sentiment ------------------------------------------------------------------


def _words(ws: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


_HITS = lambda ws: f"len(list_filter(w, lambda t: list_contains({_words(ws)}, t)))"
ARTICLES = f"""articles AS MATERIALIZED (
  SELECT doc_id, ts, currency, label, score, blank,
    {', '.join(f"CASE WHEN blank THEN {1.0 if n == 'neutral' else 0.0} WHEN label = '{n}' THEN score ELSE (1 - score) / 2 END::DOUBLE AS {n}" for n in ('positive', 'negative', 'neutral'))},
    positive - negative AS polarity
  FROM (SELECT *, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS label,
      coalesce(0.5::DOUBLE + abs(p - n) / nullif(p + n, 0)::DOUBLE / 2, 1.0::DOUBLE) AS score
    FROM (SELECT *, {_HITS(sentiment.POSITIVE_WORDS)} AS p, {_HITS(sentiment.NEGATIVE_WORDS)} AS n,
        len(regexp_replace(text, '\\s', '', 'g')) = 0 AS blank
      FROM (SELECT *, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM news))))"""
_PARTS = ", ".join(f"{q.r(n, 6)} AS {n}" for n in sentiment.PARTS)


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    return sentiment.article_sentiment(inputs.news(spark, sf))


@R.add(f"{q.with_(q.NEWS, ARTICLES)} SELECT doc_id, {_PARTS} FROM articles")
def article_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_articles(spark, sf).select("doc_id", *sentiment.PARTS), sentiment.PARTS, 6)


@R.add(
    f"""{q.with_(q.NEWS, ARTICLES)} SELECT doc_id, {_PARTS} FROM articles"""
)
def article_sentiment_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """The same word rule as a pluggable scorer on Arrow batches."""
    out = sentiment.article_sentiment(inputs.news(spark, sf), scorer=sentiment.word_scorer)
    return rounded(out.select("doc_id", *sentiment.PARTS), sentiment.PARTS, 6)


DAILY = f"""daily AS MATERIALIZED (SELECT currency, ts::DATE AS date, {', '.join(f'avg({n}) AS {n}' for n in sentiment.PARTS)}
  FROM articles GROUP BY ALL)"""


@R.add(f"{q.with_(q.NEWS, ARTICLES, DAILY)} SELECT currency, date, {_PARTS} FROM daily")
def daily_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    out = sentiment.daily_sentiment(_articles(spark, sf), ["currency"])
    return rounded(out, sentiment.PARTS, 6)


_EMA_COLS = [f"{x}_ema_{n}" for x in sentiment.SMOOTHED for n in sentiment.EMA_SPANS]
_STEPS = ", ".join(
    f"p.{x}_ema_{n} * (1 - 2.0::DOUBLE / {n + 1}) + 2.0::DOUBLE / {n + 1} * d.{x} AS {x}_ema_{n}"
    for x in sentiment.SMOOTHED
    for n in sentiment.EMA_SPANS
)
EMAS = f"""dix AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY date) AS i FROM daily),
smooth AS (SELECT currency, i, date, polarity, positive, negative,
    {', '.join(f'{x} AS {x}_ema_{n}' for x in sentiment.SMOOTHED for n in sentiment.EMA_SPANS)} FROM dix WHERE i = 1
  UNION ALL SELECT d.currency, d.i, d.date, d.polarity, d.positive, d.negative, {_STEPS}
  FROM smooth p JOIN dix d ON d.currency = p.currency AND d.i = p.i + 1)"""


@R.add(
    f"{q.with_(q.NEWS, ARTICLES, DAILY, EMAS)} SELECT currency, date, {q.rounded(_EMA_COLS, 6)} FROM smooth"
)
def sentiment_ema(spark: SparkSession, sf: str) -> DataFrame:
    daily = sentiment.daily_sentiment(_articles(spark, sf), ["currency"])
    out = sentiment.sentiment_ema(daily, ["currency"]).select("currency", "date", *_EMA_COLS)
    return rounded(out, _EMA_COLS, 6)


@R.add(
    f"""{q.with_(q.NEWS, ARTICLES, q.HOURS)}, d AS (SELECT ts::DATE AS date, {', '.join(f'avg({n}) AS {n}' for n in sentiment.PARTS)}
      FROM articles GROUP BY ALL)
    SELECT symbol, ts, {', '.join(f"{q.r(f'coalesce({n}, 0.0)', 6)} AS {n}" for n in sentiment.PARTS)}
    FROM hours h LEFT JOIN d ON h.ts::DATE = d.date + 1"""
)
def sentiment_joined_to_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Yesterday's sentiment on today's bars."""
    daily = sentiment.daily_sentiment(_articles(spark, sf))
    out = sentiment.attach_daily(inputs.hours(spark, sf), daily, lag_days=1)
    return rounded(out.select("symbol", "ts", *sentiment.PARTS), sentiment.PARTS, 6)


_DIFFS = ["polarity", "positive", "negative", *[f"polarity_ema_{n}" for n in sentiment.EMA_SPANS]]


@R.add(
    f"""{q.with_(q.NEWS, ARTICLES, DAILY, EMAS)},
    p AS (SELECT unnest({q.PAIR_LIST}) AS symbol),
    b AS (SELECT symbol, smooth.* FROM smooth JOIN p ON currency = left(symbol, 3)), u AS (SELECT symbol, smooth.* FROM smooth JOIN p ON currency = right(symbol, 3))
    SELECT symbol, date, {', '.join(f"{q.r(f'coalesce(b.{n}, 0.0) - coalesce(u.{n}, 0.0)', 6)} AS {n}_diff" for n in _DIFFS)}
    FROM b FULL JOIN u USING (symbol, date)"""
)
def sentiment_differential(spark: SparkSession, sf: str) -> DataFrame:
    """All configured pairs: sentiment of the base currency minus that of the quote currency."""
    daily = sentiment.daily_sentiment(_articles(spark, sf), ["currency"])
    smooth = stage(sentiment.sentiment_ema(daily, ["currency"]), "sentiment")
    names = F.explode(F.array(*[F.lit(p) for p in PAIRS]))
    pairs = spark.range(1).select(names.alias("symbol"))
    side = lambda at: pairs.withColumn("currency", F.substring("symbol", at, 3)).join(smooth, "currency").drop("currency")
    out = sentiment.differential_sentiment(side(1), side(5), ["symbol"])
    return rounded(out, [f"{n}_diff" for n in _DIFFS], 6)




@R.add(
    f"""{q.with_(q.NEWS)} SELECT doc_id, array_to_string(list_filter(
      regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z\\s]', '', 'g'), '\\s+'),
      lambda t: length(t) > 3 AND NOT list_contains({_words(sentiment.STOP_WORDS)}, t)), ' ') AS tokens FROM news"""
)
def topic_tokens_of_news(spark: SparkSession, sf: str) -> DataFrame:
    n = inputs.news(spark, sf)
    return n.select("doc_id", F.array_join(topic_tokens(F.col("text"), sentiment.STOP_WORDS), " ").alias("tokens"))


# Learned text scorer ------------------------------------------------------------------
# The label toxic stands in for bad news. Every fifth labelled document is held out.


def _word_rounds() -> str:
    w = f"""(SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda t: t <> '') AS w FROM news)"""
    negated = f"list_has_any(w[greatest(i - {wordmodel.REACH}, 1):i - 1], {_words(wordmodel.NEGATIONS)})"
    parts = [
        f"""wl AS MATERIALIZED (SELECT doc_id, 1 - toxic AS y FROM labels WHERE toxic IS NOT NULL AND doc_id % 5 <> 0 AND doc_id IN (SELECT doc_id FROM news)),
wt AS MATERIALIZED (SELECT DISTINCT doc_id, (('0x' || substr(md5(t), 1, 8))::BIGINT % {wordmodel.SLOTS})::INT AS slot
  FROM (SELECT doc_id, unnest(list_transform(w, lambda t, i: CASE WHEN i > 1 AND {negated} THEN 'not_' || t ELSE t END)) AS t FROM {w})),
wc AS (SELECT doc_id, y, CASE WHEN y = 1 THEN n / 2 / greatest(1, ones) ELSE n / 2 / greatest(1, n - ones) END AS c
  FROM wl, (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS ones FROM wl)),
wr AS MATERIALIZED (SELECT * FROM wt JOIN wc USING (doc_id) WHERE slot IN (SELECT slot FROM wt JOIN wl USING (doc_id) GROUP BY slot HAVING count(*) >= {wordmodel.LEAST_DOCS})),
w0 AS MATERIALIZED (SELECT slot, sum(c) / 4 + {wordmodel.PENALTY}::DOUBLE AS curve, 0.0::DOUBLE AS weight FROM wr GROUP BY slot)"""
    ]
    for i in range(wordmodel.ROUNDS):
        parts.append(
            f"""r{i} AS MATERIALIZED (SELECT doc_id, any_value(c * (y - 1 / (1 + exp(-m / sqrt(n))))) / any_value(sqrt(n)) AS r FROM wc JOIN
  (SELECT doc_id, sum(weight) AS m, count(*) AS n FROM wr JOIN w{i} USING (slot) GROUP BY doc_id) USING (doc_id) GROUP BY doc_id),
w{i + 1} AS MATERIALIZED (SELECT slot, curve, weight + (g - {wordmodel.PENALTY}::DOUBLE * weight) / curve AS weight
  FROM w{i} JOIN (SELECT slot, sum(r) AS g FROM wr JOIN r{i} USING (doc_id) GROUP BY slot) USING (slot))"""
        )
    return ",\n".join(parts)


_WORD_ROUNDS = _word_rounds()
_CHANCES = f"""chances AS (SELECT doc_id, 1 / (1 + exp(-sum(weight) / sqrt(count(*)))) AS p FROM wt JOIN w{wordmodel.ROUNDS} USING (slot) GROUP BY doc_id)"""
_word_weights: dict[tuple[str, str], DataFrame] = {}


def _fitted_words(spark: SparkSession, sf: str) -> DataFrame:
    known = (spark.sparkContext.applicationId, sf)
    if known not in _word_weights:
        marks = inputs.table(spark, sf, "labels").where("doc_id % 5 <> 0").select("doc_id", (F.col("toxic") == 0).alias("positive"))
        _word_weights[known] = wordmodel.fit(inputs.news(spark, sf).join(marks, "doc_id"), "doc_id")
    return _word_weights[known]


@R.add(f"{q.with_(q.NEWS, _WORD_ROUNDS)} SELECT slot, {q.r('weight', 6)} AS weight FROM w{wordmodel.ROUNDS}")
def learned_word_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted weights of hashed words, marked where a negation is near."""
    return rounded(_fitted_words(spark, sf), ["weight"], 6)


_PLACED = f"""SELECT doc_id, CASE WHEN blank THEN 'neutral' WHEN p > 0.5 THEN 'positive' WHEN p <= 0.5 THEN 'negative' ELSE label END AS lab,
  CASE WHEN p IS NULL THEN score ELSE greatest(p, 1 - p) END AS sc, blank FROM articles LEFT JOIN chances USING (doc_id)"""


@R.add(
    f"""{q.with_(q.NEWS, ARTICLES, _WORD_ROUNDS, _CHANCES)} SELECT doc_id, {', '.join(f"{q.r(n, 6)} AS {n}" for n in ('positive', 'negative', 'neutral'))},
      {q.r('positive - negative', 6)} AS polarity FROM (SELECT doc_id,
      {', '.join(f"CASE WHEN blank THEN {1.0 if n == 'neutral' else 0.0} WHEN lab = '{n}' THEN sc ELSE (1 - sc) / 2 END::DOUBLE AS {n}" for n in ('positive', 'negative', 'neutral'))}
      FROM ({_PLACED}))"""
)
def learned_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Sentiment of every document by the fitted words, by the word list where none is known."""
    out = wordmodel.learned_sentiment(inputs.news(spark, sf), _fitted_words(spark, sf), "doc_id")
    return rounded(out.select("doc_id", *sentiment.PARTS), sentiment.PARTS, 6)


@R.add(
    f"""{q.with_(q.NEWS, _WORD_ROUNDS, _CHANCES)} SELECT toxic = 0 AS positive, doc_id % 5 = 0 AS held_out, count(*) AS documents,
      count(*) FILTER (WHERE (p > 0.5) = (toxic = 0)) AS right, {q.r('avg(p)', 6)} AS mean_chance
    FROM labels JOIN chances USING (doc_id) WHERE toxic IS NOT NULL GROUP BY ALL"""
)
def learned_sentiment_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How many labelled documents are placed right, fitted and held-out ones apart."""
    marks = inputs.table(spark, sf, "labels").where("toxic IS NOT NULL").select("doc_id", (F.col("toxic") == 0).alias("positive"))
    rows = marks.join(wordmodel.chances(inputs.news(spark, sf), _fitted_words(spark, sf), "doc_id"), "doc_id")
    out = rows.groupBy("positive", (F.col("doc_id") % 5 == 0).alias("held_out")).agg(
        F.count("*").alias("documents"),
        F.count_if((F.col("chance") > 0.5) == F.col("positive")).alias("right"),
        F.avg("chance").alias("mean_chance"),
    )
    return rounded(out, ["mean_chance"], 6)


# Positioning reports -------------------------------------------------------------------

_REPORTS = f"""reports AS (SELECT {q.pair_of('o_custkey')} AS symbol, o_orderdate AS ts, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 97 ELSE 0 END)::DOUBLE AS long,
    sum(CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 89 ELSE 0 END)::DOUBLE AS short, sum(o_orderkey % 101)::DOUBLE AS open_interest FROM orders GROUP BY ALL),
net AS (SELECT *, datediff('day', DATE '1970-01-01', ts::DATE) AS d, CASE WHEN open_interest <> 0 THEN (long - short) / open_interest END AS net_position FROM reports),
ranged AS (SELECT *, min(net_position) OVER w AS low, max(net_position) OVER w AS high FROM net
  WINDOW w AS (PARTITION BY symbol ORDER BY d RANGE BETWEEN (d % 7 + {7 * (positioning.WEEKS - 1)}) PRECEDING AND CURRENT ROW)),
placed AS (SELECT symbol, ts, net_position, (net_position - low) / nullif(high - low, 0) AS position_index FROM ranged)"""


def _placed_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports from the orders of a day, with their index."""
    key = F.col("o_orderkey")
    reports = inputs.table(spark, sf, "orders").groupBy(inputs.pair_of("o_custkey").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(
        F.sum(F.when(key % 2 == 0, key % 97).otherwise(0)).cast("double").alias("long"),
        F.sum(F.when(key % 2 == 1, key % 89).otherwise(0)).cast("double").alias("short"),
        F.sum(key % 101).cast("double").alias("open_interest"),
    )
    return positioning.positioning(reports, ["symbol"])


@R.add(f"{q.with_(_REPORTS)} SELECT symbol, ts, {q.r('net_position', 6)} AS net_position, {q.r('position_index', 6)} AS position_index FROM placed")
def positioning_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Net position and its place in the range of 156 weeks."""
    return rounded(_placed_reports(spark, sf).select("symbol", "ts", *positioning.COLUMNS), positioning.COLUMNS, 6)


@R.add(
    f"""{q.with_(q.BARS, _REPORTS)} SELECT b.symbol, b.ts, close, {q.r('net_position', 6)} AS net_position, {q.r('position_index', 6)} AS position_index
    FROM bars b ASOF LEFT JOIN placed p ON b.symbol = p.symbol AND b.ts >= p.ts"""
)
def positioning_joined_to_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with the latest report at or before them."""
    bars = inputs.bars(spark, sf).select("symbol", "ts", "close")
    return rounded(positioning.positioning_on_bars(bars, _placed_reports(spark, sf), ["symbol"]), positioning.COLUMNS, 6)
