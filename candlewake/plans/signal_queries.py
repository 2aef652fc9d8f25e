"""Queries on predictions, signals, gates, risk and the portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.functions import gates, risk, scoring
from candlewake.operators import indicators as ind
from candlewake.operators import metrics, performance, portfolio, trading
from candlewake.plans import inputs
from candlewake.plans import sqltext as q
from candlewake.plans.registry import Registry, rounded
from candlewake.schema import PAIRS

R = Registry()

# Symbols and gates -------------------------------------------------------------------

_NAMES = f"""named AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN replace(p, '_', '')
    WHEN 1 THEN lower(replace(p, '_', '')) || '.ecn' WHEN 2 THEN 'BTCUSD' WHEN 3 THEN 'DE40'
    ELSE p END AS symbol FROM (SELECT o_orderkey, {q.pair_of('o_custkey')} AS p FROM orders))"""


def _names(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("p")
    plain = F.replace(p, F.lit("_"), F.lit(""))
    named = (
        F.when(k % 5 == 0, plain)
        .when(k % 5 == 1, F.concat(F.lower(plain), F.lit(".ecn")))
        .when(k % 5 == 2, "BTCUSD")
        .when(k % 5 == 3, "DE40")
        .otherwise(p)
    )
    o = inputs.table(spark, sf, "orders").select("o_orderkey", inputs.pair_of("o_custkey").alias("p"))
    return o.select("o_orderkey", named.alias("symbol"))


@R.add(
    f"""WITH {_NAMES} SELECT o_orderkey, symbol, CASE WHEN length(symbol) >= 6
      THEN left(symbol, 3) || '_' || substr(symbol, 4, 3) ELSE symbol END AS pair, replace(symbol, '_', '') AS broker FROM named"""
)
def symbol_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("symbol")
    return _names(spark, sf).withColumns(
        {"pair": gates.pair_name(s), "broker": gates.broker_name(s)}
    )


@R.add(
    f"""WITH {_NAMES}, bare AS (SELECT *, upper(replace(replace(replace(replace(replace(symbol, '.ecn', ''), '.raw', ''), '.pro', ''), '.m', ''), '.', '')) AS b FROM named)
    SELECT o_orderkey, symbol FROM bare WHERE len(list_filter({gates.ALLOWED}, lambda a: contains(a, b) OR contains(b, a))) > 0"""
)
def symbol_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).where(gates.is_allowed(F.col("symbol")))


_RESOLVED = f"""resolved AS (SELECT o_orderkey, symbol, CASE WHEN t IN ('EUR_USD', 'GBP_USD', 'USD_JPY', 'AUD_USD') THEN t END AS model_pair
  FROM (SELECT *, CASE WHEN symbol IN ('BTCUSD', 'BTC_USD', 'XBTUSD') THEN 'EUR_USD' ELSE symbol END AS t FROM named))"""


@R.add(
    f"""WITH {_NAMES}, {_RESOLVED} SELECT *, CASE WHEN model_pair IS NULL THEN 'unsupported' ELSE 'ok' END AS status FROM resolved"""
)
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    out = gates.resolve_alias(_names(spark, sf), ["EUR_USD", "GBP_USD", "USD_JPY", "AUD_USD"])
    return out.withColumn("status", F.when(F.col("model_pair").isNull(), "unsupported").otherwise("ok"))


@R.add(
    f"""WITH {q.TICKS}, h AS (SELECT event_id, ts, hour(ts) AS h FROM ticks)
    SELECT event_id, ts, concat_ws(',', CASE WHEN h >= 0 AND h < 9 THEN 'asian' END, CASE WHEN h >= 8 AND h < 17 THEN 'london' END,
      CASE WHEN h >= 13 AND h < 22 THEN 'newyork' END) AS sessions, h >= 22 OR h < 2 AS night
    FROM h WHERE h >= 8 AND h < 22"""
)
def session_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks inside London or New York hours, with session names and a session past midnight."""
    ts = F.col("ts")
    t = inputs.ticks(spark, sf).select("event_id", "ts")
    return t.where(gates.in_session(ts, gates.SESSIONS[1:])).withColumns(
        {"sessions": gates.session_names(ts), "night": gates.in_hours(F.hour(ts), 22, 2)}
    )


@R.add(f"WITH {q.TICKS} SELECT event_id, symbol, ts FROM ticks WHERE NOT (hour(ts) BETWEEN 2 AND 5)")
def dead_hour_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = inputs.ticks(spark, sf).select("event_id", "symbol", "ts")
    return t.where(gates.outside_dead_hours(F.col("ts")))


@R.add(
    f"""WITH {q.TICKS} SELECT 'end of day' AS rule, symbol, ts::DATE AS date, min(ts) AS close_ts FROM ticks
      WHERE hour(ts) = 23 AND minute(ts) >= 55 GROUP BY ALL
    UNION ALL SELECT 'custom', symbol, ts::DATE, min(ts) FROM ticks WHERE hour(ts) = 17 AND minute(ts) >= 30 GROUP BY ALL"""
)
def auto_close_flag(spark: SparkSession, sf: str) -> DataFrame:
    t, ts = inputs.ticks(spark, sf), F.col("ts")
    rules = {"end of day": gates.closes_end_of_day(ts), "custom": gates.closes_at(ts, 17, 30)}
    parts = [
        trading.daily_close_flag(t, cond).withColumn("rule", F.lit(name))
        for name, cond in rules.items()
    ]
    return parts[0].unionByName(parts[1])


def _with_atr(spark: SparkSession, sf: str) -> DataFrame:
    b = ind.smoothed(ind.with_moves(ind.feature_blocks(inputs.bars(spark, sf))), {"atr_14"})
    return b.close().select("symbol", "ts", "close", "volume", "atr_14")


_ATR = q.with_(q.BARS, q.smoothed(), "atr AS (SELECT symbol, ts, close, volume, atr_14 FROM feat0)")


@R.add(
    f"""{_ATR} SELECT symbol, ts, spread, CASE WHEN atr_14 IS NULL THEN true ELSE NOT (
        (CASE WHEN n >= 100 THEN atr_14 ELSE 0 END) < 0.5 * (CASE WHEN n >= 100 THEN m ELSE 0 END)
        OR spread > 0.3 * (CASE WHEN n >= 100 THEN atr_14 ELSE 0 END)) END AS allowed
    FROM (SELECT *, volume::DOUBLE * 8 AS spread, avg(atr_14) OVER w AS m, count(atr_14) OVER w AS n FROM atr
      WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""
)
def volatility_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_atr(spark, sf).withColumn("spread", F.col("volume").cast("double") * 8)
    return trading.volatility_gate(rows).select("symbol", "ts", "spread", "allowed")


_REGIME = """regime AS (SELECT symbol, ts, close, atr_14, CASE WHEN n < 50 THEN 'MEDIUM' WHEN atr_14 < m - 0.5 * s THEN 'LOW'
      WHEN atr_14 > m + 0.5 * s THEN 'HIGH' ELSE 'MEDIUM' END AS regime
    FROM (SELECT *, avg(atr_14) OVER w AS m, stddev_pop(atr_14) OVER w AS s, count(atr_14) OVER w AS n FROM atr
      WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)))"""


@R.add(f"{_ATR}, {_REGIME} SELECT symbol, ts, regime FROM regime")
def volatility_regime(spark: SparkSession, sf: str) -> DataFrame:
    return trading.volatility_regime(_with_atr(spark, sf)).select("symbol", "ts", "regime")


@R.add(f"{q.with_(q.BARS, q.PREDICTIONS)} SELECT symbol, ts, signal, {q.r('confidence', 6)} AS confidence FROM predictions WHERE confidence >= 0.55")
def confidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    p = inputs.predictions(spark, sf).where(F.col("confidence") >= gates.MIN_CONFIDENCE)
    return rounded(p.select("symbol", "ts", "signal", "confidence"), ["confidence"], 6)


# Scores ------------------------------------------------------------------------------

_SCORE_COLS = ["close", "ema_50", "ema_200", "macd", "macd_signal", "atr_zscore", "stoch_k", "rsi"]


def scored(spark: SparkSession, sf: str, rsi: bool = True) -> DataFrame:
    """Predictions with the features of their bar and all quality parts."""
    feats = ind.base_features(inputs.bars(spark, sf))
    p = inputs.predictions(spark, sf).drop("close")
    df = p.join(feats.select("symbol", "ts", *_SCORE_COLS), ["symbol", "ts"])
    row = {n: F.col(n) for n in _SCORE_COLS}
    parts = scoring.quality_parts(
        F.col("confidence"), F.col("predicted_class"), row, F.col("rsi") if rsi else None
    )
    df = df.withColumns({f"quality_{n}": x for n, x in parts.items()})
    total = sum((F.col(f"quality_{n}") for n in parts), F.lit(0.0))
    return df.withColumn("quality_score", total)


_SCORED = f"""sj AS MATERIALIZED (SELECT p.* EXCLUDE (close), {', '.join(f'f.{n}' for n in _SCORE_COLS)}
  FROM predictions p JOIN feats f ON p.symbol = f.symbol AND p.ts = f.ts),
scored AS MATERIALIZED (SELECT *, 40 * (CASE WHEN confidence > 0.85 THEN 1 WHEN confidence > 0.75 THEN 0.8 WHEN confidence > 0.65 THEN 0.6
      WHEN confidence > 0.55 THEN 0.4 ELSE 0.2 END)::DOUBLE AS quality_confidence,
    25 * least(1.0, (CASE WHEN predicted_class = 0 AND close > ema_50 AND ema_50 > ema_200 THEN 0.5
        WHEN predicted_class = 1 AND close < ema_50 AND ema_50 < ema_200 THEN 0.5
        WHEN predicted_class = 0 AND close > ema_50 THEN 0.3 WHEN predicted_class = 1 AND close < ema_50 THEN 0.3 ELSE 0 END)::DOUBLE
      + (CASE WHEN (predicted_class = 0 AND macd > macd_signal) OR (predicted_class = 1 AND macd < macd_signal) THEN 0.3 ELSE 0 END)::DOUBLE) AS quality_trend,
    20 * (CASE WHEN atr_zscore < 0.5 THEN 1 WHEN atr_zscore < 1 THEN 0.8 WHEN atr_zscore < 1.5 THEN 0.6 WHEN atr_zscore < 2 THEN 0.3 ELSE 0.1 END)::DOUBLE AS quality_volatility,
    15 * least(1.0, (CASE WHEN predicted_class IN (0, 1) AND rsi > 30 AND rsi < 70 THEN 0.5 WHEN predicted_class = 0 AND rsi < 30 THEN 0.7
        WHEN predicted_class = 1 AND rsi > 70 THEN 0.7 ELSE 0 END)::DOUBLE
      + (CASE WHEN (predicted_class = 0 AND stoch_k < 80) OR (predicted_class = 1 AND stoch_k > 20) THEN 0.3 ELSE 0 END)::DOUBLE) AS quality_momentum,
    quality_confidence + quality_trend + quality_volatility + quality_momentum AS quality_score FROM sj)"""
SCORED = q.with_(q.FEATURES, q.PREDICTIONS, _SCORED)
_PARTS = [f"quality_{n}" for n in ("confidence", "trend", "volatility", "momentum", "score")]
_SIZE = "(CASE WHEN qs >= 80 THEN 1.0 WHEN qs >= 65 THEN 0.75 WHEN qs >= 50 THEN 0.5 WHEN qs >= 40 THEN 0.25 ELSE 0.0 END)::DOUBLE"


@R.add(f"{SCORED} SELECT symbol, ts, predicted_class, {q.rounded(_PARTS, 6)} FROM scored")
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    out = scored(spark, sf).select("symbol", "ts", "predicted_class", *_PARTS)
    return rounded(out, _PARTS, 6)


@R.add(
    f"""{SCORED} SELECT symbol, ts, {_SIZE} AS position_size_pct, qs >= 40 AS should_trade,
      CASE WHEN qs < 40 THEN 'HOLD' WHEN pred_buy_prob > 0.7 THEN 'BUY' WHEN pred_sell_prob > 0.7 THEN 'SELL' ELSE 'HOLD' END AS rule_signal
    FROM (SELECT *, round(quality_score, 6) AS qs FROM scored)"""
)
def trade_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Size tier, trade decision and signal rule on the rounded score."""
    qs = F.round("quality_score", 6)
    return scored(spark, sf).select(
        "symbol",
        "ts",
        scoring.position_size(qs).alias("position_size_pct"),
        scoring.should_trade(qs).alias("should_trade"),
        scoring.signal_rule(qs, F.col("pred_buy_prob"), F.col("pred_sell_prob")).alias("rule_signal"),
    )


@R.add(
    f"""{SCORED} SELECT symbol, ts, signal AS raw_prediction, CASE WHEN qs < 40 THEN 'HOLD' ELSE signal END AS prediction,
      qs < 40 AS quality_filtered, {q.r('confidence')} AS confidence, {q.r('pred_buy_prob')} AS buy, {q.r('pred_sell_prob')} AS sell,
      {q.r('pred_hold_prob')} AS hold, {q.r('qs', 2)} AS quality_score, {_SIZE} AS position_size_pct
    FROM (SELECT *, round(quality_score, 6) AS qs FROM scored)"""
)
def scored_signal_override(spark: SparkSession, sf: str) -> DataFrame:
    df = scored(spark, sf).withColumn("qs", F.round("quality_score", 6))
    low = F.col("qs") < scoring.MIN_QUALITY
    return df.select(
        "symbol",
        "ts",
        F.col("signal").alias("raw_prediction"),
        F.when(low, "HOLD").otherwise(F.col("signal")).alias("prediction"),
        low.alias("quality_filtered"),
        F.round("confidence", 4).alias("confidence"),
        *[F.round(f"pred_{n}_prob", 4).alias(n) for n in ("buy", "sell", "hold")],
        F.round("qs", 2).alias("quality_score"),
        scoring.position_size(F.col("qs")).alias("position_size_pct"),
    )


@R.add(
    f"""{SCORED} SELECT symbol, count(*) AS predictions, count(*) FILTER (WHERE signal <> 'HOLD') AS signals,
      count(*) FILTER (WHERE signal <> 'HOLD' AND round(quality_score, 6) >= 60) AS high_quality,
      {q.r("coalesce(count(*) FILTER (WHERE signal <> 'HOLD' AND round(quality_score, 6) >= 60) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE signal <> 'HOLD'), 0), 0)")} AS high_quality_percent
    FROM scored GROUP BY symbol"""
)
def signal_quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).withColumn("quality_score", F.round("quality_score", 6))
    return rounded(metrics.quality_summary(s), ["high_quality_percent"])


@R.add(
    f"""{q.with_(q.BARS, q.PREDICTIONS)} SELECT symbol, ts, predicted_class, {q.r('pred_buy_prob', 6)} AS p_buy FROM predictions"""
)
def argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    p = inputs.predictions(spark, sf)
    cls = scoring.argmax_class(*[F.col(f"pred_{n}_prob") for n in ("buy", "sell", "hold")])
    out = p.select("symbol", "ts", cls.alias("predicted_class"), F.col("pred_buy_prob").alias("p_buy"))
    return rounded(out, ["p_buy"], 6)


@R.add(
    f"""{q.with_(q.BARS)} SELECT symbol, ts, (close - open) * (CASE WHEN contains(symbol, 'JPY') THEN 100.0 ELSE 10000.0 END) AS pips FROM bars"""
)
def pip_conversion(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.bars(spark, sf)
    return b.select(
        "symbol", "ts", scoring.pips(F.col("close") - F.col("open"), F.col("symbol")).alias("pips")
    )


# Portfolio ---------------------------------------------------------------------------

_VOTES = f"""votes AS MATERIALIZED (SELECT ts, count(*) FILTER (WHERE ok AND signal = 'BUY') AS buy_votes,
    count(*) FILTER (WHERE ok AND signal = 'SELL') AS sell_votes, count(*) FILTER (WHERE ok AND signal = 'HOLD') AS hold_votes,
    avg(confidence) FILTER (WHERE ok AND signal = 'BUY') AS bc, avg(confidence) FILTER (WHERE ok AND signal = 'SELL') AS sc,
    {', '.join(f'sum(pred_{n}_prob * weight) / sum(weight) AS weighted_{n}_prob' for n in ('buy', 'sell', 'hold'))},
    coalesce(string_agg(symbol || ':' || signal, ', ' ORDER BY symbol || ':' || signal) FILTER (WHERE ok), '') AS active_pairs,
    count(*) FILTER (WHERE ok) AS num_active_pairs,
    CASE WHEN buy_votes >= 3 THEN 1 WHEN sell_votes >= 3 THEN -1 ELSE 0 END AS portfolio_signal,
    CASE WHEN buy_votes >= 3 THEN bc WHEN sell_votes >= 3 THEN sc ELSE 0.0 END AS portfolio_confidence
  FROM (SELECT *, confidence >= 0.6 AS ok, CASE symbol WHEN 'EUR_USD' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM predictions) GROUP BY ts)"""
_VOTE_REAL = ["weighted_buy_prob", "weighted_sell_prob", "weighted_hold_prob", "portfolio_confidence"]
_VOTE_REST = ["ts", "buy_votes", "sell_votes", "hold_votes", "active_pairs", "num_active_pairs", "portfolio_signal"]


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    weights = spark.createDataFrame([("EUR_USD", 2.0)], "symbol string, weight double")
    return portfolio.vote(inputs.predictions(spark, sf), weights)


@R.add(f"{q.with_(q.BARS, q.PREDICTIONS, _VOTES)} SELECT {', '.join(_VOTE_REST)}, {q.rounded(_VOTE_REAL, 6)} FROM votes")
def portfolio_vote(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_votes(spark, sf), _VOTE_REAL, 6)


_PCT = lambda v: f"{q.r(f'count(*) FILTER (WHERE portfolio_signal = {v}) * 100.0::DOUBLE / count(*)')}"


@R.add(
    f"""{q.with_(q.BARS, q.PREDICTIONS, _VOTES)} SELECT count(*) AS total_signals,
      count(*) FILTER (WHERE portfolio_signal = 1) AS buy_signals, {_PCT(1)} AS buy_percent,
      count(*) FILTER (WHERE portfolio_signal = -1) AS sell_signals, {_PCT(-1)} AS sell_percent,
      count(*) FILTER (WHERE portfolio_signal = 0) AS hold_signals, {_PCT(0)} AS hold_percent,
      {q.r('coalesce(avg(portfolio_confidence) FILTER (WHERE portfolio_signal <> 0), 0.0)', 6)} AS avg_confidence,
      {q.r('avg(num_active_pairs)', 6)} AS avg_active_pairs FROM votes"""
)
def portfolio_statistics(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(portfolio.vote_statistics(_votes(spark, sf)), ["avg_confidence", "avg_active_pairs"], 6)
    return rounded(out, ["buy_percent", "sell_percent", "hold_percent"])


_COMMON = f"""common AS (SELECT * FROM predictions WHERE ts IN
  (SELECT ts FROM predictions GROUP BY ts HAVING count(DISTINCT symbol) = {len(PAIRS)}))"""


@R.add(f"{q.with_(q.BARS, q.PREDICTIONS, _COMMON)} SELECT symbol, ts, signal FROM common")
def common_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    p = inputs.predictions(spark, sf).select("symbol", "ts", "signal")
    return portfolio.common_times(p, len(PAIRS))


@R.add(
    f"""{q.with_(q.BARS, q.PREDICTIONS, _COMMON)}, n AS (SELECT ts, symbol, list_position({q.PAIR_LIST}, symbol) AS i,
      CASE WHEN symbol = '{PAIRS[-1]}' THEN 0.0 WHEN signal = 'BUY' THEN 1.0 WHEN signal = 'SELL' THEN -1.0 ELSE 0.0 END::DOUBLE AS v FROM common)
    SELECT x.symbol AS a, y.symbol AS b, CASE WHEN min(x.v) < max(x.v) AND min(y.v) < max(y.v) THEN {q.r('corr(x.v, y.v)', 6)} END AS r FROM n x JOIN n y ON x.ts = y.ts AND x.i < y.i GROUP BY ALL"""
)
def signal_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """One symbol never signals: its correlations are null."""
    p = inputs.predictions(spark, sf)
    p = p.withColumn("signal", F.when(F.col("symbol") == PAIRS[-1], "HOLD").otherwise(F.col("signal")))
    return rounded(portfolio.signal_correlation(p, PAIRS), ["r"], 6)


# Deals and positions -----------------------------------------------------------------

_ORDER = "close_ts, ticket"
_STREAKS = f"""streaks AS MATERIALIZED (SELECT ticket, symbol, side, close_ts, profit, (sum((profit < 0)::INT) OVER
      (PARTITION BY symbol, side, island ORDER BY {_ORDER}))::BIGINT AS loss_count
  FROM (SELECT *, sum((profit > 0)::INT) OVER (PARTITION BY symbol, side ORDER BY {_ORDER}) AS island FROM positions))"""


def _streaks(spark: SparkSession, sf: str) -> DataFrame:
    deals = inputs.positions(spark, sf).drop("open_ts")
    return trading.loss_streaks(
        deals, ["symbol", "side"], ["close_ts", "ticket"], F.to_date("close_ts")
    )


@R.add(f"{q.with_(q.POSITIONS, _STREAKS)} SELECT * FROM streaks")
def loss_counter(spark: SparkSession, sf: str) -> DataFrame:
    return _streaks(spark, sf)


@R.add(
    f"""{q.with_(q.BARS, q.PREDICTIONS, q.POSITIONS, _STREAKS)},
    s AS (SELECT symbol, ts, signal AS side FROM predictions WHERE signal <> 'HOLD'),
    lastone AS (SELECT * FROM streaks QUALIFY row_number() OVER (PARTITION BY symbol, side, close_ts ORDER BY ticket DESC) = 1)
    SELECT s.* FROM s ASOF LEFT JOIN lastone d ON s.symbol = d.symbol AND s.side = d.side AND s.ts >= d.close_ts
    WHERE coalesce(d.loss_count, 0) = 0"""
)
def loss_block(spark: SparkSession, sf: str) -> DataFrame:
    p = inputs.predictions(spark, sf).where("signal <> 'HOLD'")
    signals = p.select("symbol", "ts", F.col("signal").alias("side"))
    # Of deals closed at the same time the last ticket decides.
    last = _streaks(spark, sf).groupBy("symbol", "side", "close_ts").agg(
        F.max_by("loss_count", "ticket").alias("loss_count")
    )
    return trading.block_after_loss(signals, last)


@R.add(
    f"""{q.with_(q.POSITIONS)}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {_ORDER}) AS i FROM positions),
    walk AS (SELECT ticket, symbol, i, CASE WHEN profit < 0 THEN 1 ELSE 0 END AS depth FROM o WHERE i = 1
      UNION ALL SELECT o.ticket, o.symbol, o.i, CASE WHEN o.profit < 0 THEN w.depth + 1 ELSE greatest(0, w.depth - 1) END
      FROM walk w JOIN o ON o.symbol = w.symbol AND o.i = w.i + 1)
    SELECT ticket, symbol, depth::BIGINT AS depth FROM walk"""
)
def recovery_depth(spark: SparkSession, sf: str) -> DataFrame:
    out = trading.recovery_depth(
        inputs.positions(spark, sf), ["symbol"], ["close_ts", "ticket"], F.to_date("close_ts")
    )
    return out.select("ticket", "symbol", "depth")


_TICK_SIGNALS = """sig AS (SELECT event_id, symbol, ts, CASE WHEN k % 3 = 0 THEN 'BUY' WHEN k % 3 = 1 THEN 'SELL' ELSE 'HOLD' END AS side,
  price, k FROM ticks)"""


def tick_signals(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("k") % 3 == 0, "BUY").when(F.col("k") % 3 == 1, "SELL").otherwise("HOLD")
    return inputs.ticks(spark, sf).select("event_id", "symbol", "ts", side.alias("side"), "price", "k")


@R.add(
    f"""WITH {q.TICKS}, {_TICK_SIGNALS} SELECT event_id, symbol, ts, side, ts::DATE AS date FROM sig WHERE side <> 'HOLD'
    AND k >= 20 QUALIFY row_number() OVER (PARTITION BY symbol, ts::DATE, side ORDER BY ts, event_id) = 1"""
)
def daily_trade_limit(spark: SparkSession, sf: str) -> DataFrame:
    s = tick_signals(spark, sf).where("side <> 'HOLD' AND k >= 20").drop("price", "k")
    return trading.daily_first(s, ["ts", "event_id"])


@R.add(
    f"""{q.with_(q.BARS, q.PREDICTIONS, q.POSITIONS)},
    s AS (SELECT symbol, ts, confidence, CASE signal WHEN 'BUY' THEN 'SELL' ELSE 'BUY' END AS closes FROM predictions
      WHERE signal <> 'HOLD' AND confidence >= 0.6)
    SELECT p.ticket, p.symbol, p.side, p.open_ts, s.ts AS exit_ts, {q.r('s.confidence', 6)} AS exit_confidence
    FROM positions p ASOF LEFT JOIN s ON p.symbol = s.symbol AND p.side = s.closes AND p.open_ts < s.ts"""
)
def exit_matching(spark: SparkSession, sf: str) -> DataFrame:
    signals = inputs.predictions(spark, sf).select(
        "symbol", "ts", "confidence", F.col("signal").alias("side")
    )
    pos = inputs.positions(spark, sf).select("ticket", "symbol", "side", "open_ts")
    return rounded(trading.first_exit(pos, signals), ["exit_confidence"], 6)


@R.add(
    f"""{q.with_(q.BARS, q.PREDICTIONS, q.POSITIONS)}, s AS (SELECT symbol, ts, signal FROM predictions WHERE signal <> 'HOLD'),
    o AS (SELECT symbol, t, sum(sum(d)) OVER (PARTITION BY symbol ORDER BY t) AS n FROM (
      SELECT symbol, open_ts AS t, 1 AS d FROM positions UNION ALL SELECT symbol, close_ts, -1 FROM positions) GROUP BY symbol, t)
    SELECT s.*, coalesce(o.n, 0)::BIGINT AS open_positions, coalesce(o.n, 0) < 2 AS may_open
    FROM s ASOF LEFT JOIN o ON s.symbol = o.symbol AND s.ts >= o.t"""
)
def concurrent_positions(spark: SparkSession, sf: str) -> DataFrame:
    s = inputs.predictions(spark, sf).where("signal <> 'HOLD'").select("symbol", "ts", "signal")
    out = trading.open_position_count(s, inputs.positions(spark, sf))
    return out.withColumn("may_open", F.col("open_positions") < gates.MAX_OPEN_POSITIONS)


# Risk --------------------------------------------------------------------------------

_ORDERS = f"""trade AS MATERIALIZED (SELECT g.symbol, g.ts, g.close, g.atr_14, g.regime, p.signal AS side, p.confidence,
    (list_position({q.PAIR_LIST}, g.symbol) + day(g.ts)) % 5 AS losses, x.* EXCLUDE (symbol)
  FROM regime g JOIN predictions p ON g.symbol = p.symbol AND g.ts = p.ts JOIN specs x ON g.symbol = x.symbol
  WHERE p.signal <> 'HOLD')"""
_TRADE_SQL = f"{_ATR}, {_REGIME}, {q.PREDICTIONS}, {q.SPECS}, {_ORDERS}"
_STOPS = """stops AS MATERIALIZED (SELECT *, greatest(coalesce(atr_14 * (CASE regime WHEN 'LOW' THEN 2.0 WHEN 'HIGH' THEN 3.5 ELSE 2.5 END)::DOUBLE / point, 200.0), stops_level) AS atr_stop,
    greatest(200.0::DOUBLE, stops_level) AS pip_stop, greatest(close * 0.5 / 100.0 / point, stops_level) AS percent_stop FROM trade)"""
_RISK = """risks AS (SELECT *, least(5.0::DOUBLE, (CASE WHEN confidence >= 0.8 THEN 2.0 WHEN confidence >= 0.7 THEN 1.5 WHEN confidence >= 0.55 THEN 1.0
      ELSE 0.0 END)::DOUBLE * (CASE WHEN losses > 0 THEN pow(1.5::DOUBLE, least(losses, 3)) ELSE 1.0 END)) AS risk_percent FROM stops)"""


def orders_to_size(spark: SparkSession, sf: str) -> DataFrame:
    """Signals with regime, contract specs and the three stop distances."""
    base = trading.volatility_regime(_with_atr(spark, sf))
    p = inputs.predictions(spark, sf).where("signal <> 'HOLD'")
    p = p.select("symbol", "ts", F.col("signal").alias("side"), "confidence")
    losses = ((inputs.symbol_number() + F.dayofmonth("ts")) % 5).alias("losses")
    df = base.join(p, ["symbol", "ts"]).join(inputs.symbol_specs(spark), "symbol")
    c = F.col
    return df.select("*", losses).withColumns(
        {
            "atr_stop": risk.stop_points("atr", c("point"), c("stops_level"), c("atr_14"), c("regime")),
            "pip_stop": risk.stop_points("pips", c("point"), c("stops_level")),
            "percent_stop": risk.stop_points("percent", c("point"), c("stops_level"), price=c("close")),
        }
    )


_STOP_COLS = ["atr_stop", "pip_stop", "percent_stop"]


@R.add(f"{_TRADE_SQL}, {_STOPS} SELECT symbol, ts, regime, pip_stop, percent_stop, {q.r('atr_stop', 1)} AS atr_stop FROM stops")
def stop_distance(spark: SparkSession, sf: str) -> DataFrame:
    out = orders_to_size(spark, sf).select("symbol", "ts", "regime", *_STOP_COLS)
    return rounded(out, ["atr_stop"], 1)


@R.add(f"{_TRADE_SQL}, {_STOPS}, {_RISK} SELECT symbol, ts, losses, {q.r('risk_percent', 6)} AS risk_percent FROM risks")
def risk_percent(spark: SparkSession, sf: str) -> DataFrame:
    df = orders_to_size(spark, sf)
    r = risk.risk_percent(F.col("confidence"), F.col("losses"))
    out = df.select("symbol", "ts", F.col("losses").cast("bigint").alias("losses"), r.alias("risk_percent"))
    return rounded(out, ["risk_percent"], 6)


_LOTS = """lots AS (SELECT *, CASE WHEN balance < 10 THEN 0.01 ELSE raw2 END AS lot FROM (
  SELECT *, CASE WHEN raw1 * margin_initial > balance * 0.5 THEN greatest(floor(balance * 0.5 / margin_initial / 0.01::DOUBLE) * 0.01::DOUBLE, 0.01) ELSE raw1 END AS raw2 FROM (
  SELECT *, greatest(0.01::DOUBLE, least(50.0::DOUBLE, floor(balance * risk_percent / 100.0 / (pip_stop * tick_value) / 0.01::DOUBLE) * 0.01::DOUBLE)) AS raw1
  FROM (SELECT *, (5 + 997 * losses * losses + day(ts) * 10000)::DOUBLE * (CASE WHEN day(ts) = 1 THEN 0.0005 ELSE 1 END)::DOUBLE AS balance FROM risks))))"""


@R.add(
    f"""{_TRADE_SQL}, {_STOPS}, {_RISK}, {_LOTS} SELECT symbol, ts, balance,
      {q.r('greatest(0.01::DOUBLE, least(50.0::DOUBLE, round(lot / 0.01::DOUBLE) * 0.01::DOUBLE))', 2)} AS lots FROM lots"""
)
def lot_size(spark: SparkSession, sf: str) -> DataFrame:
    df = orders_to_size(spark, sf)
    c = F.col
    day = F.dayofmonth("ts")
    balance = (5 + 997 * c("losses") * c("losses") + day * 10000).cast("double") * F.when(
        day == 1, 0.0005
    ).otherwise(1.0)
    df = df.withColumn("balance", balance).withColumn(
        "risk", risk.risk_percent(c("confidence"), c("losses"))
    )
    spec = {
        n: c(n)
        for n in ("point", "tick_size", "tick_value", "volume_min", "volume_max", "volume_step", "margin_initial")
    }
    lots = risk.lot_size(c("balance"), c("risk"), c("pip_stop"), spec, max_margin_percent=50)
    return df.select("symbol", "ts", "balance", F.round(lots, 2).alias("lots"))


_DIGITS = lambda x: q.r(f"floor(({x}) * power(10.0::DOUBLE, digits) + 0.5) / power(10.0::DOUBLE, digits)", 6)


@R.add(
    f"""{_TRADE_SQL}, {_STOPS} SELECT symbol, ts, side, {_DIGITS('entry')} AS entry,
      {_DIGITS('entry - sgn * (atr_stop * point)')} AS stop_loss, {_DIGITS('entry + sgn * (atr_stop * point) * 2.0::DOUBLE')} AS take_profit
    FROM (SELECT *, CASE side WHEN 'BUY' THEN close + spread ELSE close END AS entry, CASE side WHEN 'BUY' THEN 1 ELSE -1 END AS sgn FROM stops)"""
)
def stop_and_target_levels(spark: SparkSession, sf: str) -> DataFrame:
    df = orders_to_size(spark, sf)
    c = F.col
    entry, sl, tp = risk.levels(
        c("side"), c("close") + c("spread"), c("close"), c("atr_stop"), c("point"), c("digits")
    )
    out = df.select(
        "symbol", "ts", "side", entry.alias("entry"), sl.alias("stop_loss"), tp.alias("take_profit")
    )
    return rounded(out, ["entry", "stop_loss", "take_profit"], 6)


# Performance of closed deals -----------------------------------------------------------

_CURVE = f"""summed AS (SELECT *, sum(profit) OVER (PARTITION BY symbol ORDER BY {_ORDER}) AS equity FROM positions),
curve AS (SELECT *, greatest(0.0, max(equity) OVER (PARTITION BY symbol ORDER BY {_ORDER})) AS peak FROM summed)"""


@R.add(f"{q.with_(q.POSITIONS, _CURVE)} SELECT ticket, symbol, equity, peak::DOUBLE AS peak, (peak - equity)::DOUBLE AS drawdown FROM curve")
def equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Running profit, its peak and the fall from it, for each closed deal."""
    curve = performance.equity_curve(inputs.positions(spark, sf), ["symbol"], order=["close_ts", "ticket"])
    return curve.select("ticket", "symbol", "equity", "peak", "drawdown")


@R.add(
    f"""{q.with_(q.POSITIONS, _CURVE)}, days AS (SELECT symbol, close_ts::DATE AS day, sum(profit) AS p FROM positions GROUP BY ALL),
    ratios AS (SELECT symbol, avg(p) / nullif(stddev_samp(p), 0) * sqrt(252) AS sharpe,
      sum(p) * 365.25 / nullif(datediff('day', min(day), max(day)), 0) AS yearly FROM days GROUP BY symbol),
    totals AS (SELECT symbol, count(*) AS deals, count(*) FILTER (WHERE profit > 0) AS won, count(*) FILTER (WHERE profit < 0) AS lost, sum(profit) AS profit,
      sum(greatest(profit, 0)) / nullif(sum(greatest(-profit, 0)), 0) AS profit_factor, max(peak - equity)::DOUBLE AS max_drawdown FROM curve GROUP BY symbol)
    SELECT symbol, deals, won, lost, profit, {q.r('profit_factor', 6)} AS profit_factor, max_drawdown, {q.r('sharpe', 6)} AS sharpe,
      {q.r('yearly / nullif(max_drawdown, 0)', 6)} AS calmar FROM totals JOIN ratios USING (symbol)"""
)
def trade_performance(spark: SparkSession, sf: str) -> DataFrame:
    """Profit factor, greatest drawdown, Sharpe and Calmar ratio of each symbol."""
    out = performance.trade_metrics(inputs.positions(spark, sf), ["symbol"], order=["close_ts", "ticket"])
    return rounded(out, ["profit_factor", "sharpe", "calmar"], 6)
