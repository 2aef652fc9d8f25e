"""Queries on bars: building, quality, cleaning, indicators, higher timeframes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewake.operators import indicators as ind
from candlewake.operators import carry, labels, quality, scan, stats, timeline, trading
from candlewake.operators.blocks import with_row_index
from candlewake.operators.resample import first_per, resample
from candlewake.plans import features as jobs
from candlewake.plans import inputs
from candlewake.plans import sqltext as q
from candlewake.plans.registry import Registry, rounded
from candlewake.session import stage

R = Registry()
PRICES = ["open", "high", "low", "close"]


@R.add(f"{q.with_(q.BARS)} SELECT * FROM bars")
def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.bars(spark, sf)


@R.add(
    f"""{q.with_(q.BARS, q.resampled('b3', 3), q.resampled('b7', 7))}
    SELECT '3D' AS timeframe, * FROM b3 UNION ALL SELECT '7D', * FROM b7"""
)
def bars_higher_timeframes(spark: SparkSession, sf: str) -> DataFrame:
    daily = inputs.bars(spark, sf)
    parts = [
        resample(daily, f"{n} days").withColumn("timeframe", F.lit(f"{n}D")) for n in (3, 7)
    ]
    return parts[0].unionByName(parts[1])


@R.add(f"{q.with_(q.HOURS)} SELECT * FROM hours")
def bars_hourly_from_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.hours(spark, sf)


@R.add(
    f"""{q.with_(q.TRADES)}, rows_ AS (
      SELECT symbol, ts, price AS open, price * (CASE WHEN l_linenumber = 7 THEN 0.99 ELSE 1 END) AS high,
             price AS low, CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE price END AS close,
             (size::BIGINT - 1) AS volume FROM trades),
    st AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS step FROM rows_)
    SELECT symbol, count(*) AS total_rows,
      (count(*) * 5 - count(open) - count(high) - count(low) - count(close) - count(volume))::BIGINT AS missing_values,
      count(*) - count(DISTINCT ts) AS duplicate_timestamps,
      count(*) FILTER (WHERE high < low) AS inverted_bars, count(*) FILTER (WHERE volume = 0) AS zero_volume,
      count(*) FILTER (WHERE step > 1.5 * 86400 * 1000000) AS gaps,
      {q.r('1 - (missing_values + duplicate_timestamps + inverted_bars)::DOUBLE / greatest(count(*), 1)', 6)} AS quality_score,
      1 - (missing_values + duplicate_timestamps + inverted_bars)::DOUBLE / greatest(count(*), 1) < 0.95 AS low_quality
    FROM st GROUP BY symbol"""
)
def bar_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """Trades taken as bars: repeated times, inverted bars, missing closes."""
    t = inputs.trades(spark, sf)
    p = F.col("price")
    rows = t.select(
        "symbol",
        "ts",
        p.alias("open"),
        (p * F.when(F.col("l_linenumber") == 7, 0.99).otherwise(1)).alias("high"),
        p.alias("low"),
        F.when(F.col("l_orderkey") % 50 != 0, p).alias("close"),
        (F.col("size").cast("bigint") - 1).alias("volume"),
    )
    return rounded(quality.quality_report(rows, 86400), ["quality_score"], 6)


@R.add(
    f"""{q.with_(q.HOURS)}, st AS (
      SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts)) / 1e6 AS step,
        CASE WHEN volume = 3 THEN 1 ELSE 0 END AS miss FROM hours),
    usual AS (SELECT symbol, arg_min(step, (-n, step)) AS u FROM (
        SELECT symbol, step, count(*) AS n FROM st WHERE step IS NOT NULL GROUP BY ALL) GROUP BY symbol),
    agg AS (SELECT symbol, count(*) AS total_rows, sum(miss)::DOUBLE / (count(*) * 5) AS missing_pct,
        count(*) FILTER (WHERE step > 2 * u)::DOUBLE / count(*) AS gap_pct
        FROM st JOIN usual USING (symbol) GROUP BY symbol)
    SELECT symbol, total_rows, {q.r('missing_pct', 6)} AS missing_pct, {q.r('gap_pct', 6)} AS gap_pct,
      {q.r('1 - (missing_pct + gap_pct)', 6)} AS accuracy, 1 - (missing_pct + gap_pct) >= 0.98 AS valid FROM agg"""
)
def bar_accuracy_report(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.hours(spark, sf)
    b = b.withColumn("close", F.when(F.col("volume") != 3, F.col("close")))
    return rounded(quality.accuracy_report(b), ["missing_pct", "gap_pct", "accuracy"], 6)


_RAW_FIELDS = """raw AS (SELECT event_id, event_type AS symbol,
  CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE (1 + value / 100)::VARCHAR END AS open,
  (event_id % 23)::VARCHAR AS high, CASE WHEN event_id % 29 = 0 THEN NULL ELSE '1.5' END AS low,
  '2.25' AS close, CASE WHEN event_id % 31 = 0 THEN 'x' ELSE '10' END AS volume FROM events)"""


def _raw_fields(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return inputs.ticks(spark, sf).select(
        "event_id",
        "symbol",
        F.when(i % 17 == 0, "n/a").otherwise(F.col("price").cast("string")).alias("open"),
        (i % 23).cast("string").alias("high"),
        F.when(i % 29 != 0, "1.5").alias("low"),
        F.lit("2.25").alias("close"),
        F.when(i % 31 == 0, "x").otherwise("10").alias("volume"),
    )


_REQUIRED = {"open": "double", "high": "double", "low": "double", "close": "double", "volume": "bigint"}


@R.add(
    f"""WITH {_RAW_FIELDS}, c AS (SELECT event_id, symbol, TRY_CAST(open AS DOUBLE) AS open,
      TRY_CAST(high AS DOUBLE) AS high, TRY_CAST(low AS DOUBLE) AS low, TRY_CAST(close AS DOUBLE) AS close,
      TRY_CAST(volume AS BIGINT) AS volume FROM raw)
    SELECT * FROM c WHERE open IS NOT NULL AND low IS NOT NULL AND volume IS NOT NULL"""
)
def required_fields_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return quality.split_required(_raw_fields(spark, sf), _REQUIRED)[0]


@R.add(
    f"""WITH {_RAW_FIELDS} SELECT event_id, symbol, high, close, concat_ws(',',
      CASE WHEN TRY_CAST(open AS DOUBLE) IS NULL THEN 'open' END, CASE WHEN low IS NULL THEN 'low' END,
      CASE WHEN TRY_CAST(volume AS BIGINT) IS NULL THEN 'volume' END) AS missing_fields FROM raw
    WHERE TRY_CAST(open AS DOUBLE) IS NULL OR low IS NULL OR TRY_CAST(volume AS BIGINT) IS NULL"""
)
def required_fields_rejected(spark: SparkSession, sf: str) -> DataFrame:
    bad = quality.split_required(_raw_fields(spark, sf), _REQUIRED)[1]
    return bad.select("event_id", "symbol", "high", "close", "missing_fields")


@R.add(
    f"""{q.with_(q.TICKS)} SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts,
      first(price ORDER BY event_id) AS price, min(event_id) AS event_id
    FROM ticks GROUP BY symbol, time_bucket(INTERVAL 5 MINUTE, ts)"""
)
def duplicate_times_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    t = inputs.ticks(spark, sf).select(
        "symbol", F.window("ts", "5 minutes").start.alias("ts"), "price", "event_id"
    )
    return first_per(t, ["symbol", "ts"], ["event_id"])


_GRID = f"""{q.with_(q.HOURS)}, span AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM hours GROUP BY symbol),
grid AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span)"""


@R.add(
    f"""{_GRID} SELECT g.symbol, g.ts, h.ts IS NOT NULL AS present
    FROM grid g LEFT JOIN hours h ON g.symbol = h.symbol AND g.ts = h.ts"""
)
def regular_grid(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.hours(spark, sf)
    have = b.select("symbol", "ts", F.lit(True).alias("present"))
    return timeline.with_grid(b, 3600).join(have, ["symbol", "ts"], "left").withColumn(
        "present", F.coalesce("present", F.lit(False))
    )


_HOLES = f"""{q.with_(q.HOURS)}, holes AS (SELECT symbol, CASE WHEN hour(ts) % 7 = 3 THEN ts + INTERVAL 30 MINUTE ELSE ts END AS ts,
  CASE WHEN hour(ts) % 5 <> 1 THEN close END AS close, CASE WHEN hour(ts) % 4 <> 2 THEN volume END AS volume FROM hours),
span AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM holes GROUP BY symbol),
grid AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span UNION SELECT symbol, ts FROM holes),
line AS (SELECT g.symbol, g.ts, close, volume, epoch_us(g.ts) AS t FROM grid g LEFT JOIN holes h ON g.symbol = h.symbol AND g.ts = h.ts)"""


def _holes(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars of which some lie on the half hour and some miss the close or the volume."""
    hour = F.hour("ts")
    return inputs.hours(spark, sf).select(
        "symbol",
        F.when(hour % 7 == 3, F.col("ts") + F.expr("INTERVAL 30 MINUTES")).otherwise(F.col("ts")).alias("ts"),
        F.when(hour % 5 != 1, F.col("close")).alias("close"),
        F.when(hour % 4 != 2, F.col("volume")).alias("volume"),
    )


@R.add(
    f"""{_HOLES} SELECT symbol, ts, last_value(close IGNORE NULLS) OVER w AS close, last_value(volume IGNORE NULLS) OVER w AS volume
    FROM line WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def gap_fill_forward(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.fill_gaps(_holes(spark, sf), 3600, ["close", "volume"])


@R.add(
    f"""{_HOLES} SELECT symbol, ts, first_value(close IGNORE NULLS) OVER w AS close, first_value(volume IGNORE NULLS) OVER w AS volume
    FROM line WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
)
def gap_fill_backward(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.fill_gaps(_holes(spark, sf), 3600, ["close", "volume"], "bfill")


@R.add(
    f"""{_HOLES}, ends AS (SELECT symbol, ts, t, last_value(close IGNORE NULLS) OVER a AS ca, last_value(CASE WHEN close IS NOT NULL THEN t END IGNORE NULLS) OVER a AS ta,
      first_value(close IGNORE NULLS) OVER z AS cz, first_value(CASE WHEN close IS NOT NULL THEN t END IGNORE NULLS) OVER z AS tz
    FROM line WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      z AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT symbol, ts, {q.r('CASE WHEN ta = tz OR tz IS NULL THEN ca ELSE ca + (cz - ca) * ((t - ta) / (tz - ta)) END', 10)} AS close FROM ends"""
)
def gap_fill_by_time(spark: SparkSession, sf: str) -> DataFrame:
    out = timeline.fill_gaps(_holes(spark, sf), 3600, ["close"], "time")
    return rounded(out, ["close"], 10)


# Indicators --------------------------------------------------------------------------


def _group(*names: str):
    """A query over some columns of the feature job, with its SQL twin."""
    ints = {"cross", "bullish", "bearish", "overbought", "oversold", "squeeze_on", "strong"}
    whole = [n for n in names if any(i in n for i in ints) and n not in ind.CROSS_FEATURES]
    whole += [n for n in names if n.startswith("volume_lag")]
    # Copies and midpoints of input prices are the same double in any engine.
    whole += [n for n in names if n.startswith(("close_lag", "ichi")) and n not in whole]
    real = [n for n in names if n not in whole]
    cols = whole + ([q.rounded(real)] if real else [])
    sql = f"{q.with_(q.FEATURES)} SELECT symbol, ts, {', '.join(cols)} FROM feats"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        feats = ind.base_features(inputs.bars(spark, sf)).select("symbol", "ts", *names)
        return rounded(feats, real)

    return sql, run


GROUPS = {
    "trend_averages": (
        "ema_50", "ema_100", "ema_200", "ema_50_dist_norm", "ema_100_dist_norm",
        "ema_200_dist_norm", "ema_50_100_cross", "ema_50_200_cross",
        "price_vs_ema_200_dist_norm", "ema_200_slope",
    ),
    "momentum_rsi": ("rsi", "rsi_norm", "rsi_overbought", "rsi_oversold"),
    "momentum_stochastic": ("stoch_k", "stoch_d", "stoch_cross"),
    "momentum_macd": ("macd", "macd_signal", "macd_hist", "macd_cross"),
    "volatility_atr": ("atr_14", "atr_ma", "atr_std", "atr_zscore"),
    "volatility_bollinger": ("bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_position"),
    "trend_directional": (
        "adx", "plus_di", "minus_di", "strong_uptrend_adx", "strong_downtrend_adx",
    ),
    "trend_cci": ("cci",),
    "trend_ichimoku": (
        "ichi_tenkan", "ichi_kijun", "ichi_senkou_a", "ichi_senkou_b", "ichi_chikou",
        "ichi_trend_bullish", "ichi_trend_bearish", "ichi_tk_cross",
    ),
    "momentum_willr_roc": ("willr", "roc"),
    "volatility_keltner": ("kc_upper", "kc_lower", "kc_middle", "kc_position", "squeeze_on"),
    "lagged_prices": tuple(f"{x}_lag_{n}" for n in ind.LAGS for x in ("close", "volume")),
    "returns_and_volatility": (
        *[f"return_{n}" for n in ind.RETURN_STEPS], "log_return_1",
        *[f"realized_vol_{n}{s}" for n in ind.VOL_WINDOWS for s in ("", "_ann")],
    ),
    "feature_crosses": tuple(ind.CROSS_FEATURES),
}
for _name, _cols in GROUPS.items():
    _sql, _run = _group(*_cols)
    R.queries[_name], R.sql[_name] = _run, _sql

_FLAGS = [f"regime_{x}" for x in ("trending", "ranging", "bullish", "bearish")]


def _htf_sql(tf: str, days: int, p: str) -> str:
    adx, fast, slow = "adx", "ema_50", "ema_200"
    return f"""{q.resampled(p + 'bars', days)},
{q.smoothed(p + 'bars', p)},
{p}htf AS (SELECT symbol, ts, ema_50 AS ema_50_{tf}, ema_200 AS ema_200_{tf}, rsi AS rsi_{tf},
  adx AS adx_{tf}, {q.flag(f'{adx} > 25')} AS regime_trending_{tf}, {q.flag(f'{adx} <= 25')} AS regime_ranging_{tf},
  {q.flag(f'{fast} > {slow}')} AS regime_bullish_{tf}, {q.flag(f'{fast} < {slow}')} AS regime_bearish_{tf}
  FROM {p}feat0)"""


def _htf_cols(tf: str) -> tuple[list[str], list[str]]:
    return [f"{n}_{tf}" for n in ind.HTF_NAMES], [f"{n}_{tf}" for n in _FLAGS]


HTF_SQL = f"{_htf_sql('D3', 3, 'x3')},\n{_htf_sql('D7', 7, 'x7')}"


@R.add(
    f"""{q.with_(q.BARS, _htf_sql('D3', 3, 'x3'))}
    SELECT symbol, ts, {q.rounded(_htf_cols('D3')[0])}, {', '.join(_htf_cols('D3')[1])} FROM x3htf"""
)
def higher_timeframe_indicators(spark: SparkSession, sf: str) -> DataFrame:
    out = ind.htf_features(resample(inputs.bars(spark, sf), "3 days"), "D3")
    return rounded(out, _htf_cols("D3")[0])


_ALL_HTF = [n for tf in ("D3", "D7") for n in sum(_htf_cols(tf), [])]
_REAL_HTF = [n for tf in ("D3", "D7") for n in _htf_cols(tf)[0]]


@R.add(
    f"""{q.with_(q.BARS, HTF_SQL)}
    SELECT b.symbol, b.ts, {q.rounded(_REAL_HTF)}, {', '.join(n for n in _ALL_HTF if n not in _REAL_HTF)}
    FROM bars b ASOF LEFT JOIN x3htf h3 ON b.symbol = h3.symbol AND b.ts >= h3.ts
    ASOF LEFT JOIN x7htf h7 ON b.symbol = h7.symbol AND b.ts >= h7.ts"""
)
def asof_higher_timeframes(spark: SparkSession, sf: str) -> DataFrame:
    daily = inputs.bars(spark, sf)
    out = jobs.add_higher_timeframes(daily, {"D3": "3 days", "D7": "7 days"})
    return rounded(out.select("symbol", "ts", *_ALL_HTF), _REAL_HTF)


@R.add(
    f"""{q.with_(q.BARS, _htf_sql('D3', 3, 'x3'))}
    SELECT b.symbol, b.ts, {q.r('rsi_D3')} AS rsi_D3, regime_trending_D3
    FROM bars b ASOF LEFT JOIN (SELECT * REPLACE (ts + INTERVAL 3 DAY AS ts) FROM x3htf) h
      ON b.symbol = h.symbol AND b.ts >= h.ts"""
)
def asof_closed_timeframe(spark: SparkSession, sf: str) -> DataFrame:
    """Only bars that have closed are visible, so nothing leaks from the running one."""
    out = jobs.add_higher_timeframes(inputs.bars(spark, sf), {"D3": "3 days"}, closed_only=True)
    return rounded(out.select("symbol", "ts", "rsi_D3", "regime_trending_D3"), ["rsi_D3"])


_INT_FEATURES = [
    "ema_50_100_cross", "ema_50_200_cross", "rsi_overbought", "rsi_oversold", "stoch_cross",
    "macd_cross", "strong_uptrend_adx", "strong_downtrend_adx", "ichi_trend_bullish",
    "ichi_trend_bearish", "ichi_tk_cross", "squeeze_on", *[f"volume_lag_{n}" for n in ind.LAGS],
]
ALL_BASE = ind.BASE_FEATURES + ind.CROSS_FEATURES
_EXACT_BASE = [n for n in ALL_BASE if n.startswith(("close_lag", "ichi")) and n not in _INT_FEATURES]
_REAL_BASE = [n for n in ALL_BASE if n not in _INT_FEATURES + _EXACT_BASE]
_NO_NULL = " AND ".join(f"{n} IS NOT NULL" for n in ALL_BASE)


@R.add(
    f"""{q.with_(q.FEATURES, HTF_SQL)}, wide AS (
      SELECT f.*, {', '.join(_ALL_HTF)} FROM feats f
      ASOF LEFT JOIN x3htf h3 ON f.symbol = h3.symbol AND f.ts >= h3.ts
      ASOF LEFT JOIN x7htf h7 ON f.symbol = h7.symbol AND f.ts >= h7.ts)
    SELECT symbol, ts, open, high, low, close, volume, {q.rounded(_REAL_BASE + _REAL_HTF)},
      {', '.join(_INT_FEATURES + _EXACT_BASE + [n for n in _ALL_HTF if n not in _REAL_HTF])},
      0.0::DOUBLE AS tau_pre, 0.0::DOUBLE AS tau_post, 0.0::DOUBLE AS weighted_surprise
    FROM wide WHERE {_NO_NULL} AND {' AND '.join(f'{n} IS NOT NULL' for n in _ALL_HTF)}"""
)
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """The whole feature job: base features, crosses, two higher timeframes, complete rows only."""
    out = jobs.feature_table(inputs.bars(spark, sf), {"D3": "3 days", "D7": "7 days"})
    return rounded(out, _REAL_BASE + _REAL_HTF)


@R.add(
    f"""{q.with_(q.FEATURES)} SELECT symbol, count(*) AS rows_before,
      count(*) FILTER (WHERE {_NO_NULL}) AS rows_after, count(*) FILTER (WHERE NOT ({_NO_NULL})) AS rows_dropped
    FROM feats GROUP BY symbol"""
)
def null_row_drop(spark: SparkSession, sf: str) -> DataFrame:
    feats = ind.base_features(inputs.bars(spark, sf))
    return quality.null_row_counts(feats, ["symbol"], ALL_BASE)


_PROFILED = ["rsi", "atr_14", "ema_200", "macd_cross", "close_lag_5"]


@R.add(
    f"{q.with_(q.FEATURES)} "
    + " UNION ALL ".join(
        f"""SELECT symbol, {i} AS position, '{n}' AS name, '{'int' if n in _INT_FEATURES else 'double'}' AS type,
        count(*) - count({n}) AS nulls, {q.r(f'min({n})::DOUBLE')} AS min, {q.r(f'max({n})::DOUBLE')} AS max
        FROM feats GROUP BY symbol"""
        for i, n in enumerate(_PROFILED)
    )
)
def feature_profile(spark: SparkSession, sf: str) -> DataFrame:
    feats = ind.base_features(inputs.bars(spark, sf))
    return rounded(quality.feature_profile(feats, _PROFILED), ["min", "max"])


@R.add(
    f"""{q.with_(q.BARS)}, syms AS (SELECT DISTINCT symbol FROM bars),
    e AS (SELECT symbol, unnest(['rsi', 'atr_14', 'macd', 'adx']) AS expected, unnest([0, 1, 2, 3]) AS position FROM syms),
    a AS (SELECT symbol, unnest(['rsi', 'macd', 'atr_14', 'adx', 'cci']) AS actual, unnest([0, 1, 2, 3, 4]) AS position FROM syms)
    SELECT symbol, position, expected, actual FROM e FULL JOIN a USING (symbol, position)
    WHERE expected IS DISTINCT FROM actual"""
)
def feature_schema_check(spark: SparkSession, sf: str) -> DataFrame:
    feats = ind.base_features(inputs.bars(spark, sf))
    expected = quality.feature_profile(feats, ["rsi", "atr_14", "macd", "adx"])
    actual = quality.feature_profile(feats, ["rsi", "macd", "atr_14", "adx", "cci"])
    return quality.schema_mismatches(expected, actual)


@R.add(
    f"""{q.with_(q.BARS)} SELECT symbol, ts, volume FROM bars"""
)
def feature_column_selection(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.bars(spark, sf)
    keep = quality.feature_columns(b, ["open", "high", "low", "close"])
    return b.select(*keep)


# Labels, cuts, sequences -------------------------------------------------------------

_LABELLED = f"""lab AS (SELECT symbol, ts, close, forward_close, forward_close - close AS forward_return,
  (forward_close - close) * (CASE WHEN symbol LIKE '%JPY%' THEN 100.0 ELSE 10000.0 END) AS pips, lim
  FROM (SELECT *, lead(close, 6) OVER (PARTITION BY symbol ORDER BY ts) AS forward_close, {{lim}} AS lim FROM {{src}})
  WHERE forward_close IS NOT NULL),
labelled AS (SELECT symbol, ts, forward_close, forward_return, pips AS forward_return_pips,
  CASE WHEN pips > lim THEN 1 WHEN pips < -lim THEN -1 ELSE 0 END AS target,
  CASE WHEN pips > lim THEN 0 WHEN pips < -lim THEN 1 ELSE 2 END AS target_class FROM lab)"""
_LABEL_COLS = ["symbol", "ts", "forward_close", "forward_return", "forward_return_pips", "target", "target_class"]
FIXED_LABELS = _LABELLED.format(lim="4000000", src="bars")


def _fixed_labels(spark: SparkSession, sf: str) -> DataFrame:
    out = labels.forward_label(inputs.bars(spark, sf), 6, pip_threshold=4_000_000)
    return out.select(*_LABEL_COLS)


@R.add(f"{q.with_(q.BARS, FIXED_LABELS)} SELECT * FROM labelled")
def label_fixed_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed_labels(spark, sf)


@R.add(
    q.with_(
        q.BARS,
        q.smoothed(),
        _LABELLED.format(
            lim="atr_14 * (CASE WHEN symbol LIKE '%JPY%' THEN 100.0 ELSE 10000.0 END) * 1.5", src="feat0"
        ),
    )
    + " SELECT * FROM labelled"
)
def label_atr_threshold(spark: SparkSession, sf: str) -> DataFrame:
    b = ind.smoothed(ind.with_moves(ind.feature_blocks(inputs.bars(spark, sf))), {"atr_14"}).close()
    out = labels.forward_label(b, 6, atr_multiplier=1.5)
    return out.select(*_LABEL_COLS)


@R.add(
    f"""{q.with_(q.BARS, FIXED_LABELS)} SELECT symbol, target_class, count(*) AS n,
      {q.r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY symbol)')} AS percent
    FROM labelled GROUP BY symbol, target_class"""
)
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(labels.class_distribution(_fixed_labels(spark, sf)), ["percent"])


@R.add(
    f"""{q.with_(q.BARS)} SELECT symbol, ts, row_number() OVER w - 1 AS row,
      CASE WHEN row_number() OVER w - 1 < floor(count(*) OVER (PARTITION BY symbol) * 0.8::DOUBLE) THEN 'train'
      ELSE 'holdout' END AS part FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""
)
def chronological_cut(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.bars(spark, sf).select("symbol", "ts")
    return labels.with_cut(b, ["symbol"], ["ts"], F.to_date("ts"))


@R.add(
    f"""{q.with_(q.BARS)}, s AS (SELECT symbol, ts, list(close) OVER f AS c, list(volume) OVER f AS v
      FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 21 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, len(c) AS length, c[1] AS first_close, c[22] AS last_close,
      {q.r('list_sum(c)', 3)} AS sum_close, list_sum(v)::DOUBLE AS sum_volume FROM s WHERE len(c) = 22"""
)
def sequence_windows(spark: SparkSession, sf: str) -> DataFrame:
    seq = labels.sequences(inputs.bars(spark, sf), ["close", "volume"], 22)
    total = lambda i: F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[i])
    out = seq.select(
        "symbol",
        "ts",
        F.size("sequence").alias("length"),
        F.col("sequence")[0][0].alias("first_close"),
        F.col("sequence")[21][0].alias("last_close"),
        total(0).alias("sum_close"),
        total(1).alias("sum_volume"),
    )
    return rounded(out, ["sum_close"], 3)


@R.add(
    f"""{q.with_(q.BARS)} SELECT symbol, ts, close FROM bars
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100"""
)
def latest_hundred_bars(spark: SparkSession, sf: str) -> DataFrame:
    return labels.latest_rows(inputs.bars(spark, sf).select("symbol", "ts", "close"), 100)


@R.add(
    f"""{q.with_(q.TICKS)} SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS bar_ts, min(ts) AS ts,
      first(price ORDER BY ts, event_id) AS price
    FROM ticks GROUP BY symbol, time_bucket(INTERVAL 5 MINUTE, ts)"""
)
def new_bar_detection(spark: SparkSession, sf: str) -> DataFrame:
    t = inputs.ticks(spark, sf).select("symbol", "ts", "price", "event_id")
    return trading.new_bar_rows(t, "5 minutes", ["ts", "event_id"]).drop("event_id")


_CORR = ["rsi", "macd", "adx", "cci", "willr", "bb_position", "stoch_k", "rsi_norm", "atr_14", "ema_50", "ema_100", "ema_200", "flat"]


def _corr_rows() -> str:
    parts = []
    for j, b in enumerate(_CORR):
        for i, a in enumerate(_CORR[:j]):
            parts.append(
                f"SELECT symbol, {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN abs(corr({a}, {b})) END AS r FROM clean GROUP BY symbol"
            )
    return " UNION ALL ".join(parts)


_CLEAN = f"clean AS MATERIALIZED (SELECT symbol, {', '.join(_CORR)} FROM (SELECT *, 0.1::DOUBLE AS flat FROM feats) WHERE {' AND '.join(f'{n} IS NOT NULL' for n in _CORR)})"


def _correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of features, a constant one among them."""
    feats = ind.base_features(inputs.bars(spark, sf)).withColumn("flat", F.lit(0.1)).select("symbol", *_CORR)
    return stats.feature_correlation(quality.drop_null_rows(feats), _CORR)


@R.add(f"{q.with_(q.FEATURES, _CLEAN)}, c AS ({_corr_rows()}) SELECT symbol, i, j, a, b, {q.r('r')} AS r FROM c")
def feature_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_correlations(spark, sf), ["r"])


@R.add(
    f"""{q.with_(q.FEATURES, _CLEAN)}, c AS ({_corr_rows()})
    SELECT symbol, b AS feature, string_agg(a, ',' ORDER BY i) AS partners FROM c WHERE r > 0.95 GROUP BY symbol, b"""
)
def correlation_pruning(spark: SparkSession, sf: str) -> DataFrame:
    return stats.correlated_features(_correlations(spark, sf))


_SCALED = ["close", "volume"]


@R.add(
    f"""{q.with_(q.BARS)}, f AS (SELECT symbol, min(close) AS lo, max(close) AS hi, min(volume) AS vlo, max(volume) AS vhi
      FROM bars WHERE ts < TIMESTAMP '2000-01-01' GROUP BY symbol)
    SELECT symbol, ts, {q.r('(close - lo) / (hi - lo)', 6)} AS close, {q.r('(volume - vlo)::DOUBLE / (vhi - vlo)', 6)} AS volume
    FROM bars JOIN f USING (symbol)"""
)
def scaling_min_max(spark: SparkSession, sf: str) -> DataFrame:
    """Range fitted on the years before 2000, applied to all."""
    b = inputs.bars(spark, sf)
    fitted = stats.column_stats(b.where("ts < '2000-01-01'"), _SCALED, ["symbol"])
    out = stats.scale_min_max(b, fitted, _SCALED, ["symbol"]).select("symbol", "ts", *_SCALED)
    return rounded(out, _SCALED, 6)


@R.add(
    f"""{q.with_(q.BARS)}, f AS (SELECT symbol, avg(close) AS m, stddev_pop(close) AS s, avg(volume) AS vm, stddev_pop(volume) AS vs
      FROM bars GROUP BY symbol)
    SELECT symbol, ts, {q.r('(close - m) / s', 6)} AS close, {q.r('(volume - vm) / vs', 6)} AS volume FROM bars JOIN f USING (symbol)"""
)
def scaling_standard(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.bars(spark, sf)
    fitted = stats.column_stats(b, _SCALED, ["symbol"])
    out = stats.scale_standard(b, fitted, _SCALED, ["symbol"]).select("symbol", "ts", *_SCALED)
    return rounded(out, _SCALED, 6)


@R.add(f"{q.with_(q.BARS)} SELECT DISTINCT symbol FROM bars")
def symbol_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    from candlewake.sources.bars import symbol_catalogue as catalogue

    return catalogue(inputs.bars(spark, sf))


@R.add(
    f"""{q.with_(q.BARS)} SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row FROM bars"""
)
def row_positions(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.bars(spark, sf).select("symbol", "ts")
    return with_row_index(b, ["symbol"], ["ts"], F.to_date("ts"), idx="row")


@R.add(
    f"""{q.with_(q.TICKS)}, numbered AS MATERIALIZED (SELECT symbol, event_id, price,
      row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS i FROM ticks),
    run AS (SELECT symbol, i, price AS a, price AS b FROM numbered WHERE i = 0
      UNION ALL SELECT n.symbol, n.i, r.a + 2.0::DOUBLE / 501 * (n.price - r.a), r.b + 2.0::DOUBLE / 10001 * (n.price - r.b)
      FROM run r JOIN numbered n ON n.symbol = r.symbol AND n.i = r.i + 1)
    SELECT n.symbol, event_id, {q.r('a', 6)} AS ema_500, {q.r('b', 6)} AS ema_10000 FROM numbered n JOIN run USING (symbol, i)"""
)
def long_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential averages of ticks over spans longer than a cell of rows, carried exactly."""
    ticks = inputs.ticks(spark, sf).select("symbol", "ts", "event_id", "price")
    numbered = stage(with_row_index(ticks, ["symbol"], ["ts", "event_id"], F.to_date("ts")), "numbered")
    spans = [scan.ema_unseeded("ema_500", "price", 500), scan.ema_unseeded("ema_10000", "price", 10_000)]
    out = carry.running(numbered, ["symbol"], spans)
    return rounded(out.select("symbol", "event_id", "ema_500", "ema_10000"), ["ema_500", "ema_10000"], 6)
