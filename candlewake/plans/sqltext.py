"""SQL twins of the stand-in tables and of shared calculations, for the DuckDB check."""

from __future__ import annotations

from candlewake.schema import CURRENCY_COUNTRY, PAIRS

PAIR_LIST = "[" + ", ".join(f"'{p}'" for p in PAIRS) + "]"


def pair_of(key: str) -> str:
    return f"{PAIR_LIST}[({key} % {len(PAIRS)} + 1)::INT]"


TRADES = f"""trades AS (
  SELECT {pair_of('l_suppkey')} AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
         l_quantity AS size, l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lineitem)"""

_TICK_ORDER = "ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice"

BARS = f"""{TRADES},
bars AS MATERIALIZED (
  SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts,
         first(price ORDER BY {_TICK_ORDER}) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY {_TICK_ORDER}) AS close, sum(size)::BIGINT AS volume
  FROM trades GROUP BY ALL)"""

TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, 1 + value / 100 AS price, 1 AS size, event_id, user_id, value,
         json_extract_string(props, '$.k')::INT AS k
  FROM events)"""


def resampled(name: str, days: int, source: str = "bars") -> str:
    bin_ = f"time_bucket(INTERVAL {days} DAY, ts, TIMESTAMP '1970-01-01')"
    return f"""{name} AS MATERIALIZED (
  SELECT symbol, {bin_} AS ts, first(open ORDER BY s.ts) AS open, max(high) AS high,
         min(low) AS low, last(close ORDER BY s.ts) AS close, sum(volume)::BIGINT AS volume
  FROM {source} s GROUP BY symbol, {bin_})"""


def r(expr: str, digits: int = 4) -> str:
    """Rounded, without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def rounded(names: list[str], digits: int = 4) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


def indexed(source: str = "bars", name: str = "base") -> str:
    """Row position, previous values and moves per symbol."""
    return f"""{name}_lag AS (
  SELECT *, (row_number() OVER w - 1)::BIGINT AS idx, lag(close) OVER w AS pc,
         lag(high) OVER w AS ph, lag(low) OVER w AS pl
  FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
{name} AS MATERIALIZED (
  SELECT *, greatest(close - pc, 0.0) AS gain, greatest(pc - close, 0.0) AS loss,
         CASE WHEN pc IS NULL THEN high - low
              ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
         CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pdm,
         CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS mdm
  FROM {name}_lag)"""


def _mean_step(name: str, x: str, n: int, alpha: str, first: int = 0) -> str:
    """One step of an average that is summed while it warms up and smoothed afterwards."""
    at = first + n - 1
    return f"""CASE WHEN b.idx < {first} THEN 0.0
       WHEN b.idx < {at} THEN p.{name} + {x}
       WHEN b.idx = {at} THEN (p.{name} + {x}) / {n}
       ELSE p.{name} * (1 - {alpha}) + {alpha} * {x} END"""


def _sum_step(name: str, x: str, n: int) -> str:
    return f"""CASE WHEN b.idx < {n} THEN p.{name} + {x}
       ELSE p.{name} - p.{name} / {n}::DOUBLE + {x} END"""


def recursion(source: str = "base", name: str = "rec") -> str:
    """Row-by-row evaluation of every first-level recursion, one row of each symbol per step."""
    f = lambda a: f"({a}::DOUBLE)"
    steps = {
        "e50": _mean_step("e50", "b.close", 50, f("2") + "/51"),
        "e100": _mean_step("e100", "b.close", 100, f("2") + "/101"),
        "e200": _mean_step("e200", "b.close", 200, f("2") + "/201"),
        "e20": _mean_step("e20", "b.close", 20, f("2") + "/21"),
        "e12": _mean_step("e12", "b.close", 12, f("2") + "/13", 14),
        "e26": _mean_step("e26", "b.close", 26, f("2") + "/27"),
        "ag": _mean_step("ag", "b.gain", 14, f("1") + "/14", 1),
        "al": _mean_step("al", "b.loss", 14, f("1") + "/14", 1),
        "a14": _mean_step("a14", "b.tr", 14, f("1") + "/14", 1),
        "a10": _mean_step("a10", "b.tr", 10, f("1") + "/10", 1),
        "str": _sum_step("str", "b.tr", 14),
        "spd": _sum_step("spd", "b.pdm", 14),
        "smd": _sum_step("smd", "b.mdm", 14),
    }
    start = {k: "0.0::DOUBLE" for k in steps}
    for k in ("e50", "e100", "e200", "e20", "e26"):
        start[k] = "close"
    return f"""{name} AS (
  SELECT symbol, idx, {', '.join(f'{v} AS {k}' for k, v in start.items())}
  FROM {source} WHERE idx = 0
  UNION ALL
  SELECT b.symbol, b.idx, {', '.join(f'{v} AS {k}' for k, v in steps.items())}
  FROM {name} p JOIN {source} b ON b.symbol = p.symbol AND b.idx = p.idx + 1)"""


def second_recursion(source: str, name: str) -> str:
    """MACD signal and ADX, from columns ``m`` (MACD) and ``dx`` of ``source``."""
    sig = _mean_step("sig", "b.m", 9, "0.2::DOUBLE", 25)
    adx = _mean_step("adx", "b.dx", 14, "(1::DOUBLE)/14", 14)
    return f"""{name} AS (
  SELECT symbol, idx, 0.0::DOUBLE AS sig, 0.0::DOUBLE AS adx FROM {source} WHERE idx = 0
  UNION ALL
  SELECT b.symbol, b.idx, {sig} AS sig, {adx} AS adx
  FROM {name} p JOIN {source} b ON b.symbol = p.symbol AND b.idx = p.idx + 1)"""


def smoothed(source: str = "bars", p: str = "") -> str:
    """Smoothed inputs ``{p}feat0``: all recursions with nulls during their warm-up."""
    return f"""{indexed(source, p + 'base')},
{recursion(p + 'base', p + 'rec')},
{p}lvl1 AS MATERIALIZED (
  SELECT b.*, r.* EXCLUDE (symbol, idx), e12 - e26 AS m,
         CASE WHEN str = 0 THEN 0.0 ELSE 100.0 * spd / str END AS pdi,
         CASE WHEN str = 0 THEN 0.0 ELSE 100.0 * smd / str END AS mdi,
         CASE WHEN str = 0 OR spd + smd = 0 THEN 0.0
              ELSE 100.0 * abs(100.0 * spd / str - 100.0 * smd / str)
                   / (100.0 * spd / str + 100.0 * smd / str) END AS dx
  FROM {p}base b JOIN {p}rec r ON b.symbol = r.symbol AND b.idx = r.idx),
{second_recursion(p + 'lvl1', p + 'rec2')},
{p}feat0 AS MATERIALIZED (
  SELECT b.symbol, b.ts, b.idx, open, high, low, close, volume,
         CASE WHEN b.idx >= 49 THEN e50 END AS ema_50,
         CASE WHEN b.idx >= 99 THEN e100 END AS ema_100,
         CASE WHEN b.idx >= 199 THEN e200 END AS ema_200,
         CASE WHEN b.idx >= 19 THEN e20 END AS kc_middle,
         CASE WHEN b.idx >= 33 THEN m END AS macd,
         CASE WHEN b.idx >= 33 THEN sig END AS macd_signal,
         CASE WHEN b.idx >= 14 THEN CASE WHEN ag + al = 0 THEN 0.0
                                    ELSE 100.0 * ag / (ag + al) END END AS rsi,
         CASE WHEN b.idx >= 14 THEN a14 END AS atr_14,
         CASE WHEN b.idx >= 10 THEN a10 END AS atr_10,
         CASE WHEN b.idx >= 14 THEN pdi END AS plus_di,
         CASE WHEN b.idx >= 14 THEN mdi END AS minus_di,
         CASE WHEN b.idx >= 27 THEN adx END AS adx
  FROM {p}lvl1 b JOIN {p}rec2 s ON b.symbol = s.symbol AND b.idx = s.idx)"""


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def side(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE -1 END"


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def from_row(n: int, expr: str) -> str:
    return f"CASE WHEN idx >= {n} THEN {expr} END"


def features(source: str = "feat0", out: str = "feats") -> str:
    """Every base feature and cross, on top of :func:`smoothed`."""
    w = "(PARTITION BY symbol ORDER BY ts)"
    hh = lambda n: from_row(n - 1, f"max(high) OVER {frame(n)}")
    ll = lambda n: from_row(n - 1, f"min(low) OVER {frame(n)}")
    lags = ", ".join(
        f"lag({x}, {n}) OVER {w} AS {x}_lag_{n}"
        for n in (1, 2, 3, 5, 10)
        for x in ("close", "volume")
    )
    rets = ", ".join(f"close / lag(close, {n}) OVER {w} - 1 AS return_{n}" for n in (1, 5, 10, 22))
    vols = ", ".join(
        f"{from_row(n, f'stddev_samp(return_1) OVER {frame(n)}')} AS realized_vol_{n}"
        for n in (5, 10, 22, 50)
    )
    return f"""f1 AS (
  SELECT *, (high + low + close) / 3.0 AS tp,
    {from_row(19, f'avg(close) OVER {frame(20)}')} AS bb_middle,
    {from_row(19, f'stddev_pop(close) OVER {frame(20)}')} AS sd20,
    {hh(14)} AS hh14, {ll(14)} AS ll14,
    ({hh(9)} + {ll(9)}) / 2 AS ichi_tenkan, ({hh(26)} + {ll(26)}) / 2 AS ichi_kijun,
    ({hh(52)} + {ll(52)}) / 2 AS span_b, lead(close, 26) OVER {w} AS ichi_chikou,
    {lags}, {rets}, ln(close / lag(close) OVER {w}) AS log_return_1,
    (close / lag(close, 12) OVER {w} - 1) * 100.0 AS roc,
    {from_row(63, f'avg(atr_14) OVER {frame(50)}')} AS atr_ma,
    {from_row(63, f'stddev_samp(atr_14) OVER {frame(50)}')} AS atr_std,
    ema_200 - lag(ema_200) OVER {w} AS ema_200_slope
  FROM {source}),
f2 AS (
  SELECT *, list(tp) OVER {frame(14)} AS tps, {from_row(13, f'avg(tp) OVER {frame(14)}')} AS tpm,
    CASE WHEN hh14 = ll14 THEN 0.0 ELSE 100.0 * (close - ll14) / (hh14 - ll14) END AS fastk,
    CASE WHEN hh14 = ll14 THEN 0.0 ELSE -100.0 * (hh14 - close) / (hh14 - ll14) END AS willr,
    lag((ichi_tenkan + ichi_kijun) / 2, 26) OVER {w} AS ichi_senkou_a,
    lag(span_b, 26) OVER {w} AS ichi_senkou_b, {vols}
  FROM f1),
f3 AS (
  SELECT *, {from_row(15, f'avg(fastk) OVER {frame(3)}')} AS slowk,
    {from_row(13, 'list_sum(list_transform(tps, lambda x: abs(x - tpm))) / 14')} AS md
  FROM f2),
f4 AS (
  SELECT *, {from_row(17, 'slowk')} AS stoch_k, {from_row(17, f'avg(slowk) OVER {frame(3)}')} AS stoch_d,
    CASE WHEN md = 0 THEN 0.0 ELSE (tp - tpm) / (0.015 * md) END AS cci,
    bb_middle + 2 * sd20 AS bb_upper, bb_middle - 2 * sd20 AS bb_lower,
    kc_middle + 2 * atr_10 AS kc_upper, kc_middle - 2 * atr_10 AS kc_lower,
    coalesce((atr_14 - atr_ma) / nullif(atr_std, 0), 0.0) AS atr_zscore
  FROM f3),
{out} AS (
  SELECT *, (close - ema_50) / nullif(atr_14, 0) AS ema_50_dist_norm,
    (close - ema_100) / nullif(atr_14, 0) AS ema_100_dist_norm,
    (close - ema_200) / nullif(atr_14, 0) AS ema_200_dist_norm,
    (close - ema_200) / nullif(atr_14, 0) AS price_vs_ema_200_dist_norm,
    {side('ema_50 > ema_100')} AS ema_50_100_cross, {side('ema_50 > ema_200')} AS ema_50_200_cross,
    rsi / 100.0 AS rsi_norm, {flag('rsi > 70')} AS rsi_overbought,
    {flag('rsi < 30')} AS rsi_oversold, {side('stoch_k > stoch_d')} AS stoch_cross,
    macd - macd_signal AS macd_hist, {side('macd > macd_signal')} AS macd_cross,
    (bb_upper - bb_lower) / nullif(bb_middle, 0) AS bb_width,
    least(1.0, greatest(0.0, (close - bb_lower) / nullif(bb_upper - bb_lower, 0))) AS bb_pos_raw,
    CASE WHEN bb_upper > bb_lower THEN bb_pos_raw END AS bb_position,
    {flag('adx > 25 AND plus_di > minus_di')} AS strong_uptrend_adx,
    {flag('adx > 25 AND minus_di > plus_di')} AS strong_downtrend_adx,
    {flag('close > ichi_senkou_a AND close > ichi_senkou_b')} AS ichi_trend_bullish,
    {flag('close < ichi_senkou_a AND close < ichi_senkou_b')} AS ichi_trend_bearish,
    {side('ichi_tenkan > ichi_kijun')} AS ichi_tk_cross,
    (close - kc_lower) / nullif(kc_upper - kc_lower, 0) AS kc_position,
    {flag('bb_upper < kc_upper AND bb_lower > kc_lower')} AS squeeze_on,
    {', '.join(f'realized_vol_{n} * sqrt(252) AS realized_vol_{n}_ann' for n in (5, 10, 22, 50))},
    rsi / 100.0 * atr_zscore AS rsi_atr_cross,
    (macd - macd_signal) * realized_vol_10 AS macd_vol_cross,
    bb_position * (rsi / 100.0) AS bb_rsi_cross
  FROM f4)"""


FEATURES = f"{BARS},\n{smoothed()},\n{features()}"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)


HOURS = f"""{TICKS},
hours AS MATERIALIZED (
  SELECT {pair_of('user_id')} AS symbol, date_trunc('hour', t.ts)::TIMESTAMP AS ts,
         first(price ORDER BY t.ts, event_id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY t.ts, event_id) AS close, sum(size)::BIGINT AS volume
  FROM ticks t GROUP BY ALL)"""

COUNTRY_LIST = "[" + ", ".join(f"'{c}'" for c in CURRENCY_COUNTRY.values()) + "]"
CURRENCY_LIST = "[" + ", ".join(f"'{c}'" for c in CURRENCY_COUNTRY) + "]"

CALENDAR = f"""calendar AS (
  SELECT event_id, ts, 'release ' || (user_id % 6) AS event_name,
         {COUNTRY_LIST}[(user_id % 8 + 1)::INT] AS country, value AS actual_value,
         json_extract_string(props, '$.k')::DOUBLE AS consensus_forecast,
         (event_id % 100)::DOUBLE AS previous_value, (event_id % 3 + 1)::INT AS impact_level
  FROM events WHERE event_type = 'purchase')"""

NEWS = f"""news AS (
  SELECT doc_id, make_timestamp((1704067200 + doc_id % 30 * 86400 + doc_id % 24 * 3600) * 1000000) AS ts,
         {CURRENCY_LIST}[(doc_id % 8 + 1)::INT] AS currency, text, lang
  FROM documents)"""

_W = lambda a, b: f"pow(1 + (d * {a} + s * {b}) % 11, 3)"

PREDICTIONS = f"""predictions AS MATERIALIZED (
  SELECT symbol, ts, close, wb / (wb + ws + wh) AS pred_buy_prob,
         ws / (wb + ws + wh) AS pred_sell_prob, wh / (wb + ws + wh) AS pred_hold_prob,
         CASE WHEN wb >= ws AND wb >= wh THEN 0 WHEN ws >= wh THEN 1 ELSE 2 END AS predicted_class,
         greatest(pred_buy_prob, pred_sell_prob, pred_hold_prob) AS confidence,
         CASE predicted_class WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS signal
  FROM (SELECT *, {_W(7, 13)} AS wb, {_W(5, 7)} AS ws, {_W(3, 11)} AS wh
        FROM (SELECT *, datediff('day', DATE '1970-01-01', ts::DATE) AS d,
                     list_position({PAIR_LIST}, symbol) AS s FROM bars)))"""

POSITIONS = f"""positions AS (
  SELECT o_orderkey AS ticket, {pair_of('o_custkey')} AS symbol,
         CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
         o_orderdate AS open_ts,
         o_orderdate + to_days((o_orderkey % 5 + 1)::INT) AS close_ts,
         (o_orderkey % 201 - 100)::DOUBLE AS profit
  FROM orders)"""


def _spec_rows() -> str:
    rows = []
    for i, p in enumerate(PAIRS):
        point = "0.001" if "JPY" in p else "0.00001"
        digits = 3 if "JPY" in p else 5
        rows.append(
            f"('{p}', {point}::DOUBLE, {point}::DOUBLE, 1.0::DOUBLE, 0.01::DOUBLE, 50.0::DOUBLE, "
            f"0.01::DOUBLE, 20.0::DOUBLE, {digits}, 1000.0::DOUBLE, {0.5 + i}::DOUBLE)"
        )
    return ", ".join(rows)


SPECS = f"""specs(symbol, point, tick_size, tick_value, volume_min, volume_max, volume_step,
  stops_level, digits, margin_initial, spread) AS (VALUES {_spec_rows()})"""
