"""Technical indicators over blocks of bars.

Every function takes :class:`Blocks` whose rows carry open/high/low/close/volume and
returns the blocks with more columns. Because all of them use the window specs of the
same blocks, a whole feature job needs one shuffle and one sort after indexing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from candlewake.operators import scan
from candlewake.operators.blocks import (
    BLOCK_ROWS,
    IDX,
    Blocks,
    day_of,
    indexed_blocks,
)

# Indicator periods.
EMA_PERIODS = (50, 100, 200)
RSI_PERIOD = 14
ATR_PERIOD = 14
STOCH_FASTK, STOCH_SLOWK, STOCH_SLOWD = 14, 3, 3
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
ATR_NORM_PERIOD = 50
BB_PERIOD, BB_WIDTH = 20, 2.0
ADX_PERIOD = 14
CCI_PERIOD = 14
TENKAN, KIJUN, SENKOU = 9, 26, 52
WILLR_PERIOD = 14
ROC_PERIOD = 12
KC_EMA, KC_ATR, KC_WIDTH = 20, 10, 2.0
LAGS = (1, 2, 3, 5, 10)
RETURN_STEPS = (1, 5, 10, 22)
VOL_WINDOWS = (5, 10, 22, 50)
TREND_ADX = 25

# Rows an indicator chain looks back: the slowest average, or Wilder twice for ADX.
_WILDER = 1 - 1.0 / 14
FEATURE_BACK = max(scan.reach(1 - 2.0 / 201), scan.reach(_WILDER, _WILDER) + 64) + 64
FEATURE_AHEAD = KIJUN


def flag(cond: str) -> str:
    """1 when true; 0 when false or unknown."""
    return f"int(coalesce({cond}, false))"


def side(cond: str) -> str:
    """1 when true; -1 when false or unknown."""
    return f"CASE WHEN {cond} THEN 1 ELSE -1 END"


def ratio(a: str, b: str) -> str:
    """Division that yields null for a zero divisor."""
    return f"try_divide({a}, {b})"


def guarded(a: str, b: str, scale: str = "100D") -> str:
    """Scaled division that yields 0 for a zero divisor."""
    return f"CASE WHEN {b} = 0 THEN 0D ELSE {scale} * try_divide({a}, {b}) END"


def since(row: int, expr: str) -> str:
    """Null before the given row position."""
    return f"CASE WHEN {IDX} >= {row} THEN {expr} END"


def feature_blocks(
    bars: DataFrame,
    keys: list[str] | None = None,
    ts: str = "ts",
    bucket: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> Blocks:
    keys = keys or ["symbol"]
    return indexed_blocks(
        bars,
        keys,
        [ts],
        day_of(ts) if bucket is None else bucket,
        FEATURE_BACK,
        FEATURE_AHEAD,
        block_rows,
    )


def with_moves(b: Blocks) -> Blocks:
    """Bar-to-bar inputs of the smoothed indicators."""
    b = b.add_sql({f"_p{n[0]}": f"lag({n}) {b.over_rows}" for n in ("close", "high", "low")})
    up, down = "high - _ph", "_pl - low"
    return b.add_sql(
        {
            "_gain": "greatest(close - _pc, 0D)",
            "_loss": "greatest(_pc - close, 0D)",
            "_tr": "greatest(high - low, abs(high - _pc), abs(low - _pc))",
            "_pdm": f"CASE WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0D END",
            "_mdm": f"CASE WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0D END",
        },
        drop=["_ph", "_pl"],
    )


def smoothed(b: Blocks, names: set[str] | None = None) -> Blocks:
    """First-level recursions on price and moves, all in one pass.

    ``names`` restricts the pass to the wanted outputs.
    """
    every = [
        *[scan.ema(f"ema_{n}", "close", n) for n in EMA_PERIODS],
        scan.ema("_ema_kc", "close", KC_EMA),
        scan.ema("_ema_fast", "close", MACD_FAST, first=MACD_SLOW - MACD_FAST),
        scan.ema("_ema_slow", "close", MACD_SLOW),
        scan.wilder("_avg_gain", "_gain", RSI_PERIOD),
        scan.wilder("_avg_loss", "_loss", RSI_PERIOD),
        scan.wilder("atr_14", "_tr", ATR_PERIOD),
        scan.wilder("_atr_kc", "_tr", KC_ATR),
        scan.wilder_sum("_str", "_tr", ADX_PERIOD, ADX_PERIOD),
        scan.wilder_sum("_spdm", "_pdm", ADX_PERIOD, ADX_PERIOD),
        scan.wilder_sum("_smdm", "_mdm", ADX_PERIOD, ADX_PERIOD),
    ]
    return scan.apply(b, [r for r in every if names is None or r.name in names])


RSI = guarded("_avg_gain", "(_avg_gain + _avg_loss)")
MACD_LINE = "_ema_fast - _ema_slow"


def directional(b: Blocks) -> Blocks:
    """+DI, -DI and the directional index they span."""
    b = b.add_sql({"plus_di": guarded("_spdm", "_str"), "minus_di": guarded("_smdm", "_str")})
    return b.add_sql({"_dx": guarded("abs(plus_di - minus_di)", "(plus_di + minus_di)")})


ADX = scan.wilder("adx", "_dx", ADX_PERIOD, first=ADX_PERIOD)
SIGNAL = scan.ema("macd_signal", "_macd", MACD_SIGNAL, first=MACD_SLOW - 1)


def rolling(b: Blocks) -> Blocks:
    """Trailing frames on prices, returns and ATR; takes the blocks of :func:`with_moves`.

    All frames sit in one window pass, where those of equal length share their work; the
    second pass only reads values of earlier rows.
    """
    far = [n for n in RETURN_STEPS if n not in LAGS]
    atr_from = ATR_PERIOD + ATR_NORM_PERIOD - 1
    b = b.add_sql(
        {"_tp": "(high + low + close) / 3D", "return_1": f"{ratio('close', '_pc')} - 1"}
    )

    def frame(n: int, expr: str, first: int | None = None) -> str:
        return since(n - 1 if first is None else first, f"{expr} {b.over_last(n)}")

    b = b.add_sql(
        {
            "bb_middle": frame(BB_PERIOD, "avg(close)"),
            "_bb_sd": frame(BB_PERIOD, "stddev_pop(close)"),
            "_tps": f"collect_list(_tp) {b.over_last(CCI_PERIOD)}",
            "_tp_mean": frame(CCI_PERIOD, "avg(_tp)"),
            "atr_ma": frame(ATR_NORM_PERIOD, "avg(atr_14)", atr_from),
            "atr_std": frame(ATR_NORM_PERIOD, "stddev_samp(atr_14)", atr_from),
            "ichi_chikou": f"lead(close, {KIJUN}) {b.over_rows}",
            "_pc_roc": f"lag(close, {ROC_PERIOD}) {b.over_rows}",
            "ema_200_slope": f"ema_200 - lag(ema_200) {b.over_rows}",
        }
        | {f"_hh{n}": frame(n, "max(high)") for n in (TENKAN, WILLR_PERIOD, KIJUN)}
        | {f"_ll{n}": frame(n, "min(low)") for n in (TENKAN, WILLR_PERIOD, KIJUN)}
        | {f"realized_vol_{n}": frame(n, "stddev_samp(return_1)", n) for n in VOL_WINDOWS}
        | {f"{x}_lag_{n}": f"lag({x}, {n}) {b.over_rows}" for n in LAGS for x in ("close", "volume")}
        | {f"_pc_{n}": f"lag(close, {n}) {b.over_rows}" for n in far}
    )
    past = {n: f"close_lag_{n}" if n in LAGS else f"_pc_{n}" for n in RETURN_STEPS}
    hh, ll = f"_hh{WILLR_PERIOD}", f"_ll{WILLR_PERIOD}"
    deviation = f"aggregate(_tps, 0D, (a, x) -> a + abs(x - _tp_mean)) / {CCI_PERIOD}"
    b = b.add_sql(
        {f"return_{n}": f"{ratio('close', past[n])} - 1" for n in RETURN_STEPS if n != 1}
        | {
            "log_return_1": f"ln({ratio('close', past[1])})",
            "ichi_tenkan": f"(_hh{TENKAN} + _ll{TENKAN}) / 2",
            "ichi_kijun": f"(_hh{KIJUN} + _ll{KIJUN}) / 2",
            "_mean_dev": since(CCI_PERIOD - 1, deviation),
            "_fastk": guarded(f"(close - {ll})", f"({hh} - {ll})"),
            "willr": guarded(f"({hh} - close)", f"({hh} - {ll})", "-100D"),
            "roc": f"({ratio('close', '_pc_roc')} - 1) * 100D",
        },
        drop=["_tps", "_pc_roc", *[f"_pc_{n}" for n in far]],
    )
    # The long span covers twice the middle one: its extremes are those of two halves.
    older = lambda x: f"lag({x}, {KIJUN}) {b.over_rows}"
    oldest = lambda x: f"lag({x}, {2 * KIJUN}) {b.over_rows}"
    k_from = STOCH_FASTK + STOCH_SLOWK - 2
    top = f"greatest({older(f'_hh{KIJUN}')}, {oldest(f'_hh{KIJUN}')})"
    low = f"least({older(f'_ll{KIJUN}')}, {oldest(f'_ll{KIJUN}')})"
    return b.add_sql(
        {
            "ichi_senkou_a": f"({older('ichi_tenkan')} + {older('ichi_kijun')}) / 2",
            "ichi_senkou_b": since(SENKOU + KIJUN - 1, f"({top} + {low}) / 2"),
            "_slowk": since(k_from, f"avg(_fastk) {b.over_last(STOCH_SLOWK)}"),
        }
    )


def derived(b: Blocks) -> Blocks:
    """Everything that only combines columns of the same or the previous row."""
    stoch_from = STOCH_FASTK + STOCH_SLOWK + STOCH_SLOWD - 3
    macd_from = MACD_SLOW + MACD_SIGNAL - 2
    b = b.add_sql(
        {
            "stoch_k": since(stoch_from, "_slowk"),
            "stoch_d": since(stoch_from, f"avg(_slowk) {b.over_last(STOCH_SLOWD)}"),
            "rsi": RSI,
            "macd": since(macd_from, "_macd"),
            "cci": guarded("(_tp - _tp_mean)", "(0.015D * _mean_dev)", "1D"),
            "bb_upper": f"bb_middle + {BB_WIDTH}D * _bb_sd",
            "bb_lower": f"bb_middle - {BB_WIDTH}D * _bb_sd",
            "kc_middle": "_ema_kc",
            "kc_upper": f"_ema_kc + {KC_WIDTH}D * _atr_kc",
            "kc_lower": f"_ema_kc - {KC_WIDTH}D * _atr_kc",
        }
    )
    position = ratio("close - bb_lower", "bb_upper - bb_lower")
    b = b.add_sql(
        {
            f"ema_{n}_dist_norm": ratio(f"close - ema_{n}", "atr_14") for n in EMA_PERIODS
        }
        | {
            "ema_50_100_cross": side("ema_50 > ema_100"),
            "ema_50_200_cross": side("ema_50 > ema_200"),
            "price_vs_ema_200_dist_norm": ratio("close - ema_200", "atr_14"),
            "rsi_norm": "rsi / 100D",
            "rsi_overbought": flag("rsi > 70"),
            "rsi_oversold": flag("rsi < 30"),
            "stoch_cross": side("stoch_k > stoch_d"),
            "macd_hist": "macd - macd_signal",
            "macd_cross": side("macd > macd_signal"),
            "atr_zscore": f"coalesce({ratio('atr_14 - atr_ma', 'atr_std')}, 0D)",
            "bb_width": ratio("bb_upper - bb_lower", "bb_middle"),
            "bb_position": f"CASE WHEN bb_upper > bb_lower THEN least(1D, greatest(0D, {position})) END",
            "strong_uptrend_adx": flag(f"adx > {TREND_ADX} AND plus_di > minus_di"),
            "strong_downtrend_adx": flag(f"adx > {TREND_ADX} AND minus_di > plus_di"),
            "ichi_trend_bullish": flag("close > ichi_senkou_a AND close > ichi_senkou_b"),
            "ichi_trend_bearish": flag("close < ichi_senkou_a AND close < ichi_senkou_b"),
            "ichi_tk_cross": side("ichi_tenkan > ichi_kijun"),
            "kc_position": ratio("close - kc_lower", "kc_upper - kc_lower"),
            "squeeze_on": flag("bb_upper < kc_upper AND bb_lower > kc_lower"),
        }
        | {f"realized_vol_{n}_ann": f"realized_vol_{n} * sqrt(252D)" for n in VOL_WINDOWS}
    )
    return b.add_sql(
        {
            "rsi_atr_cross": "rsi_norm * atr_zscore",
            "macd_vol_cross": "macd_hist * realized_vol_10",
            "bb_rsi_cross": "bb_position * rsi_norm",
        }
    )


# Base feature names in contract order.
BASE_FEATURES = [
    "ema_50", "atr_14", "ema_50_dist_norm", "ema_100", "ema_100_dist_norm", "ema_200",
    "ema_200_dist_norm", "ema_50_100_cross", "ema_50_200_cross", "price_vs_ema_200_dist_norm",
    "ema_200_slope",
    "rsi", "rsi_norm", "rsi_overbought", "rsi_oversold", "stoch_k", "stoch_d", "stoch_cross",
    "macd", "macd_signal", "macd_hist", "macd_cross",
    "atr_ma", "atr_std", "atr_zscore", "bb_upper", "bb_middle", "bb_lower", "bb_width",
    "bb_position",
    "adx", "plus_di", "minus_di", "cci", "strong_uptrend_adx", "strong_downtrend_adx",
    "ichi_tenkan", "ichi_kijun", "ichi_senkou_a", "ichi_senkou_b", "ichi_chikou",
    "ichi_trend_bullish", "ichi_trend_bearish", "ichi_tk_cross",
    "willr", "roc",
    "kc_upper", "kc_lower", "kc_middle", "kc_position", "squeeze_on",
    *[f"{x}_lag_{n}" for n in LAGS for x in ("close", "volume")],
    *[f"return_{n}" for n in RETURN_STEPS], "log_return_1",
    *[f"realized_vol_{n}{s}" for n in VOL_WINDOWS for s in ("", "_ann")],
]
CROSS_FEATURES = ["rsi_atr_cross", "macd_vol_cross", "bb_rsi_cross"]
LOOKAHEAD_FEATURES = ["ichi_chikou"]


def base_features(
    bars: DataFrame,
    ts: str = "ts",
    bucket: Column | None = None,
    block_rows: int = BLOCK_ROWS,
    drop_lookahead: bool = False,
) -> DataFrame:
    """All base features and crosses of every bar of every symbol.

    ``drop_lookahead`` leaves out the column that reads future closes.
    """
    passed = bars.columns
    b = feature_blocks(bars, ts=ts, bucket=bucket, block_rows=block_rows)
    # Recursions come first, while the rows that every window pass copies are narrow.
    b = directional(smoothed(with_moves(b))).add_sql({"_macd": MACD_LINE})
    b = derived(rolling(scan.apply(b, [SIGNAL, ADX])))
    names = [
        n
        for n in BASE_FEATURES + CROSS_FEATURES
        if not (drop_lookahead and n in LOOKAHEAD_FEATURES)
    ]
    return b.close().select(*passed, *names)


HTF_NAMES = ["ema_50", "ema_200", "rsi", "adx"]


def htf_features(bars: DataFrame, timeframe: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trend, momentum and regime columns of a higher timeframe, suffixed with its name."""
    b = smoothed(
        with_moves(feature_blocks(bars, block_rows=block_rows)),
        {"ema_50", "ema_200", "_avg_gain", "_avg_loss", "_str", "_spdm", "_smdm"},
    )
    b = scan.apply(directional(b), [ADX]).add_sql({"rsi": RSI})
    named = [f"{n} AS {n}_{timeframe}" for n in HTF_NAMES]
    out = b.close().selectExpr("symbol", "ts", *named)
    return out.selectExpr("*", *[f"{e} AS {n}" for n, e in regime_flags(timeframe).items()])


def regime_flags(timeframe: str) -> dict[str, str]:
    """Trending/ranging and bullish/bearish flags; unknown inputs give 0 in both."""
    fast, slow = f"ema_50_{timeframe}", f"ema_200_{timeframe}"
    return {
        f"regime_trending_{timeframe}": flag(f"adx_{timeframe} > {TREND_ADX}"),
        f"regime_ranging_{timeframe}": flag(f"adx_{timeframe} <= {TREND_ADX}"),
        f"regime_bullish_{timeframe}": flag(f"{fast} > {slow}"),
        f"regime_bearish_{timeframe}": flag(f"{fast} < {slow}"),
    }
