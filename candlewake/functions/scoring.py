"""Signal quality rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlewake.schema import CLASS_BUY, CLASS_SELL

# Quality weights and thresholds.
W_CONFIDENCE, W_TREND, W_VOLATILITY, W_MOMENTUM = 40, 25, 20, 15
MIN_QUALITY = 40
SIGNAL_PROBABILITY = 0.70


def tier(value: Column, steps: list[tuple[float, float]], otherwise: float, op: str) -> Column:
    """The result of the first step that ``value`` passes."""
    out = None
    for bound, result in steps:
        cond = {">": value > bound, "<": value < bound, ">=": value >= bound}[op]
        out = F.when(cond, result) if out is None else out.when(cond, result)
    return out.otherwise(otherwise)


def confidence_score(p: Column) -> Column:
    return tier(p, [(0.85, 1.0), (0.75, 0.8), (0.65, 0.6), (0.55, 0.4)], 0.2, ">")


def volatility_score(atr_z: Column | None) -> Column:
    if atr_z is None:
        return F.lit(0.5)
    return tier(atr_z, [(0.5, 1.0), (1.0, 0.8), (1.5, 0.6), (2.0, 0.3)], 0.1, "<")


def _points(cond: Column, value: float) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), value).otherwise(0.0)


def trend_score(
    cls: Column, close: Column, ema_50: Column, ema_200: Column, macd: Column, signal: Column
) -> Column:
    """Agreement of the class with the averages and with MACD."""
    buy, sell = cls == CLASS_BUY, cls == CLASS_SELL
    strong = (buy & (close > ema_50) & (ema_50 > ema_200)) | (
        sell & (close < ema_50) & (ema_50 < ema_200)
    )
    weak = (buy & (close > ema_50)) | (sell & (close < ema_50))
    yes = lambda x: F.coalesce(x, F.lit(False))
    average = F.when(yes(strong), 0.5).when(yes(weak), 0.3).otherwise(0.0)
    agrees = (buy & (macd > signal)) | (sell & (macd < signal))
    return F.least(F.lit(1.0), average + _points(agrees, 0.3))


def momentum_score(cls: Column, rsi: Column | None, stoch_k: Column) -> Column:
    """Agreement of the class with RSI and the stochastic; ``rsi=None`` leaves RSI out."""
    buy, sell = cls == CLASS_BUY, cls == CLASS_SELL
    score = _points((buy & (stoch_k < 80)) | (sell & (stoch_k > 20)), 0.3)
    if rsi is not None:
        middle = (buy | sell) & (rsi > 30) & (rsi < 70)
        extreme = (buy & (rsi < 30)) | (sell & (rsi > 70))
        score = _points(middle, 0.5) + _points(extreme, 0.7) + score
    return F.least(F.lit(1.0), score)


def quality_parts(
    probability: Column, cls: Column, row: dict[str, Column], rsi: Column | None
) -> dict[str, Column]:
    """The four weighted components of the quality score."""
    return {
        "confidence": W_CONFIDENCE * confidence_score(probability),
        "trend": W_TREND
        * trend_score(
            cls, row["close"], row["ema_50"], row["ema_200"], row["macd"], row["macd_signal"]
        ),
        "volatility": W_VOLATILITY * volatility_score(row.get("atr_zscore")),
        "momentum": W_MOMENTUM * momentum_score(cls, rsi, row["stoch_k"]),
    }


def position_size(score: Column) -> Column:
    return tier(score, [(80, 1.0), (65, 0.75), (50, 0.5), (40, 0.25)], 0.0, ">=")


def should_trade(score: Column) -> Column:
    return score >= MIN_QUALITY


def signal_rule(score: Column, p_buy: Column, p_sell: Column) -> Column:
    return (
        F.when(score < MIN_QUALITY, "HOLD")
        .when(p_buy > SIGNAL_PROBABILITY, "BUY")
        .when(p_sell > SIGNAL_PROBABILITY, "SELL")
        .otherwise("HOLD")
    )


def argmax_class(*probabilities: Column) -> Column:
    """Index of the largest probability, the first one on ties."""
    arr = F.array(*probabilities)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def class_name(cls: Column) -> Column:
    return F.when(cls == CLASS_BUY, "BUY").when(cls == CLASS_SELL, "SELL").otherwise("HOLD")


def direction(name: Column) -> Column:
    """BUY is 1, SELL is -1, anything else 0."""
    upper = F.upper(name)
    return F.when(upper == "BUY", 1).when(upper == "SELL", -1).otherwise(0)


def pips(move: Column, symbol: Column) -> Column:
    return move * pip_factor(symbol)


def pip_factor(symbol: Column) -> Column:
    return F.when(symbol.contains("JPY"), 100.0).otherwise(10000.0)
