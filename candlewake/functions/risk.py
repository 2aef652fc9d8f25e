"""Stop distance, risk percent, lot size and price levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers per volatility regime, risk tiers and limits.
ATR_MULTIPLIERS = {"LOW": 2.0, "MEDIUM": 2.5, "HIGH": 3.5}
BASE_RISK = 0.5
RISK_TIERS = [(0.80, 4.0), (0.70, 3.0), (0.55, 2.0)]
RECOVERY_FACTOR, RECOVERY_DEPTH = 1.5, 3
MAX_RISK = 5.0
REWARD_RATIO = 2.0


def regime_multiplier(regime: Column) -> Column:
    return (
        F.when(regime == "LOW", ATR_MULTIPLIERS["LOW"])
        .when(regime == "HIGH", ATR_MULTIPLIERS["HIGH"])
        .otherwise(ATR_MULTIPLIERS["MEDIUM"])
    )


def stop_points(
    mode: str,
    point: Column,
    stops_level: Column,
    atr: Column | None = None,
    regime: Column | None = None,
    price: Column | None = None,
    stop_pips: float = 20,
    percent: float = 0.5,
) -> Column:
    """Stop distance in points: ``atr``, ``pips`` or ``percent``; never below the broker minimum."""
    fixed = F.lit(float(stop_pips * 10))
    if mode == "atr":
        mult = regime_multiplier(regime) if regime is not None else F.lit(ATR_MULTIPLIERS["MEDIUM"])
        distance = F.coalesce(F.try_divide(atr * mult, point), fixed)
    elif mode == "percent":
        distance = F.try_divide(price * percent / 100.0, point)
    else:
        distance = fixed
    return F.greatest(distance, stops_level)


def risk_percent(confidence: Column, losses: Column, min_confidence: float = 0.55) -> Column:
    """Risk by confidence tier, raised after losses, capped."""
    tiers = None
    for bound, factor in RISK_TIERS:
        risk = F.lit(BASE_RISK * factor)
        hit = confidence >= bound
        tiers = F.when(hit, risk) if tiers is None else tiers.when(hit, risk)
    tiers = tiers.when(confidence >= min_confidence, BASE_RISK).otherwise(0.0)
    steps = F.least(losses, F.lit(RECOVERY_DEPTH))
    raised = F.when(losses > 0, tiers * F.pow(F.lit(RECOVERY_FACTOR), steps)).otherwise(tiers)
    return F.least(raised, F.lit(MAX_RISK))


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def lot_size(
    balance: Column, risk: Column, stop: Column, spec: dict[str, Column],
    max_margin_percent: float | None = None,
) -> Column:
    """Lots whose loss at the stop is the risked share of the balance.

    A contract whose sizes are zero or unknown gets the smallest lot.
    """
    low, high, step = spec["volume_min"], spec["volume_max"], spec["volume_step"]
    over = F.try_divide
    stop = F.when(stop <= 0, 0.001).otherwise(stop)
    per_lot = stop * over(spec["point"], spec["tick_size"]) * spec["tick_value"]
    raw = F.when(per_lot > 0, over(balance * risk / 100.0, per_lot)).otherwise(low)
    lots = clamp(F.floor(over(raw, step)) * step, low, high)
    if max_margin_percent is not None:
        room = balance * (max_margin_percent / 100.0)
        fits = F.greatest(F.floor(over(over(room, spec["margin_initial"]), step)) * step, low)
        lots = F.when(lots * spec["margin_initial"] > room, fits).otherwise(lots)
    lots = F.when(balance < 10, low).otherwise(lots)
    return clamp(F.coalesce(F.round(over(lots, step)) * step, low), low, high)


def to_digits(price: Column, digits: Column) -> Column:
    """A price rounded half up to the digits its symbol is quoted with."""
    scale = F.pow(F.lit(10.0), digits)
    return F.floor(price * scale + 0.5) / scale


def levels(
    side: Column, ask: Column, bid: Column, stop: Column, point: Column, digits: Column
) -> tuple[Column, Column, Column]:
    """Entry, stop and target price in the symbol's digits; null for HOLD."""
    sign = F.when(side == "BUY", 1).when(side == "SELL", -1)
    entry = F.when(side == "BUY", ask).when(side == "SELL", bid)
    distance = stop * point
    prices = entry, entry - sign * distance, entry + sign * distance * REWARD_RATIO
    return tuple(to_digits(p, digits) for p in prices)
