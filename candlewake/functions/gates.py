"""Symbol names, time-of-day rules and trade gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewake.schema import SYMBOL_ALIASES

# Sessions as (name, first hour, hour after the last), broker suffixes,
# tradable pairs, gate thresholds.
SESSIONS = [("asian", 0, 9), ("london", 8, 17), ("newyork", 13, 22)]
SUFFIXES = [".ecn", ".raw", ".pro", ".m", "."]
ALLOWED = [
    "EURUSD", "GBPUSD", "AUDUSD", "USDJPY", "EUR_USD", "GBP_USD", "AUD_USD", "USD_JPY",
]
MIN_CONFIDENCE = 0.55
MAX_OPEN_POSITIONS = 2
DEAD_HOURS = (2, 5)


def pair_name(symbol: Column) -> Column:
    """``EURUSD`` or ``EURUSD.x`` to ``EUR_USD``; short names stay as they are."""
    return F.when(
        F.length(symbol) >= 6,
        F.concat_ws("_", F.substring(symbol, 1, 3), F.substring(symbol, 4, 3)),
    ).otherwise(symbol)


def broker_name(pair: Column) -> Column:
    return F.replace(pair, F.lit("_"), F.lit(""))


def is_allowed(symbol: Column, allowed: list[str] = ALLOWED) -> Column:
    """True if the bare symbol contains a listed name or is part of one."""
    bare = symbol
    for s in SUFFIXES:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    bare = F.upper(bare)
    names = F.array(*[F.lit(a) for a in allowed])
    return F.exists(names, lambda a: F.contains(bare, a) | F.contains(a, bare))


def resolve_alias(df: DataFrame, supported: list[str], symbol: str = "symbol") -> DataFrame:
    """Add ``model_pair``: the alias target or the symbol itself; null if not supported."""
    pairs = F.create_map(*[F.lit(x) for kv in SYMBOL_ALIASES.items() for x in kv])
    target = F.coalesce(F.try_element_at(pairs, F.col(symbol)), F.col(symbol))
    return df.withColumn("model_pair", F.when(target.isin(*supported), target))


def in_hours(hour: Column, start: int, end: int) -> Column:
    """Start included, end excluded, wrapping midnight when start lies after end."""
    if start <= end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def in_session(ts: Column, sessions: list[tuple[str, int, int]] = SESSIONS) -> Column:
    hour = F.hour(ts)
    out = F.lit(False)
    for _, start, end in sessions:
        out = out | in_hours(hour, start, end)
    return out


def session_names(ts: Column, sessions: list[tuple[str, int, int]] = SESSIONS) -> Column:
    hour = F.hour(ts)
    hits = [F.when(in_hours(hour, s, e), F.lit(n)) for n, s, e in sessions]
    return F.array_join(F.array_compact(F.array(*hits)), ",")


def outside_dead_hours(ts: Column) -> Column:
    return ~F.hour(ts).between(*DEAD_HOURS)


def closes_end_of_day(ts: Column) -> Column:
    return (F.hour(ts) == 23) & (F.minute(ts) >= 55)


def closes_at(ts: Column, hour: int, minute: int) -> Column:
    return (F.hour(ts) == hour) & (F.minute(ts) >= minute)


def mentions(text: Column, keywords: str) -> Column:
    """True if the text contains one of the comma or semicolon separated keywords."""
    words = F.filter(F.split(F.lit(keywords), "[,;]"), lambda k: F.length(F.trim(k)) > 0)
    return F.exists(words, lambda k: F.contains(text, F.trim(k)))
