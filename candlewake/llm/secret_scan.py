"""Secret scanning with one automaton for all rules.

A rule is a core and a class of characters that may follow it in any number. The
cores are compiled together into one transition table, and each text is run through
it once, byte by byte. Where a core ends, the automaton of its reversed strings
finds the leftmost start, and the match takes all characters of the class.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewake.llm.automaton import Automaton, compile_rules
from candlewake.llm.common import let


@dataclass(frozen=True)
class Rule:
    """A match is ``core`` and then all characters of the class ``tail``.

    ``group`` of a match, or all of it, must have ``least`` characters; shorter matches still use up their text.
    """

    kind: str
    core: str
    tail: str = ""
    least: int = 0
    group: int = 0


def any_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in text)


_NAMES = "|".join(any_case(n) for n in ("password", "passwd", "secret", "token", "api_?key"))
_VALUE = "[A-Za-z0-9+/_.=-]"
_ALNUM = "[A-Za-z0-9]"
_BASE64URL = "[A-Za-z0-9_-]"
_KEY = "[A-Z ]*PRIVATE KEY-----"
_USER = "[A-Za-z0-9_.!$%^*+~&=-]"
_PASSWORD = "[A-Za-z0-9_.!$%^*+~&=,;:'()-]"
_HOST = "[A-Za-z0-9.-]"

#: The kinds of the contract, in its order.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?({_VALUE})""", _VALUE, 12, 2),
    Rule("access", "AKIA[A-Z0-9]", "[A-Z0-9]", 18),
    Rule("hex", "[0-9a-f]{16}", "[0-9a-f]"),
)
#: Published token formats of common services, and keys inside texts.
MORE = (
    Rule("private_key", f"-----BEGIN {_KEY}"),
    Rule("github", f"gh[pousr]_{_ALNUM}", _ALNUM, 40),
    Rule("slack", f"xox[abprs]-{_ALNUM}", "[A-Za-z0-9-]", 15),
    Rule("google", f"AIza{_BASE64URL}", _BASE64URL, 39),
    Rule("stripe", f"[sr]k_live_{_ALNUM}", _ALNUM, 24),
    Rule("jwt", rf"eyJ{_BASE64URL}+\.eyJ", "[A-Za-z0-9_.-]", 30),
    Rule("bearer", rf"{any_case('bearer')}\x20+({_VALUE})", _VALUE, 20, 1),
    # The whole key up to its END line, as it is or as a string in code; no body holds two dashes in a row.
    Rule("private_key_block", rf"""-----BEGIN {_KEY}(-?[A-Za-z0-9+/=\x20\x09-\x0D\\:,"'])*-----END {_KEY}"""),
    Rule("url_login", rf"://{_USER}*:{_PASSWORD}+@{_HOST}", _HOST),
)
RULES = BASE + MORE

SPANS = "array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class _Compiled:
    forward: Automaton
    back: list[Automaton]
    tails: list[bytes]
    cores: list[re.Pattern]


@functools.lru_cache(maxsize=8)
def compiled_rules(rules: tuple[Rule, ...]) -> _Compiled:
    chars = [bytes(b for b in range(128) if r.tail and re.match(r.tail, chr(b))) for r in rules]
    return _Compiled(
        compile_rules([r.core for r in rules]),
        [compile_rules([r.core], search=False, backwards=True) for r in rules],
        chars,
        [re.compile(r.core.encode()) for r in rules],
    )


def _start(back: Automaton, data: bytes, end: int, floor: int) -> int:
    """The leftmost start, not before ``floor``, of a match that ends at ``end``; -1 if there is none."""
    s, found, table, masks, dead = back.start, -1, back.table, back.masks, back.dead
    for i in range(end - 1, floor - 1, -1):
        s = table[s + data[i]]
        if s == dead:
            break
        if s in masks:
            found = i
    return found


def find(text: bytes, rules: tuple[Rule, ...], compiled: _Compiled) -> list[tuple[int, int, int]]:
    """(start, end, index of the rule) of the matches in UTF-8 bytes, leftmost and apart for each rule.

    ``compiled`` comes from :func:`compiled_rules`; tasks get it from the driver.
    """
    table, s, accepting = compiled.forward.table, compiled.forward.start, compiled.forward.accepting
    hits = []
    for i, c in enumerate(text.translate(compiled.forward.classes)):
        s = table[s + c]
        if s >= accepting:
            hits.append((i + 1, s))
    found = []
    floors = [0] * len(rules)
    shifted: dict[int, bytes] = {}
    for core_end, s in hits:
        mask = compiled.forward.masks[s]
        for k, rule in enumerate(rules):
            if not mask >> k & 1 or core_end <= floors[k]:
                continue
            if k not in shifted:
                shifted[k] = text.translate(compiled.back[k].classes)
            if (start := _start(compiled.back[k], shifted[k], core_end, floors[k])) < 0:
                continue
            end, tail = core_end, compiled.tails[k]
            while end < len(text) and text[end] in tail:
                end += 1
            floors[k] = end
            first = compiled.cores[k].fullmatch(text, start, core_end).start(rule.group) if rule.group else start
            if end - first >= rule.least:
                found.append((start, end, k))
    return sorted(found, key=lambda m: (m[0], m[2]))


def spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The matches in a text as an array of (kind, start, end), by start, then by the order of the rules.

    Offsets are code points, the end exclusive. A null or empty text has none.
    """
    compiled = compiled_rules(rules)

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for data in texts.to_pylist():
            found = find(data, rules, compiled) if data else []
            if found and not data.isascii():
                points, at, n = {}, 0, 0
                for byte in sorted({x for m in found for x in m[:2]}):
                    n += len(data[at:byte].decode())
                    points[byte], at = n, byte
                found = [(points[a], points[b], k) for a, b, k in found]
            out.append([{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in found])
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.array(out, pa.list_(kind))

    return scan(text.cast("binary"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by ``[SECRET]``."""

    def step(a: Column, x: Column) -> Column:
        apart = x["start"] >= a["at"]
        gap = F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        return F.struct(
            F.when(apart, F.concat(a["out"], gap, F.lit("[SECRET]"))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], x["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    rest = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, rest)).otherwise(text)


def without_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows, their secrets replaced. Null texts stay null, other columns are left as they are."""
    marked = docs.withColumn("__spans", spans(F.col(text), rules))
    return marked.withColumn(text, let(F.col("__spans"), lambda s: redacted(F.col(text), s))).select(*docs.columns)
