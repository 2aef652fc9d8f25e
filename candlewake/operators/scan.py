"""First-order recursions (EMA, Wilder smoothing) on ordinary window sums.

``y[t] = beta * y[t-1] + gain * x[t]`` has no window function, but inside a short
segment it is a running sum: with ``k`` the position in the segment,
``y = beta**k * sum(gain * x[j] * beta**-j)`` plus ``beta**(k+1)`` times the end
value of the segment before. The end values of earlier segments are read with a
RANGE frame on the segment number, so everything happens in the sort order of
:class:`~candlewake.operators.blocks.Blocks`: no join, no Python.

A value ``n`` rows back has weight ``beta**n``. Blocks copy so many earlier rows
that the weight of whatever they do not see is below ``NEGLIGIBLE``, fourteen
orders of magnitude finer than the last bit of a double.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from candlewake.operators.blocks import IDX, SEGMENT_ROWS, Blocks

NEGLIGIBLE = 1e-30


@dataclass(frozen=True)
class Recursion:
    """One smoothed series.

    The value at position ``first + seed_rows - 1`` is the sum of the seed rows over
    ``seed_div``; before it the output is null.
    """

    name: str
    x: str
    beta: float
    gain: float
    first: int = 0
    seed_rows: int = 1
    seed_div: float = 1.0
    show_from: int | None = None

    @property
    def seed_at(self) -> int:
        return self.first + self.seed_rows - 1


def ema(name: str, x: str, n: int, first: int = 0, show_from: int | None = None) -> Recursion:
    """Exponential average, seeded with the plain average of the first ``n`` values."""
    alpha = 2.0 / (n + 1)
    return Recursion(name, x, 1 - alpha, alpha, first, n, float(n), show_from)


def ema_unseeded(name: str, x: str, n: int) -> Recursion:
    """Exponential average that starts from the first value, without a warm-up."""
    alpha = 2.0 / (n + 1)
    return Recursion(name, x, 1 - alpha, alpha)


def wilder(name: str, x: str, n: int, first: int = 1, show_from: int | None = None) -> Recursion:
    """Wilder average, seeded with the plain average of ``n`` values from ``first``."""
    return Recursion(name, x, 1 - 1.0 / n, 1.0 / n, first, n, float(n), show_from)


def wilder_sum(name: str, x: str, n: int, show_from: int) -> Recursion:
    """Wilder running sum, seeded with the sum of the first ``n - 1`` moves."""
    return Recursion(name, x, 1 - 1.0 / n, 1.0, 1, n - 1, 1.0, show_from)


def reach(*betas: float) -> int:
    """Rows of history that a chain of recursions needs, one after the other."""
    return sum(math.ceil(math.log(NEGLIGIBLE) / math.log(b)) for b in betas)


def segment_rows_for(*betas: float) -> int:
    """Longest power-of-two segment whose growing weights stay inside a double."""
    rows = SEGMENT_ROWS
    while rows * -math.log(min(betas)) > 460:
        rows //= 2
    return rows


def apply(blocks: Blocks, recursions: list[Recursion]) -> Blocks:
    """Add one column per recursion; recursions of one call share their windows."""
    size = blocks.segment_rows
    betas = sorted({r.beta for r in recursions})
    weight = {beta: f"_w{i}" for i, beta in enumerate(betas)}
    position = f"CAST({IDX} % {size} AS DOUBLE)"
    blocks = blocks.add_sql(
        {weight[beta]: f"power({number(beta)}, {position})" for beta in betas}
    )

    def term(r: Recursion) -> str:
        if r.seed_at >= size:
            raise ValueError(f"{r.name}: seed of {r.seed_at + 1} rows exceeds a segment")
        seed_weight = r.beta**-r.seed_at / r.seed_div
        return (
            f"CASE WHEN {IDX} < {r.first} THEN NULL "
            f"WHEN {IDX} <= {r.seed_at} THEN `{r.x}` * {number(seed_weight)} "
            f"ELSE `{r.x}` * {number(r.gain)} / {weight[r.beta]} END"
        )

    blocks = blocks.add_sql(
        {
            f"_loc_{r.name}": f"sum({term(r)}) {blocks.over_segment} * {weight[r.beta]}"
            for r in recursions
        }
    )

    def carry(r: Recursion) -> str:
        terms = max(1, math.ceil(math.log(NEGLIGIBLE) / (size * math.log(r.beta))))
        end = f"CASE WHEN {IDX} % {size} = {size - 1} THEN `_loc_{r.name}` END"
        return " + ".join(
            f"coalesce(sum({end}) {blocks.over_segment_before(j)}, 0D) "
            f"* {number(r.beta ** (size * (j - 1) + 1))}"
            for j in range(1, terms + 1)
        )

    out = {}
    for r in recursions:
        show = r.seed_at if r.show_from is None else r.show_from
        value = f"`_loc_{r.name}` + ({carry(r)}) * {weight[r.beta]}"
        out[r.name] = f"CASE WHEN {IDX} >= {show} THEN {value} END"
    used = [*weight.values(), *[f"_loc_{r.name}" for r in recursions]]
    return blocks.add_sql(out, drop=used)


def number(x: float) -> str:
    """A double literal with all its digits."""
    return f"{x!r}D"


__all__ = [
    "Recursion",
    "apply",
    "ema",
    "ema_unseeded",
    "number",
    "reach",
    "segment_rows_for",
    "wilder",
    "wilder_sum",
]
