"""First-order recursions with exact carry: nothing is copied, nothing is cut off.

``y[t] = beta * y[t-1] + u[t]`` is a chain of affine maps. The rows of a key are cut into
cells of equal length. A cell's own map sends the value before it to ``beta**rows`` times
that value plus what its rows add, and maps of neighbours compose to a map of the same
kind. So the values at the ends of the cells obey a recursion of their own, over a table
with one row for each cell, which is solved in the same way, in groups of ``GROUP`` cells,
until one group is left. Each row then takes its cell's running sum and the end value of
the cell before.

No task holds more of a key than a cell of rows or a group of cells, however many rows a
key has; the rows are shuffled once, on (key, cell). :mod:`~candlewake.operators.scan`
serves many short recursions in the blocks of the feature job. This module serves spans of
any length, and tables that go on from a stored state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewake.operators.blocks import IDX
from candlewake.operators.scan import Recursion, segment_rows_for
from candlewake.session import stage

#: Cells that one window takes, at most.
GROUP = 1024
CELL = "_cell"


def running(
    df: DataFrame,
    keys: list[str],
    recursions: list[Recursion],
    start: DataFrame | None = None,
    before: str | None = None,
    cell_rows: int | None = None,
    group: int = GROUP,
) -> DataFrame:
    """Add one column for each recursion: its value after the row, also while it is seeded.

    ``df`` has the position of each row in its key as ``_idx``, without gaps, and is read
    twice; give a table. ``before`` names a column with the position at which a key's rows
    in ``df`` begin (0 if there is none), and ``start`` holds one row for each key with the
    values after the row before that. A key that ``start`` lacks begins at zero. A null
    input counts as zero. An empty table gives an empty one.
    """
    size = cell_rows or segment_rows_for(*[r.beta for r in recursions])
    betas = sorted({r.beta for r in recursions})
    place = F.col(IDX) - (F.col(before) if before else 0)
    cut = df.withColumn(CELL, F.floor(place / size))
    at = (place % size).cast("double")

    ends = cut.groupBy(*keys, CELL).agg(
        *[F.sum(added(r) * F.pow(F.lit(r.beta), size - 1 - at)).alias(r.name) for r in recursions]
    )
    steps = {r.name: r.beta**size for r in recursions}
    ends = _solved(stage(ends, "cells"), keys, steps, group)
    # The end of a cell is what the next one begins with; a short last cell has no next one.
    begins = ends.select(*keys, (F.col(CELL) + 1).alias(CELL), *[F.col(r.name).alias(f"_in_{r.name}") for r in recursions])

    weight = {beta: f"_w{i}" for i, beta in enumerate(betas)}
    cell = Window.partitionBy(*keys, CELL).orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)
    weighed = cut.withColumns({weight[b]: F.pow(F.lit(b), at) for b in betas})
    local = weighed.withColumns(
        {f"_loc_{r.name}": F.sum(added(r) / F.col(weight[r.beta])).over(cell) * F.col(weight[r.beta]) for r in recursions}
    )
    out = local.join(begins, [*keys, CELL], "left")
    first = {r.name: F.lit(0.0) for r in recursions}
    if start is not None:
        out = out.join(start.select(*keys, *[F.col(r.name).alias(f"_from_{r.name}") for r in recursions]), keys, "left")
        # What was there before the first row fades with every row since.
        first = {
            r.name: F.coalesce(f"_from_{r.name}", F.lit(0.0)) * F.pow(F.lit(r.beta), (place + 1).cast("double"))
            for r in recursions
        }
    carried = {
        r.name: F.col(f"_loc_{r.name}")
        + F.coalesce(f"_in_{r.name}", F.lit(0.0)) * F.col(weight[r.beta]) * r.beta
        + first[r.name]
        for r in recursions
    }
    return out.select(*[F.col(c) for c in df.columns], *[carried[n].alias(n) for n in carried])


def added(r: Recursion) -> Column:
    """What a row adds. Seed rows are weighed so that the last of them completes the seed."""
    idx, x = F.col(IDX), F.coalesce(F.col(r.x).cast("double"), F.lit(0.0))
    seed = x * F.pow(F.lit(r.beta), (idx - r.seed_at).cast("double")) / r.seed_div
    return F.when(idx < r.first, 0.0).when(idx <= r.seed_at, seed).otherwise(x * r.gain)


def shown(df: DataFrame, recursions: list[Recursion]) -> DataFrame:
    """Null before the row from which a recursion is shown."""
    since = {r.name: r.seed_at if r.show_from is None else r.show_from for r in recursions}
    return df.withColumns({n: F.when(F.col(IDX) >= i, F.col(n)) for n, i in since.items()})


def _solved(cells: DataFrame, keys: list[str], steps: dict[str, float], group: int) -> DataFrame:
    """``e[c] = step * e[c-1] + x[c]`` over the cells of each key, for each named column.

    Inside a group of cells each pass doubles the number of cells that a value covers.
    """
    last = cells.agg(F.max(CELL)).first()[0]  # one number
    if not last:
        return cells
    grouped = cells.withColumn("_group", F.floor(F.col(CELL) / group))
    along = Window.partitionBy(*keys, "_group").orderBy(CELL)
    reach = 1
    while reach < min(group, last + 1):
        factors = {n: step**reach for n, step in steps.items()}
        grouped = grouped.withColumns(
            {n: F.col(n) + f * F.coalesce(F.lag(n, reach).over(along), F.lit(0.0)) for n, f in factors.items() if f > 0}
        )
        reach *= 2
    if last < group:
        return grouped.drop("_group")
    grouped = stage(grouped, "cell-groups")
    tops = grouped.where(F.col(CELL) % group == group - 1)
    tops = tops.select(*keys, F.col("_group").alias(CELL), *steps)
    tops = _solved(stage(tops, "cells"), keys, {n: s**group for n, s in steps.items()}, group)
    begins = tops.select(*keys, (F.col(CELL) + 1).alias("_group"), *[F.col(n).alias(f"_in_{n}") for n in steps])
    joined = grouped.join(begins, [*keys, "_group"], "left")
    fade = {n: F.pow(F.lit(s), (F.col(CELL) % group + 1).cast("double")) for n, s in steps.items()}
    return joined.select(
        *keys, CELL, *[(F.col(n) + F.coalesce(f"_in_{n}", F.lit(0.0)) * fade[n]).alias(n) for n in steps]
    )
