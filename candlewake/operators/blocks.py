"""Row-positional windows that no single task has to hold.

A window over ``partitionBy(symbol)`` sends a whole symbol to one task, which fails
once one symbol holds a large share of the table. The functions here give each row
its position inside its key and cut every key into blocks of equal length. A block
also receives copies of the last rows of the block before it (and of the first rows
of the block after it), so ``lag``, ``lead`` and trailing frames see the same
neighbours as they would in the uncut key. Copies are dropped at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 32768
SEGMENT_ROWS = 2048

IDX, BLK, SEG, OWN = "_idx", "_blk", "_seg", "_own"


def day_of(ts: str | Column) -> Column:
    return F.to_date(ts)


def with_row_index(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    bucket: Column,
    idx: str = IDX,
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its key, by ``order``.

    ``bucket`` must not decrease along ``order`` (a day, an hour). Rows are counted
    per bucket, the counts are summed along the key, and rows are numbered inside
    their bucket only. The table that is ordered per key has one row per bucket, so
    it grows with the calendar and not with the data. Rows without a time or key have no
    position and drop out; split them off before (``quality.split_required``).
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_key_rows"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = tagged.join(starts, [*keys, "_bucket"]).withColumn(
        idx, F.col("_start") + F.row_number().over(inside) - 1
    )
    if total:
        out = out.withColumn(total, F.col("_key_rows"))
    return out.drop("_bucket", "_start", "_key_rows")


@dataclass(frozen=True)
class Blocks:
    """A table cut into blocks, with the window specs that fit its layout.

    All three specs are served by one shuffle on (keys, block) and one sort on
    (keys, block, segment, position).
    """

    df: DataFrame
    keys: tuple[str, ...]
    block_rows: int
    segment_rows: int
    back: int

    @property
    def rows(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLK).orderBy(SEG, IDX)

    @property
    def segment(self) -> WindowSpec:
        return (
            Window.partitionBy(*self.keys, BLK, SEG)
            .orderBy(IDX)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )

    def segments_before(self, n: int) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLK).orderBy(SEG).rangeBetween(-n, -n)

    def last(self, n: int) -> WindowSpec:
        return self.rows.rowsBetween(-(n - 1), 0)

    # The same windows as SQL text. A wide job is built from text, since every Column
    # call is a round trip to the JVM.

    @property
    def _parts(self) -> str:
        return ", ".join([*(f"`{k}`" for k in self.keys), BLK])

    @property
    def over_rows(self) -> str:
        return f"OVER (PARTITION BY {self._parts} ORDER BY {SEG}, {IDX})"

    @property
    def over_segment(self) -> str:
        return (
            f"OVER (PARTITION BY {self._parts}, {SEG} ORDER BY {IDX} "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        )

    def over_segment_before(self, n: int) -> str:
        return (
            f"OVER (PARTITION BY {self._parts} ORDER BY {SEG} "
            f"RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)"
        )

    def over_last(self, n: int) -> str:
        return (
            f"OVER (PARTITION BY {self._parts} ORDER BY {SEG}, {IDX} "
            f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        )

    def add_sql(self, cols: dict[str, str], drop: list[str] | None = None) -> "Blocks":
        """Add columns given as SQL text; ``drop`` leaves out columns that are used up."""
        kept = ["*"] if not drop else [f"`{n}`" for n in self.df.columns if n not in drop]
        return self.with_df(self.df.selectExpr(*kept, *[f"{e} AS `{n}`" for n, e in cols.items()]))

    def with_df(self, df: DataFrame) -> "Blocks":
        return Blocks(df, self.keys, self.block_rows, self.segment_rows, self.back)

    def add(self, cols: dict[str, Column]) -> "Blocks":
        return self.with_df(self.df.withColumns(cols))

    def close(self, keep_index: bool = False) -> DataFrame:
        """Drop the copies and the helper columns."""
        own = self.df.where(F.col(OWN))
        return own.drop(BLK, SEG, OWN) if keep_index else own.drop(BLK, SEG, OWN, IDX)


def cut(
    df: DataFrame,
    keys: list[str],
    back: int,
    ahead: int = 0,
    block_rows: int = BLOCK_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> Blocks:
    """Cut an indexed table into blocks whose rows see ``back`` rows before and ``ahead`` after.

    The block grows when the reach asks for it, so a row is copied at most twice.
    """
    block_rows = max(block_rows, back, ahead)
    block_rows = -(-block_rows // segment_rows) * segment_rows
    home = F.floor(F.col(IDX) / block_rows)
    pos = F.col(IDX) % block_rows
    targets = [home]
    if back:
        targets.append(F.when(pos >= block_rows - back, home + 1))
    if ahead:
        targets.append(F.when((pos < ahead) & (home > 0), home - 1))
    copied = (
        df.withColumn(BLK, F.explode(F.array_compact(F.array(*targets))))
        .withColumn(SEG, F.floor(F.col(IDX) / segment_rows))
        .withColumn(OWN, F.col(BLK) == home)
    )
    return Blocks(copied, tuple(keys), block_rows, segment_rows, back)


def indexed_blocks(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    bucket: Column,
    back: int,
    ahead: int = 0,
    block_rows: int = BLOCK_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> Blocks:
    return cut(
        with_row_index(df, keys, order, bucket), keys, back, ahead, block_rows, segment_rows
    )
