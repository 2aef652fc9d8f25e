"""Live scoring that carries the state of its recursions instead of a history.

Between two micro-batches each symbol keeps one row (how many bars it has had, the time of
the last, the end value of each recursion) and its last bars, as many as the frames reach
back. A batch reads its own bars and that state, so its cost does not depend on how many
batches or bars there were before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampType

from candlewake.operators import carry
from candlewake.operators.blocks import IDX, Blocks, cut, day_of, with_row_index
from candlewake.operators.scan import Recursion
from candlewake.session import discard, fresh_path, scratch

BEFORE, LAST = "_before", "_last"


@dataclass(frozen=True)
class Scoring:
    """What a batch works out for its bars.

    ``inputs`` adds to the blocks what the recursions read and the frames give; it sees
    ``frame`` bars before each bar. ``outputs`` are SQL texts over those columns and over
    the recursions, which are null until they are seeded.
    """

    inputs: Callable[[Blocks], Blocks]
    recursions: list[Recursion]
    outputs: dict[str, str]
    frame: int
    key: str = "symbol"
    ts: str = "ts"


@dataclass(frozen=True)
class Carried:
    """The folders of a stream: scored bars, bars that came too late, and the state.

    Scored and late bars have one folder for each batch, the state those of the last two.
    A batch that is run again reads the state before it and replaces only its own folders.
    """

    scoring: Scoring
    bars: StructType
    out: str
    late: str
    ends: str
    tail: str

    @property
    def ends_schema(self) -> StructType:
        s = self.scoring
        values = [StructField(r.name, DoubleType()) for r in s.recursions]
        return StructType([self.bars[s.key], StructField(BEFORE, LongType()), StructField(LAST, TimestampType()), *values])

    @property
    def tail_schema(self) -> StructType:
        return StructType([*self.bars, StructField(IDX, LongType())])

    def begin(self, history: DataFrame) -> None:
        """Take up the bars before the stream; without any, give an empty table."""
        spark = history.sparkSession
        none = Carried(self.scoring, self.bars, fresh_path(spark, "begun"), fresh_path(spark, "begun-late"), self.ends, self.tail)
        spark.createDataFrame([], self.ends_schema).write.mode("overwrite").parquet(self._at(self.ends, -2))
        spark.createDataFrame([], self.tail_schema).write.mode("overwrite").parquet(self._at(self.tail, -2))
        none(history, -1)
        discard(spark, none.out, none.late)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Score the bars of a batch; the function for ``foreachBatch``.

        Of bars with one symbol and time the greatest row counts. A bar that is not after
        its symbol's last one cannot change what is carried: it goes to the late bars and
        is not scored. Bars without symbol or time are late as well.
        """
        spark = batch.sparkSession
        held: list[DataFrame] = []
        try:
            with scratch(spark):
                self._run(spark, batch, batch_id, held)
        finally:
            # What is lost with an executor meanwhile is worked out again from batch and state.
            for df in held:
                df.unpersist()
        for folder in (self.ends, self.tail):
            if batch_id >= 0:
                discard(spark, self._at(folder, batch_id - 2))

    def _run(self, spark: SparkSession, batch: DataFrame, batch_id: int, held: list[DataFrame]) -> None:
        s, names = self.scoring, self.bars.names
        ends = spark.read.schema(self.ends_schema).parquet(self._at(self.ends, batch_id - 1))
        tail = spark.read.schema(self.tail_schema).parquet(self._at(self.tail, batch_id - 1))

        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        row = F.struct(*names)
        came = batch.select(*names).groupBy(s.key, s.ts).agg(F.max(row).alias("_row")).select("_row.*")
        came = hold(came.join(ends.select(s.key, BEFORE, LAST), s.key, "left"))
        after = F.col(s.ts).isNotNull() & F.col(s.key).isNotNull() & (F.col(LAST).isNull() | (F.col(s.ts) > F.col(LAST)))
        came.where(~after).select(*names).write.mode("overwrite").parquet(self._at(self.late, batch_id))

        begun = F.coalesce(BEFORE, F.lit(0))
        new = with_row_index(came.where(after), [s.key], [s.ts], day_of(s.ts))
        new = hold(new.withColumns({BEFORE: begun, IDX: F.col(IDX) + begun, "_new": F.lit(True)}).drop(LAST))
        touched = new.groupBy(s.key).agg((F.max(IDX) + 1).alias("_rows"))
        placed = tail.join(touched, s.key, "left")
        # The carried bars come before the new ones without a gap, so frames run over both.
        near = placed.where(F.col("_rows").isNotNull()).drop("_rows")
        together = new.unionByName(near.withColumns({BEFORE: F.lit(0).cast("long"), "_new": F.lit(False)}))
        wide = s.inputs(cut(together, [s.key], s.frame)).close(keep_index=True)
        wide = hold(wide.where("_new").drop("_new"))

        valued = hold(carry.running(wide, [s.key], s.recursions, ends, BEFORE))
        scored = carry.shown(valued, s.recursions)
        scored = scored.select(s.key, s.ts, *[F.expr(e).alias(n) for n, e in s.outputs.items()])
        scored.write.mode("overwrite").parquet(self._at(self.out, batch_id))

        end = F.struct((F.col(IDX) + 1).alias(BEFORE), F.col(s.ts).alias(LAST), *[r.name for r in s.recursions])
        last = valued.groupBy(s.key).agg(F.max_by(end, IDX).alias("_end")).select(s.key, "_end.*")
        untouched = ends.join(touched, s.key, "left_anti")
        untouched.unionByName(last).write.mode("overwrite").parquet(self._at(self.ends, batch_id))
        kept = placed.unionByName(new.select(*names, IDX).join(touched, s.key))
        kept = kept.where(F.col("_rows").isNull() | (F.col(IDX) >= F.col("_rows") - s.frame))
        kept.drop("_rows").write.mode("overwrite").parquet(self._at(self.tail, batch_id))

    @staticmethod
    def _at(folder: str, batch_id: int) -> str:
        return f"{folder}/batch={batch_id}"

    def scores(self, spark: SparkSession, schema: str) -> DataFrame:
        """All scored bars; ``schema`` names key, time and outputs."""
        return spark.read.schema(schema).parquet(self.out).drop("batch")


def carried_scores(spark: SparkSession, scoring: Scoring, bars: StructType, name: str) -> Carried:
    """A stream's folders in the shared folder."""
    places = [fresh_path(spark, f"{name}-{part}") for part in ("scores", "late", "ends", "tail")]
    return Carried(scoring, bars, *places)
