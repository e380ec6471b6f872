"""Daily means of a stream of readings, with an account of every reading delivered.

A sink for ``foreachBatch``. Each micro-batch is split by the watermark of the batches before it:

* ``dropped``: readings of days that the watermark had passed, as rows of their own;
* repeats: readings whose key was delivered before, in this batch or in an earlier one;
* the rest joins the open days. Days that the watermark has now passed are closed: their
  means are final. The others stay open.

So for every division and day: delivered = readings of closed and open days + their repeats +
dropped. Open days are kept as partial sums and counts per division and day, not as
readings; of readings only the keys of open days are remembered. Work per batch grows with
the batch and the open days, never with history, and every step is a map-side combined
aggregate or a join by key, so a division that sends a third of all readings is no one task's.

All parts of a batch are one attempt of a committed landing: a batch that is killed is repeated
whole and shows nothing before its commit, which also carries the watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrorisk.functions.scalars import round_decimal
from hydrorisk.schemas import DATE, DIVISION, KEY
from hydrorisk.sources.committed import commit, current_commits, last_commit, read_committed, write_attempt

TASK = "readings"
CLOSED, OPEN, SEEN, DROPPED = "closed", "open", "seen", "dropped"


def _day_end(day: Column) -> Column:
    """Seconds on the local clock at which a day is over."""
    return (F.unix_date(day) + 1).cast("bigint") * 86_400


def _clock(ts: Column) -> Column:
    """Seconds on the local clock."""
    local = ts.cast("timestamp_ntz")
    return (
        F.unix_date(F.to_date(local)).cast("bigint") * 86_400
        + F.hour(local) * 3600
        + F.minute(local) * 60
        + F.floor(F.extract(F.lit("SECOND"), local)).cast("bigint")
    )


def _sums_schema(measures: list[str]) -> T.StructType:
    fields = [T.StructField(DIVISION, T.StringType()), T.StructField(DATE, T.DateType())]
    for m in measures:
        fields += [T.StructField(f"{m}_sum", T.DoubleType()), T.StructField(f"{m}_n", T.LongType())]
    return T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("readings", "repeated")]])


class DailyReadings:
    """The parts of one stream of readings, stored under ``path``.

    ``measures`` are averaged; ``key`` names the columns that tell readings apart, besides the
    division (by default the clock time); ``delay`` seconds is how far the watermark stays
    behind the newest reading. Readings without any measure count nowhere. A division may be NULL.
    Of readings with one key in a batch the one with the least measures counts.
    """

    def __init__(
        self,
        path: str,
        measures: list[str],
        ts: str = "ts",
        key: list[str] | None = None,
        delay: int = 86_400,
        digits: int | None = 4,
    ):
        self.path, self.measures, self.ts, self.delay, self.digits = path, measures, ts, delay, digits
        self.key = [DIVISION, *(key or [ts])]
        self._sums = _sums_schema(measures)

    def sink(self) -> Callable[[DataFrame, int], None]:
        return self._take

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name, attempt = f"{batch_id:018d}", uuid.uuid4().hex
        previous = last_commit(spark, self.path, TASK, before=name)
        passed = int(previous["note"]) if previous and previous["note"] else None
        columns = list(dict.fromkeys([*self.key, self.ts, *self.measures]))
        readings = (
            batch.select(*columns)
            .filter(F.coalesce(*self.measures).isNotNull())
            .withColumns({DATE: F.to_date(F.col(self.ts).cast("timestamp_ntz")), "_clock": _clock(F.col(self.ts))})
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        try:
            newest = readings.agg(F.max("_clock")).first()[0]
            known = [t for t in (passed, None if newest is None else newest - self.delay) if t is not None]
            watermark = max(known, default=None)
            self._write_parts(readings, previous, passed, watermark, name, attempt)
        finally:
            readings.unpersist()
        note = None if watermark is None else str(watermark)
        commit(spark, self.path, TASK, [name], attempt, note)

    def _write_parts(self, readings, previous, passed, watermark, name, attempt) -> None:
        spark = readings.sparkSession

        def write(df: DataFrame, table: str) -> None:
            write_attempt(df, self.path, TASK, name, attempt, table)

        end = _day_end(F.col(DATE))
        # A row without a day is never late, never closed.
        late = F.lit(False) if passed is None else F.coalesce(end <= passed, F.lit(False))
        over = F.lit(False) if watermark is None else F.coalesce(end <= watermark, F.lit(False))
        write(readings.filter(late).drop("_clock"), DROPPED)

        values = F.struct(DATE, *self.measures)
        unique = (
            readings.filter(~late)
            .groupBy(*self.key)
            .agg(F.min(values).alias("_v"), F.count(F.lit(1)).alias("_times"))
            .select(*self.key, "_v.*", "_times")
        )
        held_sums = held_keys = None
        if previous is not None:
            before = [previous["batch"]]
            held_sums = read_committed(spark, self.path, self._sums, TASK, before, OPEN)
            held_keys = read_committed(spark, self.path, self._seen_schema(unique), TASK, before, SEEN)
            old = held_keys.select(*[F.col(k).alias(f"_{k}") for k in self.key], F.lit(1).alias("_old"))
            same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key])
            unique = unique.join(old, same, "left").drop(*[f"_{k}" for k in self.key])
        else:
            unique = unique.withColumn("_old", F.lit(None).cast("int"))
        fresh = F.col("_old").isNull()
        unique = unique.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sums = unique.groupBy(*KEY).agg(*self._partial_sums(fresh))
            if held_sums is not None:
                sums = sums.unionByName(held_sums)
            totals = sums.groupBy(*KEY).agg(
                *[F.sum(c).alias(c) for c in self._sums.fieldNames() if c not in KEY]
            )
            totals = totals.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                write(self._means(totals.filter(over)), CLOSED)
                write(totals.filter(~over), OPEN)
            finally:
                totals.unpersist()
            keys = unique.filter(fresh & ~over).select(*self.key, DATE)
            if held_keys is not None:
                keys = keys.unionByName(held_keys.filter(~over).select(*self.key, DATE))
            write(keys, SEEN)
        finally:
            unique.unpersist()

    def _seen_schema(self, readings: DataFrame) -> T.StructType:
        return readings.select(*self.key, DATE).schema

    def _partial_sums(self, fresh: Column) -> list[Column]:
        parts = []
        for m in self.measures:
            value = F.when(fresh, F.col(m).cast("double"))
            parts += [F.sum(value).alias(f"{m}_sum"), F.count(value).alias(f"{m}_n")]
        readings = F.count(F.when(fresh, F.lit(1)))
        return [*parts, readings.alias("readings"), (F.sum("_times") - readings).alias("repeated")]

    def _means(self, totals: DataFrame) -> DataFrame:
        means = []
        for m in self.measures:
            mean = F.try_divide(f"{m}_sum", F.col(f"{m}_n").cast("double"))
            means.append((mean if self.digits is None else round_decimal(mean, self.digits)).alias(m))
        return totals.select(*KEY, *means, "readings", "repeated")

    def closed(self, spark: SparkSession) -> DataFrame:
        """Final means per division and day, with the readings and repeats behind them."""
        schema = self._means(spark.createDataFrame([], self._sums)).schema
        return read_committed(spark, self.path, schema, TASK, table=CLOSED)

    def open(self, spark: SparkSession) -> DataFrame:
        """The same of the days that are still open, as of the last batch."""
        last = last_commit(spark, self.path, TASK)
        batches = [last["batch"]] if last else []
        return self._means(read_committed(spark, self.path, self._sums, TASK, batches, OPEN))

    def dropped(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """Readings that came after the watermark had passed their day; ``schema`` is the stream's."""
        columns = list(dict.fromkeys([*self.key, self.ts, *self.measures]))
        own = T.StructType([*[schema[c] for c in columns], T.StructField(DATE, T.DateType())])
        return read_committed(spark, self.path, own, TASK, table=DROPPED)

    def batches(self, spark: SparkSession) -> DataFrame:
        """Committed batches with the watermark (seconds on the local clock) each left behind."""
        return current_commits(spark, self.path, TASK).select(
            F.col("batch").cast("bigint").alias("batch"), F.col("note").cast("bigint").alias("watermark")
        )
