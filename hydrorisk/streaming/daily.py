"""Daily means of a stream of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrorisk.functions.scalars import round_decimal
from hydrorisk.schemas import DATE, DIVISION

_DAY_MICROS = 24 * 3600 * 1_000_000


def _as_utc(ts: Column) -> Column:
    """Local clock time as the instant when UTC shows the same clock, in any session zone."""
    local = ts.cast("timestamp_ntz")
    seconds = F.hour(local) * 3600 + F.minute(local) * 60
    return F.timestamp_micros(
        F.unix_date(F.to_date(local)).cast("bigint") * _DAY_MICROS
        + seconds.cast("bigint") * 1_000_000
        + (F.extract(F.lit("SECOND"), local) * 1_000_000).cast("bigint")
    )


def stream_daily_means(
    stream: DataFrame,
    measures: list[str],
    ts: str = "ts",
    delay: str = "1 day",
    digits: int | None = 4,
) -> DataFrame:
    """Mean per division and local day; a day is emitted once the watermark has passed it.

    Means have ``digits`` decimals, or all of them for None, like the batch operator's.

    ``ts`` is local clock time. Readings later than ``delay`` behind the newest
    one are dropped, as a watermark implies.
    """
    def mean(measure: str) -> Column:
        value = F.avg(measure)
        return value if digits is None else round_decimal(value, digits)

    present = stream.withColumn(ts, _as_utc(F.col(ts))).filter(
        F.coalesce(*measures).isNotNull()
    )
    day = F.floor(F.unix_seconds("_day.start") / F.lit(24 * 3600)).cast("int")
    return (
        present.withWatermark(ts, delay)
        .groupBy(DIVISION, F.window(ts, "1 day").alias("_day"))
        .agg(*[mean(m).alias(m) for m in measures])
        .select(DIVISION, F.date_from_unix_date(day).alias(DATE), *measures)
    )
