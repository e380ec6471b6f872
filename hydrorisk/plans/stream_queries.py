"""Streaming operators run over the given tables until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrorisk.functions.scalars import local_day
from hydrorisk.plans.panel_queries import _ANTECEDENT, _ANTECEDENT_SQL
from hydrorisk.plans.register import TIE_FREE, query, scaled, scaled_list, scaled_sql
from hydrorisk.plans.stand_ins import STATION_SQL, station_panel
from hydrorisk.schemas import DATE, DIVISION, KEY, RAIN
from hydrorisk.session import settle, shared_path
from hydrorisk.sources.documents import hourly_to_daily
from hydrorisk.streaming.antecedent import stream_antecedent_rain
from hydrorisk.streaming.daily import stream_daily_means


def run_to_end(stream, name, path=None):
    """Write an appending stream to a table until no input is left; read it back.

    With ``path`` the run goes on where the last one on it ended.
    """
    spark = stream.sparkSession
    path = path or shared_path(spark, name)
    running = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}-progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(
    f"""WITH daily AS (
      SELECT CAST(user_id AS VARCHAR) AS division, CAST(ts AS DATE) AS date, AVG(value) AS value
      FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
    newest AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events WHERE value IS NOT NULL)
    SELECT division, date, CASE WHEN date + INTERVAL 1 DAY <= mark THEN 'closed' ELSE 'open' END AS part,
           {scaled_sql('value', factor=TIE_FREE)} FROM daily, newest"""
)
def streamed_daily_means(spark, sf_dir):
    """Days that the watermark has passed, from the stream; those still open, from the batch operator."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    division = F.col("user_id").cast("string").alias(DIVISION)
    readings = (
        spark.readStream.schema(events.schema)
        .parquet(f"{sf_dir}/events*.parquet")
        .select(division, "ts", "value")
    )
    closed = run_to_end(stream_daily_means(readings, ["value"], digits=None), "daily-stream")
    rows = events.select(division, local_day(F.col("ts").cast("string")).alias(DATE), "value")
    whole = hourly_to_daily(rows, ["value"], digits=None).select(closed.columns)
    opened = whole.join(closed, [DIVISION, DATE], "left_anti").withColumn("part", F.lit("open"))
    daily = closed.withColumn("part", F.lit("closed")).unionByName(opened)
    return daily.select(DIVISION, DATE, "part", scaled("value", factor=TIE_FREE))


@query(
    f"""WITH {STATION_SQL}, {_ANTECEDENT_SQL},
    placed AS (SELECT *, row_number() OVER (PARTITION BY division ORDER BY date DESC) AS back
               FROM antecedent)
    SELECT date, division, false AS late, {scaled_list(_ANTECEDENT)} FROM placed UNION ALL
    SELECT date, division, true, NULL, NULL, NULL FROM placed
    WHERE date < DATE '1995-06-01' AND back > 7"""
)
def streamed_antecedent_rain(spark, sf_dir):
    """Three deliveries in turn, then the oldest days once more, which no memory reaches."""
    path, out = shared_path(spark, "daily-actuals"), shared_path(spark, "antecedent-stream")
    actuals = settle(station_panel(spark, sf_dir).select(DIVISION, DATE, RAIN))
    bounds = ["1900-01-01", "1996-01-01", "1999-01-01", "2100-01-01"]
    day = F.col(DATE)
    deliveries = [(day >= a) & (day < b) for a, b in zip(bounds, bounds[1:], strict=False)]
    for delivery in [*deliveries, day < "1995-06-01"]:
        actuals.filter(delivery).write.mode("append").parquet(path)
        stream = spark.readStream.schema(actuals.schema).parquet(path)
        rows = run_to_end(stream_antecedent_rain(stream), "antecedent-stream", out)
    return rows.select(*KEY, "late", *[scaled(c) for c in _ANTECEDENT])
