"""Queries over data that arrives in deliveries: committed landing, accounted readings."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from hydrorisk.operators import baseline
from hydrorisk.operators.upkeep import FeatureStore
from hydrorisk.plans import spi_sql as sql
from hydrorisk.plans.panel_queries import _ANTECEDENT, _ANTECEDENT_SQL, _LONG, _LONG_SQL
from hydrorisk.plans.register import TIE_FREE, query, scaled, scaled_list, scaled_sql
from hydrorisk.plans.stand_ins import NATION_RAIN_SQL, STATION_SQL, nation_rain, station_panel
from hydrorisk.plans.stream_queries import run_to_end
from hydrorisk.schemas import DATE, DIVISION, KEY, RAIN, measurement_schema
from hydrorisk.session import settle, shared_path
from hydrorisk.sources import committed
from hydrorisk.streaming.corrections import (
    REDO,
    REMEMBERED,
    merged_rain,
    rocksdb_state,
    stream_corrected_rain,
)
from hydrorisk.streaming.readings import DailyReadings


def consume(spark, source, schema, sink, path):
    """Give what is new in a folder to a ``foreachBatch`` sink, from where the last run on ``path`` ended."""
    running = (
        spark.readStream.schema(schema)
        .parquet(source)
        .writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{path}-progress")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()


@query(
    f"""WITH {NATION_RAIN_SQL}
    SELECT division, 'rain' AS task, COUNT(*) AS days, {scaled_sql("SUM(rain_sum)", "rain_sum", 3)},
           COUNT(*) FILTER (date < DATE '1995-01-01') AS days_before_resuming
    FROM rain GROUP BY division"""
)
def committed_stream_landing(spark, sf_dir):
    """Two deliveries landed by a stream that is killed between write and commit, and resumed."""
    schema = measurement_schema([RAIN])
    source, path = shared_path(spark, "deliveries"), shared_path(spark, "committed")
    rain = settle(nation_rain(spark, sf_dir), "rain").select(*schema.fieldNames())
    sink = committed.landing_sink(path, "rain")

    def killed(rows, batch_id):
        committed.write_attempt(rows, path, "rain", f"{batch_id:018d}", uuid.uuid4().hex)
        raise RuntimeError("killed before the commit")

    rain.filter(F.col(DATE) < "1995-01-01").write.mode("append").parquet(source)
    consume(spark, source, schema, sink, path)
    rain.filter(F.col(DATE) >= "1995-01-01").write.mode("append").parquet(source)
    try:
        consume(spark, source, schema, killed, path)
    except StreamingQueryException as stopped:
        if "killed before the commit" not in str(stopped):
            raise
    early = committed.read_committed(spark, path, schema, "rain")
    early = early.groupBy(F.col(DIVISION).alias("_d")).agg(F.count(F.lit(1)).alias("days_before_resuming"))
    consume(spark, source, schema, sink, path)
    landed = committed.read_committed(spark, path, schema, "rain").groupBy(DIVISION)
    days = landed.agg(F.count(F.lit(1)).alias("days"), scaled(F.sum(RAIN), 3, RAIN))
    marked = days.join(committed.committed_manifest(spark, path), DIVISION)
    return marked.join(early, F.col(DIVISION) == F.col("_d"), "left").select(
        DIVISION, "task", "days", RAIN, F.coalesce("days_before_resuming", F.lit(0)).alias("days_before_resuming")
    )


_CUTS = ["1900-01-01", "1993-07-01", "1995-01-01", "1996-07-01", "2100-01-01"]


@query(
    f"""WITH {NATION_RAIN_SQL},
    doubled AS (SELECT *, CASE WHEN date >= DATE '1995-01-01' AND date < DATE '1996-07-01' THEN 2 ELSE 1 END
                       AS factor FROM rain)
    SELECT division, 'open reader' AS reader, COUNT(*) AS days, {scaled_sql("SUM(rain_sum)", "rain_sum", 3)},
           4 AS batches, 4 AS attempts FROM rain GROUP BY division UNION ALL
    SELECT division, 'after', COUNT(*), {scaled_sql("SUM(rain_sum * factor)", "rain_sum", 3)}, 4, 2
    FROM doubled GROUP BY division"""
)
def compacted_landing(spark, sf_dir):
    """Four batches, read by a reader opened before they are compacted; then one lands again corrected."""
    schema = measurement_schema([RAIN])
    path = shared_path(spark, "compacted")
    rain = settle(nation_rain(spark, sf_dir), "rain").select(*schema.fieldNames())
    for batch, (low, high) in enumerate(zip(_CUTS, _CUTS[1:], strict=False)):
        part = rain.filter((F.col(DATE) >= low) & (F.col(DATE) < high))
        committed.land_committed(part, path, "rain", f"{batch}")

    def totals(reader):
        rows = committed.read_committed(spark, path, schema, "rain")
        counts = committed.current_commits(spark, path, "rain").agg(
            F.count(F.lit(1)).cast("int").alias("batches"), F.countDistinct("attempt").cast("int").alias("attempts")
        )
        counted = spark.createDataFrame(counts.collect(), counts.schema)
        days = rows.groupBy(DIVISION).agg(F.count(F.lit(1)).alias("days"), scaled(F.sum(RAIN), 3, RAIN))
        return days.withColumn("reader", F.lit(reader)).join(counted, F.lit(True))

    opened = totals("open reader")
    committed.compact(spark, path, schema, "rain")
    again = rain.filter((F.col(DATE) >= _CUTS[2]) & (F.col(DATE) < _CUTS[3]))
    committed.land_committed(again.withColumn(RAIN, F.col(RAIN) * 2), path, "rain", "2")
    return opened.unionByName(totals("after"))


# Three deliveries by time; every 50th reading comes a delivery late, every 20th comes twice.
_DELIVERED_SQL = """
spans AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1
                         ELSE 2 END AS turn
          FROM events WHERE value IS NOT NULL),
delivered AS (
  SELECT user_id, ts, event_id, value, CASE WHEN event_id % 50 = 0 AND turn < 2 THEN turn + 1 ELSE turn END AS turn
  FROM spans UNION ALL
  SELECT user_id, ts, event_id, value, turn + 1 FROM spans WHERE event_id % 20 = 1 AND turn < 2),
marks AS (SELECT turn, epoch(max(ts)) - 86400 AS seen FROM delivered GROUP BY turn),
passed AS (
  SELECT t.turn, (SELECT max(seen) FROM marks m WHERE m.turn < t.turn) AS before,
         (SELECT max(seen) FROM marks) AS last FROM (SELECT DISTINCT turn FROM delivered) t),
judged AS (
  SELECT *, CAST(ts AS DATE) AS date, epoch(CAST(ts AS DATE) + INTERVAL 1 DAY) AS ends,
         coalesce(epoch(CAST(ts AS DATE) + INTERVAL 1 DAY) <= before, false) AS late
  FROM delivered JOIN passed USING (turn)),
taken AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY turn) > 1 AS again
  FROM judged WHERE NOT late)"""


@query(
    f"""WITH {_DELIVERED_SQL}
    SELECT CAST(user_id AS VARCHAR) AS division, date, CASE WHEN ends <= last THEN 'closed' ELSE 'open' END AS part,
           COUNT(*) FILTER (NOT again) AS readings, COUNT(*) FILTER (again) AS repeated,
           {scaled_sql("AVG(value) FILTER (NOT again)", "value", factor=TIE_FREE)}
    FROM taken GROUP BY 1, 2, 3 UNION ALL
    SELECT CAST(user_id AS VARCHAR), date, 'dropped', COUNT(*), 0, NULL FROM judged WHERE late GROUP BY 1, 2"""
)
def accounted_readings(spark, sf_dir):
    """Every reading of three deliveries, some late and some repeated: in a closed or an open day, or dropped."""
    source, path = shared_path(spark, "readings"), shared_path(spark, "daily-parts")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias(DIVISION), "ts", "event_id", "value"
    )
    turn = F.when(F.col("ts") < "2024-01-11", 0).when(F.col("ts") < "2024-01-21", 1).otherwise(2)
    spans = settle(events.withColumn("turn", turn), "spans")
    late, twice = F.col("event_id") % 50 == 0, (F.col("event_id") % 20 == 1) & (F.col("turn") < 2)
    own = spans.withColumn("turn", F.least(F.col("turn") + late.cast("int"), F.lit(2)))
    delivered = own.unionByName(spans.filter(twice).withColumn("turn", F.col("turn") + 1))
    parts = DailyReadings(path, ["value"], key=["event_id"], digits=None)
    for number in range(3):
        delivered.filter(F.col("turn") == number).drop("turn").write.mode("append").parquet(source)
        consume(spark, source, events.schema, parts.sink(), path)
    value = scaled("value", factor=TIE_FREE)
    sums = [
        df.select(*KEY, F.lit(part).alias("part"), "readings", "repeated", value)
        for part, df in (("closed", parts.closed(spark)), ("open", parts.open(spark)))
    ]
    dropped = parts.dropped(spark, events.schema).groupBy(*KEY).agg(F.count(F.lit(1)).alias("readings"))
    rest = dropped.select(
        *KEY,
        F.lit("dropped").alias("part"),
        "readings",
        F.lit(0).cast("bigint").alias("repeated"),
        F.lit(None).cast("bigint").alias("value"),
    )
    return sums[0].unionByName(sums[1]).unionByName(rest)


# Every fifth of the last twenty days of a period comes with the next period's delivery; the
# last delivery also brings the oldest days once more.
_PERIOD_SQL = f"""
placed AS (SELECT *, CASE WHEN date < DATE '1996-01-01' THEN 1 WHEN date < DATE '1999-01-01' THEN 2 ELSE 3 END
                  AS period FROM antecedent),
counted AS (SELECT *, row_number() OVER (PARTITION BY division, period ORDER BY date DESC) AS back FROM placed),
late AS (SELECT *, back <= 20 AND back % 5 = 1 AS late FROM counted),
followed AS (
  SELECT *, coalesce(bool_or(late) OVER (PARTITION BY division, period ORDER BY date
                                         ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), false) AND NOT late AS revised,
         row_number() OVER (PARTITION BY division, late AND period = 3 ORDER BY date DESC) AS from_end
  FROM late)"""


@query(
    f"""WITH {STATION_SQL}, {_ANTECEDENT_SQL}, {_PERIOD_SQL}
    SELECT date, division, {scaled_list(_ANTECEDENT)}, CAST(CASE WHEN revised THEN 2 ELSE 1 END AS BIGINT) AS versions,
           CAST(CASE WHEN date < DATE '1995-06-01' AND NOT (late AND period = 3) AND from_end > {REMEMBERED}
                     THEN 1 ELSE 0 END AS BIGINT) AS redone
    FROM followed"""
)
def corrected_antecedent_rain(spark, sf_dir):
    """Four deliveries with late days: newest versions equal the batch result, and no other row is given out again."""
    path, out = shared_path(spark, "actuals"), shared_path(spark, "corrected-rain")
    day = F.col(DATE)
    period = F.when(day < "1996-01-01", 1).when(day < "1999-01-01", 2).otherwise(3)
    back = F.row_number().over(Window.partitionBy(DIVISION, "period").orderBy(day.desc()))
    late = (F.col("back") <= 20) & (F.col("back") % 5 == 1)
    rain = station_panel(spark, sf_dir).select(*KEY, RAIN).withColumn("period", period)
    rain = rain.withColumn("back", back).withColumn("turn", F.col("period") + late.cast("int"))
    rain = settle(rain.select(*KEY, RAIN, "turn"), "turns")
    schema = rain.drop("turn").schema
    with rocksdb_state(spark):
        for turn in range(1, 5):
            part = rain.filter(F.col("turn") == turn).drop("turn")
            if turn == 4:
                oldest = (day < "1995-06-01") & (F.col("turn") < 4)
                part = part.unionByName(rain.filter(oldest).drop("turn"))
            part.write.mode("append").parquet(path)
            stream = spark.readStream.schema(schema).parquet(path)
            output = run_to_end(stream_corrected_rain(stream), "corrected-rain", out)
    merged = merged_rain(output, rain.drop("turn"))
    redo = F.col("kind") == REDO
    counts = output.groupBy(*KEY).agg(F.count_if(~redo).alias("versions"), F.count_if(redo).alias("redone"))
    return merged.join(counts, KEY).select(*KEY, *[scaled(c) for c in _ANTECEDENT], "versions", "redone")


@query(
    f"""WITH RECURSIVE {STATION_SQL}, {sql.fit_sql("panel", "rain_sum", "fit")},
    early AS (SELECT division, rain_sum FROM panel WHERE date < DATE '1999-01-01'),
    {sql.fit_sql("early", "rain_sum", "early_fit")}
    SELECT 'all batches' AS part, division, n, {scaled_sql('q')}, {scaled_sql('alpha')}, {scaled_sql('beta')} FROM fit
    UNION ALL
    SELECT 'last removed', division, n, {scaled_sql('q')}, {scaled_sql('alpha')}, {scaled_sql('beta')} FROM early_fit"""
)
def grown_baseline(spark, sf_dir):
    """A baseline grown by three batches, one of them first wrong, compacted, and then without the last."""
    path = shared_path(spark, "baseline")
    panel = settle(station_panel(spark, sf_dir).select(*KEY, RAIN), "stations")
    day = F.col(DATE)
    parts = [panel.filter(day < "1996-01-01"), panel.filter((day >= "1996-01-01") & (day < "1999-01-01"))]
    parts.append(panel.filter(day >= "1999-01-01"))
    baseline.add_to_baseline(parts[0].withColumn(RAIN, F.col(RAIN) * 3 + 1), path, "0")
    for batch, rows in enumerate(parts):
        baseline.add_to_baseline(rows, path, f"{batch}")
    whole = settle(baseline.baseline_params(spark, path), "params")
    baseline.compact_baseline(spark, path)
    baseline.remove_from_baseline(spark, path, "2")
    left = baseline.baseline_params(spark, path)
    return whole.withColumn("part", F.lit("all batches")).unionByName(
        left.withColumn("part", F.lit("last removed"))
    ).select(
        "part",
        DIVISION,
        F.col(f"{RAIN}_n").alias("n"),
        *[scaled(f"{RAIN}_{c}", 6, c) for c in ("q", "alpha", "beta")],
    )


@query(
    f"""WITH {STATION_SQL}, {_ANTECEDENT_SQL},
    summed AS (SELECT *, {_LONG_SQL} FROM antecedent WINDOW w AS (PARTITION BY division ORDER BY date))
    SELECT date, division, {scaled_list([RAIN, *_ANTECEDENT, *_LONG])} FROM summed"""
)
def maintained_features(spark, sf_dir):
    """Windows of a stored table after three batches: early days, newer ones, then late and corrected days."""
    panel = settle(station_panel(spark, sf_dir).select(DATE, DIVISION, RAIN), "stations")
    day = F.col(DATE)
    late, wrong = (day.between(f"{first}-01", f"{first}-10") for first in ("1997-03", "1998-06"))
    store = FeatureStore(spark, shared_path(spark, "features"), [RAIN])
    early = panel.filter((day < "1999-01-01") & ~late)
    store.update(early.withColumn(RAIN, F.when(wrong, F.col(RAIN) * 2 + 1).otherwise(F.col(RAIN))))
    store.update(panel.filter(day >= "1999-01-01"))
    store.update(panel.filter(late | wrong))
    return store.features().select(*KEY, *[scaled(c) for c in [RAIN, *_ANTECEDENT, *_LONG]])
