"""Queries over checked reads, bucketed storage and profiles by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hydrorisk.operators import batch_profile
from hydrorisk.operators.windows import antecedent_rain, over_rows
from hydrorisk.plans.landing_queries import _vector_documents
from hydrorisk.plans.panel_queries import _ANTECEDENT, _ANTECEDENT_SQL
from hydrorisk.plans.register import query, scaled, scaled_list
from hydrorisk.plans.stand_ins import NATION_RAIN_SQL, STATION_SQL, nation_rain, station_panel
from hydrorisk.schemas import DATE, DIVISION, KEY, RAIN, SOIL, TEMPERATURE
from hydrorisk.session import settle, shared_path
from hydrorisk.sources import quarantine
from hydrorisk.sources.bucketed import exchanges, write_bucketed

_UNITS_SQL = f"""{NATION_RAIN_SQL},
units AS (SELECT date, division, CAST(round_even(rain_sum * 1e4, 0) AS BIGINT) AS units FROM rain)"""


@query(
    f"""WITH {_UNITS_SQL}
    SELECT 'good' AS part, division, date, units, NULL AS record FROM units WHERE day(date) NOT IN (13, 17, 19)
    UNION ALL SELECT 'malformed', NULL, NULL, NULL, date || ',' || division || ',wet' FROM units WHERE day(date) = 13
    UNION ALL SELECT 'malformed', NULL, NULL, NULL, 'day ' || date || ',' || division || ',' || units
    FROM units WHERE day(date) = 17
    UNION ALL SELECT 'no key', NULL, NULL, NULL, NULL FROM units WHERE day(date) = 19"""
)
def quarantined_csv(spark, sf_dir):
    """Measurement files with unreadable rain on the 13th, days on the 17th and no division on the 19th."""
    path, day = shared_path(spark, "rain-csv"), F.dayofmonth(DATE)
    units = scaled(RAIN, 4).cast("string")
    texts = nation_rain(spark, sf_dir).select(
        F.when(day == 17, F.concat(F.lit("day "), F.col(DATE).cast("string"))).otherwise(F.col(DATE).cast("string")).alias(DATE),
        F.when(day != 19, F.col(DIVISION)).alias(DIVISION),
        F.when(day == 13, F.lit("wet")).otherwise(units).alias(RAIN),
    )
    texts.write.option("header", True).csv(path)
    checked = quarantine.read_measurement_checked(spark, path, [RAIN])
    good = checked.rows.select(
        F.lit("good").alias("part"),
        DIVISION,
        DATE,
        F.col(RAIN).cast("bigint").alias("units"),
        F.lit(None).cast("string").alias("record"),
    )
    from_file = F.when(F.contains("file", F.lit(path.rsplit("/", 1)[1])), F.col("reason"))
    bad = checked.rejects.select(
        from_file.alias("part"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in good.dtypes[1:4]],
        "record",
    )
    return good.unionByName(bad)


@query(
    """SELECT CAST(vec_id AS VARCHAR) AS division,
              CASE WHEN vec_id % 10 = 3 THEN 'malformed' WHEN label = 0 THEN 'failed' ELSE 'good' END AS part
       FROM embeddings"""
)
def quarantined_documents(spark, sf_dir):
    """Document files of which every tenth is cut off in the middle; those without a time axis are another matter."""
    path = shared_path(spark, "documents")
    texts = _vector_documents(spark, sf_dir, "daily", {RAIN: F.col("_x")})
    named = texts.withColumn("id", F.regexp_extract("text", '"division":"([0-9]+)"', 1).cast("bigint"))
    half = F.substring("text", F.lit(1), (F.length("text") / 2).cast("int"))
    named.select(F.when(F.col("id") % 10 == 3, half).otherwise(F.col("text")).alias("value")).write.text(path)
    checked = quarantine.read_documents_checked(spark, path, "daily", [RAIN])
    failed = F.coalesce(F.size("daily.time"), F.lit(0)) <= 0
    good = checked.rows.select(DIVISION, F.when(failed, "failed").otherwise("good").alias("part"))
    bad = checked.rejects.select(
        F.regexp_extract("record", '"division":"([0-9]+)"', 1).alias(DIVISION), F.col("reason").alias("part")
    )
    return good.unionByName(bad)


@query(
    f"""WITH {STATION_SQL}, {_ANTECEDENT_SQL}
    SELECT date, division, {scaled_list(_ANTECEDENT)}, 0 AS exchanges FROM antecedent"""
)
def bucketed_windows(spark, sf_dir):
    """Antecedent rain of a panel stored in buckets by division: no row crosses a shuffle."""
    name = f"panel_{uuid.uuid4().hex}"
    stored = write_bucketed(station_panel(spark, sf_dir), name, shared_path(spark, "buckets"), 16)
    rows = over_rows(stored, antecedent_rain, back=6)
    result = rows.select(*KEY, *[scaled(c) for c in _ANTECEDENT], F.lit(exchanges(rows)).alias("exchanges"))
    # The catalog forgets the name; the files, and the plan made from them, stay.
    spark.sql(f"DROP TABLE {name}")
    return result


_PROFILED = [RAIN, TEMPERATURE, SOIL[0]]
_BATCH_PROFILE_SQL = "UNION ALL".join(
    f"""
    SELECT '{m}' AS measure, COUNT(*) AS rows, MIN(date) AS date_min, MAX(date) AS date_max,
           CAST(round_even(MIN({m}) * 1e6, 0) AS BIGINT) AS min, CAST(round_even(MAX({m}) * 1e6, 0) AS BIGINT) AS max,
           CAST(round_even(AVG({m}) * 1e6 / sqrt(2), 0) AS BIGINT) AS mean, COUNT(*) - COUNT({m}) AS null_count,
           true AS divisions_close, true AS quantiles_close
    FROM panel """
    for m in _PROFILED
)


@query(f"WITH {STATION_SQL} {_BATCH_PROFILE_SQL}")
def profile_by_batch(spark, sf_dir):
    """A profile merged from one stored row per year, one year landed wrong first; sketches checked on all rows."""
    path = shared_path(spark, "profiles")
    panel = settle(station_panel(spark, sf_dir).select(*KEY, *_PROFILED), "stations")
    batch_profile.land_profile(panel.withColumn(RAIN, F.col(RAIN) * 9 + 5), path, "1995", _PROFILED)
    for year in range(1995, 2002):
        part = panel.filter(F.year(DATE) <= year) if year == 1995 else panel.filter(F.year(DATE) == year)
        part = panel.filter(F.year(DATE) >= year) if year == 2001 else part
        batch_profile.land_profile(part, path, f"{year}", _PROFILED)
    merged = settle(batch_profile.merged_profile(spark, path, _PROFILED), "merged")
    exact = F.count_distinct(DIVISION).alias("_divisions")
    shares = []
    for m in _PROFILED:
        # Share of the values below, and up to, each estimated quantile; 3 % off at most.
        near = []
        for k, wanted in enumerate(batch_profile.QUANTILES):
            limit = F.col(f"_{m}")[k]
            low = F.avg(F.when(F.col(m).isNotNull(), (F.col(m) < limit).cast("int")))
            high = F.avg(F.when(F.col(m).isNotNull(), (F.col(m) <= limit).cast("int")))
            near.append((low - 0.03 <= wanted) & (high + 0.03 >= wanted))
        shares.append(F.struct(F.lit(m).alias("_measure"), (near[0] & near[1] & near[2]).alias("quantiles_close")))
    limits = merged.groupBy().agg(*[F.max(F.when(F.col("measure") == m, F.col("quantiles"))).alias(f"_{m}") for m in _PROFILED])
    scanned = panel.join(limits, F.lit(True)).agg(exact, F.array(*shares).alias("_s")).select("_divisions", F.inline("_s"))
    close = F.abs(F.col("divisions") - F.col("_divisions")) <= 0.05 * F.col("_divisions")
    return merged.join(scanned, F.col("measure") == F.col("_measure")).select(
        "measure", "rows", "date_min", "date_max",
        scaled("min"), scaled("max"), scaled("mean", factor=1e6 / 2**0.5),
        "null_count", close.alias("divisions_close"), "quantiles_close",
    )
