"""Queries over the panel: joins, windows, projections, encodings, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrorisk.functions import scalars
from hydrorisk.operators import panel as ops
from hydrorisk.operators import splits
from hydrorisk.operators.spi import long_sums
from hydrorisk.operators.windows import antecedent_rain, over_rows
from hydrorisk.plans.register import TIE_FREE, query, scaled, scaled_list, scaled_sql
from hydrorisk.plans.stand_ins import (
    NATION_SQL,
    STATION_SQL,
    nation_panel,
    nation_rain,
    nation_soil,
    nation_temperature,
    station_panel,
    table,
)
from hydrorisk.schemas import DATE, DIVISION, KEY, MEASURES, RAIN
from hydrorisk.session import settle

_PANEL_COLUMNS = f"date, division, {scaled_list(MEASURES)}"


def _scaled_panel(df, digits=6):
    return df.select(*KEY, *[scaled(m, digits) for m in MEASURES])


@query(f"WITH {NATION_SQL} SELECT {_PANEL_COLUMNS} FROM panel")
def assembled_panel(spark, sf_dir):
    return _scaled_panel(nation_panel(spark, sf_dir))


@query(f"WITH {NATION_SQL} SELECT {_PANEL_COLUMNS} FROM panel")
def assembled_unique_panel(spark, sf_dir):
    return _scaled_panel(
        ops.assemble_unique_panel(
            nation_rain(spark, sf_dir), nation_temperature(spark, sf_dir), nation_soil(spark, sf_dir)
        )
    )


_ANTECEDENT_SQL = """
antecedent AS (
  SELECT *, LAG(rain_sum) OVER w AS rain_lag_1,
         SUM(rain_sum) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rain_rolling_3d,
         SUM(rain_sum) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rain_rolling_7d
  FROM panel WINDOW w AS (PARTITION BY division ORDER BY date))"""

_ANTECEDENT = ["rain_lag_1", "rain_rolling_3d", "rain_rolling_7d"]


@query(
    f"WITH {NATION_SQL}, {_ANTECEDENT_SQL}"
    f" SELECT date, division, {scaled_list(_ANTECEDENT)} FROM antecedent"
)
def antecedent_rain_windows(spark, sf_dir):
    rows = over_rows(settle(nation_panel(spark, sf_dir)), antecedent_rain, back=6)
    return rows.select(*KEY, *[scaled(c) for c in _ANTECEDENT])


@query(
    f"WITH {STATION_SQL}, {_ANTECEDENT_SQL}"
    f" SELECT date, division, {scaled_list(_ANTECEDENT)} FROM antecedent"
)
def antecedent_rain_split(spark, sf_dir):
    """The same windows forced onto slices of at most 100 rows of a division."""
    rows = over_rows(
        settle(station_panel(spark, sf_dir)), antecedent_rain, back=6, rows_per_task=100
    )
    return rows.select(*KEY, *[scaled(c) for c in _ANTECEDENT])


# Line items by supplier and day, not aggregated: days repeat; every seventh has no division.
_REPEATED_SQL = """
panel AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CASE WHEN l_suppkey % 7 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS division,
         CAST(l_quantity AS DOUBLE) AS rain_sum
  FROM lineitem)"""


def _repeated_days(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    key = F.col("l_suppkey")
    return lines.select(
        F.to_date("l_shipdate").alias(DATE),
        F.when(key % 7 != 0, key.cast("string")).alias(DIVISION),
        F.col("l_quantity").cast("double").alias(RAIN),
    )


@query(
    f"""WITH {_REPEATED_SQL}
    SELECT part, division, COUNT(*) AS rows, CAST(SUM(CAST(rain_sum AS BIGINT)) AS BIGINT) AS rain,
           COUNT(*) - 1 AS lags, 0 AS apart
    FROM panel, (VALUES ('whole'), ('sliced')) AS p(part) GROUP BY 1, 2"""
)
def windows_over_repeated_days(spark, sf_dir):
    """Both window forms over repeated days and a NULL division: rows, lags, and rows that differ."""
    rows = settle(_repeated_days(spark, sf_dir))
    forms = {
        "whole": over_rows(rows, antecedent_rain, back=6),
        "sliced": over_rows(rows, antecedent_rain, back=6, rows_per_task=50),
    }
    forms = {name: settle(df.withColumn("part", F.lit(name))) for name, df in forms.items()}
    columns = [*KEY, RAIN, *_ANTECEDENT]
    apart = (
        forms["whole"].select(*columns).exceptAll(forms["sliced"].select(*columns))
        .groupBy(DIVISION).agg(F.count(F.lit(1)).alias("apart"))
        .withColumnRenamed(DIVISION, "_division")
    )
    both = forms["whole"].unionByName(forms["sliced"]).groupBy("part", DIVISION).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(RAIN).cast("bigint")).alias("rain"),
        F.count("rain_lag_1").alias("lags"),
    )
    return both.join(apart, F.col(DIVISION).eqNullSafe(F.col("_division")), "left").select(
        "part", DIVISION, "rows", "rain", "lags", F.coalesce("apart", F.lit(0)).cast("int").alias("apart")
    )


@query(
    f"""WITH {_REPEATED_SQL},
    sizes AS (SELECT division, COUNT(*) AS n FROM panel GROUP BY division)
    SELECT division, CAST(fold AS INTEGER) AS fold,
           n // 3 + CASE WHEN fold < n % 3 THEN 1 ELSE 0 END AS rows
    FROM sizes, range(3) AS f(fold)
    WHERE n // 3 + CASE WHEN fold < n % 3 THEN 1 ELSE 0 END > 0"""
)
def fold_sizes(spark, sf_dir):
    """Fold sizes per class, rows without a class included."""
    rows = settle(_repeated_days(spark, sf_dir))
    dealt = splits.stratified_folds(rows, DIVISION, keys=[DATE, RAIN])
    return dealt.groupBy(DIVISION, "fold").agg(F.count(F.lit(1)).alias("rows"))


_LONG = [f"rain_rolling_{n}d" for n in (30, 90, 180)]
_LONG_SQL = ", ".join(
    f"CASE WHEN COUNT(rain_sum) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n}"
    f" THEN SUM(rain_sum) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
    f" AS rain_rolling_{n}d"
    for n in (30, 90, 180)
)


@query(
    f"""WITH {STATION_SQL},
    sums AS (SELECT *, {_LONG_SQL} FROM panel WINDOW w AS (PARTITION BY division ORDER BY date))
    SELECT date, division, {scaled_list(_LONG)} FROM sums"""
)
def long_rolling_sums(spark, sf_dir):
    rows = long_sums(settle(station_panel(spark, sf_dir)))
    return rows.select(*KEY, *[scaled(c) for c in _LONG])


@query(
    f"""WITH {NATION_SQL},
    sums AS (SELECT *, {_LONG_SQL} FROM panel WINDOW w AS (PARTITION BY division ORDER BY date))
    SELECT date, division, {scaled_list(_LONG)} FROM sums"""
)
def long_rolling_sums_with_gaps(spark, sf_dir):
    rows = long_sums(settle(nation_panel(spark, sf_dir)))
    return rows.select(*KEY, *[scaled(c) for c in _LONG])


@query(
    f"""WITH {STATION_SQL}
    SELECT date, division, {scaled_sql("sin(2 * pi() * month(date) / 12)", "month_sin")},
           {scaled_sql("cos(2 * pi() * month(date) / 12)", "month_cos")}
    FROM panel"""
)
def seasonal_encoding(spark, sf_dir):
    rows = scalars.month_cyclic(station_panel(spark, sf_dir))
    return rows.select(*KEY, scaled("month_sin"), scaled("month_cos"))


_MEANS = [*MEASURES, "soil_moisture_avg"]


@query(
    f"""WITH {NATION_SQL},
    means AS (
      SELECT division, CAST(date_trunc('month', date) AS DATE) AS year_month,
             {", ".join(f"AVG({m}) AS {m}" for m in MEASURES)}
      FROM panel GROUP BY 1, 2),
    averaged AS (
      SELECT *, list_avg([soil_moisture_7_to_28cm, soil_moisture_28_to_100cm,
                          soil_moisture_100_to_255cm]) AS soil_moisture_avg FROM means)
    SELECT division, year_month, {scaled_list(_MEANS, factor=TIE_FREE)} FROM averaged"""
)
def monthly_means(spark, sf_dir):
    means = ops.monthly_means(nation_panel(spark, sf_dir))
    return means.select(DIVISION, "year_month", *[scaled(m, factor=TIE_FREE) for m in _MEANS])


@query(
    f"""WITH {NATION_SQL}
    SELECT date, division, {scaled_list(MEASURES, 3)} FROM panel WHERE date >= DATE '1996-01-01'"""
)
def rounded_recent_panel(spark, sf_dir):
    recent = scalars.since(nation_panel(spark, sf_dir), "1996-01-01")
    return _scaled_panel(scalars.round_frame(recent, 3), 3)


@query(
    f"""WITH {NATION_SQL} SELECT {_PANEL_COLUMNS} FROM panel
    WHERE rain_sum IS NOT NULL AND soil_moisture_7_to_28cm IS NOT NULL"""
)
def complete_rows(spark, sf_dir):
    panel = nation_panel(spark, sf_dir)
    return _scaled_panel(scalars.drop_missing(panel, [RAIN, "soil_moisture_7_to_28cm"]))


@query(f"WITH {NATION_SQL} SELECT {_PANEL_COLUMNS} FROM panel WHERE division = '7'")
def one_division(spark, sf_dir):
    return _scaled_panel(scalars.of_division(nation_panel(spark, sf_dir), "7"))


@query(f"WITH {NATION_SQL} SELECT COUNT(*) AS rows, 7 AS columns FROM panel")
def panel_shape(spark, sf_dir):
    panel = nation_panel(spark, sf_dir)
    width = F.lit(len(panel.columns)).alias("columns")
    return panel.agg(F.count(F.lit(1)).alias("rows")).select("rows", width)


@query(f"WITH {STATION_SQL} SELECT DISTINCT division FROM panel")
def distinct_divisions(spark, sf_dir):
    return ops.distinct_divisions(station_panel(spark, sf_dir))


@query(
    """SELECT CAST(substr(CAST(ts AS VARCHAR), 1, 10) AS DATE) AS day,
           CAST(date_trunc('month', ts) AS DATE) AS month, COUNT(*) AS readings
    FROM events GROUP BY 1, 2"""
)
def local_days(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    days = events.select(scalars.local_day(F.col("ts").cast("string")).alias("day"))
    return days.groupBy("day", scalars.month_start("day").alias("month")).agg(
        F.count(F.lit(1)).alias("readings")
    )


@query(
    f"""WITH {NATION_SQL},
    clipped AS (SELECT *, CASE WHEN rain_sum IS NOT NULL
                          THEN greatest(1.5, least(rain_sum, 40.0)) END AS clipped FROM panel)
    SELECT date, division, {scaled_sql("clipped")} FROM clipped"""
)
def clipped_rain(spark, sf_dir):
    panel = nation_panel(spark, sf_dir)
    return panel.select(*KEY, scaled(scalars.clip(F.col(RAIN), 1.5, 40.0), 6, "clipped"))


@query(
    f"""WITH {STATION_SQL}
    SELECT division, CAST(row_number() OVER (ORDER BY division) - 1 AS INTEGER) AS division_encoded
    FROM (SELECT DISTINCT division FROM panel)"""
)
def division_encoder(spark, sf_dir):
    return ops.fit_division_encoder(station_panel(spark, sf_dir))


def _early_wet(panel):
    """Training rows of two stations in three: the encoder does not know the others."""
    return panel.filter(
        (F.col(RAIN) > 0) & (F.col(DATE) < "1995-06-01") & (F.col(DIVISION).cast("int") % 3 != 0)
    )


_WET_ENCODER_SQL = """
encoder AS (
  SELECT division, CAST(row_number() OVER (ORDER BY division) - 1 AS INTEGER) AS division_encoded
  FROM (SELECT DISTINCT division FROM panel
        WHERE rain_sum > 0 AND date < DATE '1995-06-01' AND CAST(division AS INTEGER) % 3 <> 0))"""


@query(
    f"""WITH {STATION_SQL}, {_WET_ENCODER_SQL}
    SELECT date, division, division_encoded FROM panel JOIN encoder USING (division)"""
)
def encoded_divisions(spark, sf_dir):
    panel = station_panel(spark, sf_dir)
    encoder = ops.fit_division_encoder(_early_wet(panel))
    return ops.encode_division(panel, encoder).select(*KEY, "division_encoded")


@query(
    f"""WITH {STATION_SQL}, {_WET_ENCODER_SQL}
    SELECT date, division FROM panel WHERE division IN (SELECT division FROM encoder)"""
)
def known_divisions(spark, sf_dir):
    panel = station_panel(spark, sf_dir)
    encoder = ops.fit_division_encoder(_early_wet(panel))
    return ops.known_divisions(panel, encoder).select(*KEY)


_PLACE = "row_number() OVER (ORDER BY division, date)"


@query(
    f"""WITH {STATION_SQL},
    placed AS (SELECT date, division, {_PLACE} AS place, COUNT(*) OVER () AS total FROM panel)
    SELECT date, division, CASE WHEN place <= total - 8630 THEN 'train' ELSE 'test' END AS part
    FROM placed"""
)
def tail_split(spark, sf_dir):
    train, test = splits.split_tail(settle(station_panel(spark, sf_dir)), 8630)
    return _parts(train=train, test=test)


def _parts(**frames):
    tagged = [df.select(*KEY, F.lit(name).alias("part")) for name, df in frames.items()]
    whole = tagged[0]
    for more in tagged[1:]:
        whole = whole.unionByName(more)
    return whole


@query(
    f"""WITH {STATION_SQL},
    placed AS (SELECT date, division, {_PLACE} AS place, COUNT(*) OVER () AS total FROM panel)
    SELECT date, division,
           CASE WHEN place <= floor(floor(total * 0.8::DOUBLE) * 0.8::DOUBLE) THEN 'fit'
                WHEN place <= floor(total * 0.8::DOUBLE) THEN 'validate' ELSE 'test' END AS part
    FROM placed"""
)
def nested_fraction_split(spark, sf_dir):
    train, test = splits.split_fraction(settle(station_panel(spark, sf_dir)), 0.8)
    fit, validate = splits.split_fraction(train, 0.8)
    return _parts(fit=fit, validate=validate, test=test)


@query(
    f"""WITH {STATION_SQL}
    SELECT date, division, CASE WHEN date < DATE '2000-01-01' THEN 'train'
                                WHEN date < DATE '2001-01-01' THEN 'validate'
                                ELSE 'test' END AS part
    FROM panel"""
)
def temporal_split(spark, sf_dir):
    train, validate, test = splits.split_temporal(
        station_panel(spark, sf_dir), "2000-01-01", "2001-01-01"
    )
    return _parts(train=train, validate=validate, test=test)


@query(
    f"""WITH {STATION_SQL},
    classed AS (SELECT date, division, CASE WHEN rain_sum > 0 THEN 1 ELSE 0 END AS wet FROM panel)
    SELECT date, division, wet,
           CAST((row_number() OVER (PARTITION BY wet ORDER BY
                 md5(concat_ws('|', division, CAST(date AS VARCHAR), '42')), division, date) - 1)
                % 3 AS INTEGER) AS fold
    FROM classed"""
)
def stratified_folds(spark, sf_dir):
    classed = settle(
        station_panel(spark, sf_dir).select(*KEY, (F.col(RAIN) > 0).cast("int").alias("wet"))
    )
    return splits.stratified_folds(classed, "wet", keys=[DIVISION, DATE])
