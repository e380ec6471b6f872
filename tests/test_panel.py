import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrorisk.operators import panel as ops
from hydrorisk.operators import quality
from hydrorisk.plans.features import feature_matrix
from hydrorisk.schemas import MEASURES, RAIN, SOIL, TEMPERATURE
from hydrorisk.session import settle
from tests.conftest import random_panel, sorted_pandas, to_spark


def sources(spark, seed=3):
    """Three sources over overlapping keys, as pandas and as Spark frames."""
    frames, names = [], [[RAIN], [TEMPERATURE], SOIL]
    for i, measures in enumerate(names):
        frame = random_panel(seed + i, divisions=4, days=300, gaps=0.3).rename(
            columns={RAIN: measures[0]}
        )
        for m in measures[1:]:
            frame[m] = frame[measures[0]] / 3
        frames.append(frame)
    spark_frames = [
        settle(to_spark(spark, f, "date date, division string, " + ", ".join(f"{m} double" for m in ms)))
        for f, ms in zip(frames, names)
    ]
    return frames, spark_frames


def test_assembled_panel_matches_pandas(spark):
    (rain, temp, soil), dfs = sources(spark)
    keys = ["date", "division"]
    expected = rain.merge(temp, on=keys, how="outer").merge(soil, on=keys, how="outer")
    expected = expected.sort_values(["division", "date"]).reset_index(drop=True)
    for assemble in (ops.assemble_panel, ops.assemble_unique_panel):
        got = sorted_pandas(assemble(*dfs))[expected.columns]
        assert got[keys].equals(expected[keys])
        np.testing.assert_allclose(
            got[MEASURES].astype(float), expected[MEASURES].astype(float), rtol=0, atol=0
        )


def test_repeated_keys_multiply(spark):
    day = datetime.date(2015, 1, 1)
    rain = spark.createDataFrame([(day, "A", 1.0), (day, "A", 2.0)], f"date date, division string, {RAIN} double")
    temp = spark.createDataFrame([(day, "A", 5.0), (day, "A", 6.0)], f"date date, division string, {TEMPERATURE} double")
    soil = spark.createDataFrame([], "date date, division string, " + ", ".join(f"{m} double" for m in SOIL))
    assert ops.assemble_panel(rain, temp, soil).count() == 4


def test_backfill_prefers_the_regular_series(spark):
    d = [datetime.date(2014, 12, 30 + i) for i in range(2)] + [datetime.date(2015, 1, 1)]
    schema = f"date date, division string, {RAIN} double"
    rain = spark.createDataFrame([(d[1], "A", 1.0), (d[2], "A", None)], schema)
    history = spark.createDataFrame([(d[0], "A", 7.0), (d[1], "A", 8.0), (d[2], "A", 9.0)], schema)
    rows = sorted(map(tuple, ops.with_backfill(rain, history).collect()))
    assert rows == [(d[0], "A", 7.0), (d[1], "A", 1.0), (d[2], "A", None)]


def test_feature_matrix_matches_pandas(spark):
    (rain, temp, soil), dfs = sources(spark)
    matrix = feature_matrix(*dfs, first_day="1990-07-01", windows=[6, 12])
    keys = ["date", "division"]
    frame = rain.merge(temp, on=keys, how="outer").merge(soil, on=keys, how="outer")
    frame = frame.sort_values(["division", "date"]).reset_index(drop=True)
    by = frame.groupby("division")[RAIN]
    frame["rain_lag_1"] = by.shift(1)
    for n in (3, 7):
        frame[f"rain_rolling_{n}d"] = by.transform(lambda s, n=n: s.rolling(n, min_periods=1).sum())
    month = pd.to_datetime(frame["date"]).dt.month
    frame["month_sin"], frame["month_cos"] = np.sin(2 * np.pi * month / 12), np.cos(2 * np.pi * month / 12)
    expected = frame[frame["date"] >= datetime.date(1990, 7, 1)].round(3).reset_index(drop=True)
    got = sorted_pandas(matrix)
    assert list(got.columns) == [*expected.columns, "spi_6d", "spi_12d"]
    assert got[keys].equals(expected[keys])
    values = list(expected.columns[2:])
    np.testing.assert_allclose(got[values].astype(float), expected[values].astype(float), atol=1e-9)
    # rows before the first day warm up the windows
    assert got["spi_6d"].notna().sum() > 100


def test_monthly_means(spark):
    _, dfs = sources(spark)
    panel = ops.assemble_panel(*dfs)
    frame = sorted_pandas(panel)
    frame["year_month"] = pd.to_datetime(frame["date"]).dt.to_period("M").dt.to_timestamp().dt.date
    expected = frame.groupby(["division", "year_month"])[MEASURES].mean().reset_index()
    expected["soil_moisture_avg"] = expected[SOIL].mean(axis=1)
    got = sorted_pandas(ops.monthly_means(panel), ("division", "year_month"))
    assert got[["division", "year_month"]].equals(expected[["division", "year_month"]])
    columns = [*MEASURES, "soil_moisture_avg"]
    np.testing.assert_allclose(got[columns].astype(float), expected[columns].astype(float), rtol=1e-12)


def test_encoder_follows_name_order(spark):
    names = ["beta", "Alpha", "alpha", "10", "9"]
    df = spark.createDataFrame([(n,) for n in names * 3], "division string")
    encoder = ops.fit_division_encoder(df)
    got = {r["division"]: r["division_encoded"] for r in encoder.collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}
    more = spark.createDataFrame([("beta", 1), ("new", 2)], "division string, x int")
    assert [tuple(r) for r in ops.encode_division(more, encoder).collect()] == [("beta", 1, 4)]
    assert ops.known_divisions(more, encoder).count() == 1


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3 + [(3,)], "y int")
    got = {r["y"]: r["class_weight"] for r in ops.balanced_weights(df, "y").collect()}
    assert got == {0: pytest.approx(10 / 18), 1: pytest.approx(10 / 9), 3: pytest.approx(10 / 3)}
    weighted = ops.with_class_weight(df, ops.balanced_weights(df, "y"), "y")
    assert weighted.agg(F.sum("class_weight")).first()[0] == pytest.approx(10)


# The recorded registry counts per province.
PROVINCES = {
    "Central": 36, "Eastern": 13, "North Central": 21, "North Western": 12, "Northern": 17,
    "Sabaragamuwa": 9, "Southern": 1, "Uva": 11, "Western": 1,
}


@pytest.fixture(scope="module")
def places(spark):
    rows = [(f"{p} {i:02d}", f"{p} d{i % 3}", p) for p, n in PROVINCES.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, district string, province string")


def test_registry_rollup(places):
    rows = quality.registry_rollup(places).collect()
    assert {r["province"]: r["members"] for r in rows if r["district"] == "TOTAL"} == {
        **PROVINCES, "TOTAL": 121
    }
    districts = {r["district"]: r["members"] for r in rows if r["district"] != "TOTAL"}
    assert sum(districts.values()) == 121 and districts["Uva d0"] == 4
    members = quality.registry_members(places, "district").collect()
    assert [r["id"] for r in members if r["district"] == "Uva d0"] == [
        "Uva 00", "Uva 03", "Uva 06", "Uva 09"
    ]
    assert {r["members"] for r in members if r["district"] == "Uva d0"} == {4}


def test_missing_and_coverage(spark, places):
    seen = places.filter("province <> 'Uva'").select(F.col("id").alias("division"))
    missing = [r["id"] for r in quality.missing_divisions(places, seen).collect()]
    assert missing == [f"Uva {i:02d}" for i in range(11)]
    row = quality.coverage(seen, places).first()
    assert (row["found"], row["expected"], row["coverage_pct"]) == (110, 121, 90.9)
    assert row["coverage_bar"] == "█" * 18 + "░" * 2
    over = seen.unionByName(spark.range(40).selectExpr("concat('x', id) AS division"))
    row = quality.coverage(over, places).first()
    assert row["coverage_pct"] == round(100 * 150 / 121, 1)
    assert row["coverage_bar"] == "█" * int(100 * 150 / 121 / 5)
    empty = quality.coverage(seen, places.limit(0)).first()
    assert (empty["coverage_pct"], empty["coverage_bar"]) == (0.0, "░" * 20)


def test_reconcile_names(spark, places):
    requested = spark.createDataFrame([("Uva 01",), ("Nowhere",), ("Nowhere",), ("Elsewhere",)], "name string")
    assert [r["name"] for r in quality.reconcile_names(requested, places).collect()] == ["Elsewhere", "Nowhere"]
    assert tuple(quality.reconcile_counts(requested, places).first()) == (3, 2)


def test_profile_of_text_and_numbers(spark):
    rows = [
        ("2015-01-02", "A", "1.5", 1.0), ("2015-01-01", "A", "", float("nan")),
        ("2015-01-05", "B", "abc", None), ("2015-01-03", "B", "-2.12346", 3.0),
    ]
    df = spark.createDataFrame(rows, "date string, division string, t string, v double")
    got = {r["measure"]: r.asDict() for r in quality.profile(df, ["t", "v"]).collect()}
    assert got["t"] == {
        "measure": "t", "rows": 4, "divisions": 2, "date_min": "2015-01-01",
        "date_max": "2015-01-05", "min": -2.1235, "max": 1.5,
        "mean": round((1.5 - 2.12346) / 2, 4), "null_count": 2, "null_pct": 50.0,
    }
    assert (got["v"]["mean"], got["v"]["null_count"]) == (2.0, 2)
    empty = quality.profile(df.limit(0), ["v"]).first()
    assert (empty["rows"], empty["null_count"], empty["null_pct"], empty["mean"]) == (0, 0, 0.0, None)


def test_expected_days(spark):
    start, end = F.lit("2015-01-01").cast("date"), F.lit("2026-01-01").cast("date")
    row = spark.range(1).select(
        quality.expected_days(start, end), quality.expected_days_inclusive(start, end)
    ).first()
    assert tuple(row) == (4018, 4019)


def test_class_distribution_order(spark):
    df = spark.createDataFrame([("Normal",)] * 3 + [("Severe",)] * 4 + [("Extreme",)], "s string")
    got = [tuple(r) for r in quality.class_distribution(df, "s").collect()]
    assert got == [("Severe", 4), ("Normal", 3), ("Extreme", 1)]


def test_a_repeated_key_is_an_error(spark):
    rows = [("a", "2000-01-01", 1.0), ("a", "2000-01-01", 2.0)]
    one = spark.createDataFrame(rows, "division string, d string, x double")
    one = one.select("division", F.to_date("d").alias("date"), "x")
    two = one.limit(1).withColumnRenamed("x", "y")
    with pytest.raises(Exception, match="repeated key"):
        ops.assemble_unique_panel(one, two).collect()
    assert ops.assemble_unique_panel(two, two.withColumnRenamed("y", "z")).count() == 1


def test_station_lines_move_once(spark, tmp_path):
    """Lines put together by division give the same panel, and windows on it need no shuffle of their own."""
    from hydrorisk.operators.windows import antecedent_rain, over_rows
    from hydrorisk.plans.stand_ins import station_panel

    lines = spark.range(400).selectExpr(
        "if(id % 50 = 0, null, id % 7) AS l_suppkey",
        "timestamp_ntz'1999-01-01' + make_dt_interval(cast(id % 60 as int)) AS l_shipdate",
        "if(id % 3 = 0, 'R', 'N') AS l_returnflag",
        *[f"cast(id % {n} as double) / 4 AS {c}" for n, c in ((11, "l_extendedprice"), (13, "l_quantity"), (5, "l_discount"), (3, "l_tax"))],
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    apart, together = station_panel(spark, str(tmp_path)), station_panel(spark, str(tmp_path), together=True)
    assert apart.exceptAll(together).isEmpty() and together.exceptAll(apart).isEmpty()
    windows = over_rows(together, antecedent_rain, back=6)
    assert windows._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
