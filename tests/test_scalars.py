import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrorisk.functions import scalars
from hydrorisk.functions import severity as sev


def one(spark, column, **values):
    row = [tuple(values.values())] if values else [(1,)]
    return spark.createDataFrame(row, list(values) or ["x"]).select(column.alias("r")).first()["r"]


def test_round_half_even_matches_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 50, 20_000), np.arange(-2000, 2000) / 2000, [0.0005, 2.5]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r["x"] for r in scalars.round_frame(df, 3).collect()]
    assert np.array_equal(np.array(got), np.round(values, 3))


def test_round_decimal_matches_python(spark):
    rng = np.random.default_rng(2)
    values = [float(v) for v in rng.normal(20, 7, 5_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["r"] for r in df.select(scalars.round_decimal(F.col("x"), 4).alias("r")).collect()]
    assert got == [round(v, 4) for v in values]


def test_month_cyclic(spark):
    df = spark.sql("SELECT date'2020-12-31' AS date UNION ALL SELECT date'2020-03-01'")
    rows = {r["date"].month: r for r in scalars.month_cyclic(df).collect()}
    assert rows[12]["month_sin"] == pytest.approx(0, abs=1e-12)
    assert rows[12]["month_cos"] == pytest.approx(1)
    assert rows[3]["month_sin"] == pytest.approx(math.sin(2 * math.pi * 3 / 12))


def test_local_day_ignores_time_zone(spark):
    assert str(one(spark, scalars.local_day("t"), t="2024-02-29T23:30")) == "2024-02-29"


def test_clip_keeps_missing(spark):
    df = spark.sql("SELECT * FROM VALUES (0.0D), (0.5D), (1.0D), (NULL) AS t(x)")
    got = [r["r"] for r in df.select(scalars.clip(F.col("x"), 0.0001, 0.9999).alias("r")).collect()]
    assert got == [0.0001, 0.5, 0.9999, None]


def test_row_mean_skips_missing(spark):
    df = spark.sql("SELECT 1.0D a, CAST(NULL AS DOUBLE) b, 4.0D c UNION ALL SELECT NULL, NULL, NULL")
    got = [r["r"] for r in df.select(scalars.row_mean(["a", "b", "c"]).alias("r")).collect()]
    assert got == [2.5, None]


def test_safe_double(spark):
    df = spark.createDataFrame([("1.5",), ("",), ("x",), ("nan",), (None,), ("-2e3",)], "v string")
    got = [r["r"] for r in df.select(scalars.safe_double("v").alias("r")).collect()]
    assert got == [1.5, None, None, None, None, -2000.0]


def test_severity_ordinal_round_trip(spark):
    df = spark.createDataFrame([("Normal",), ("Extreme",), ("Calm",), (None,)], "s string")
    rank = scalars.severity_ordinal(F.col("s"))
    got = [tuple(r) for r in df.select(rank, scalars.severity_name(rank)).collect()]
    assert got == [(0, "Normal"), (3, "Extreme"), (None, None), (None, None)]


def test_name_tokens(spark):
    text = "Alpha, Beta ,,Gamma\nImage 3, Beta\n Total: 4  Delta , Epsilon "
    df = spark.createDataFrame([(text,), ("Alpha",)], "t string")
    got = sorted(r["name"] for r in scalars.name_tokens(df, "t").collect())
    expected = {x.strip() for line in text.split("\n") for x in line.split(",")} | {"Alpha"}
    assert got == sorted(
        x for x in expected if x and not x.startswith("Image") and "Total" not in x
    )


SPI = [-2.5, -2.0, -1.99, -1.5, -1.49, -1.0, -0.99, 0.0, 0.79, 0.8, 1.0, 1.29, 1.3, 1.5, 1.59,
       1.6, 1.99, 2.0, None]


def test_flood_and_drought_thresholds(spark):
    df = spark.createDataFrame([(x,) for x in SPI], "x double")
    rows = df.select("x", sev.flood_severity(F.col("x")), sev.drought_severity(F.col("x"))).collect()

    def flood(x):
        if x is None or x < 0.8:
            return "Normal"
        return "Moderate" if x < 1.3 else "Severe" if x < 1.6 else "Extreme"

    def drought(x):
        if x is None or x > -1.0:
            return "Normal"
        return "Moderate" if x > -1.5 else "Severe" if x > -2.0 else "Extreme"

    assert [tuple(r) for r in rows] == [(x, flood(x), drought(x)) for x in SPI]


def test_landslide_either_side_may_be_missing(spark):
    cases = {
        (150.0, None): "Extreme", (None, 2.0): "Extreme", (100.0, 0.0): "Severe",
        (0.0, 1.5): "Severe", (75.0, None): "Moderate", (None, 1.0): "Moderate",
        (None, None): "Normal", (74.9, 0.99): "Normal", (120.0, 2.1): "Extreme",
    }
    df = spark.createDataFrame(list(cases), "r double, s double")
    rows = df.select("r", "s", sev.landslide_severity(F.col("r"), F.col("s"))).collect()
    assert {(a, b): c for a, b, c in rows} == cases


def test_hazard_datasets_carry_one_label_each(spark):
    df = spark.createDataFrame([(80.0, -1.2)], "rain_sum double, spi double")
    sets = sev.hazard_datasets(df.withColumn("flood_severity", F.lit("old")))
    assert {h: [c for c in d.columns if c.endswith("severity")] for h, d in sets.items()} == {
        h: [f"{h}_severity"] for h in ("flood", "drought", "landslide")
    }
    assert sets["drought"].first()["drought_severity"] == "Moderate"
    assert sets["landslide"].first()["landslide_severity"] == "Moderate"


def test_planned_rules(spark):
    columns = ("rain_sum double, rain_rolling_3d double, rain_rolling_7d double,"
               " soil_moisture_7_to_28cm double, soil_moisture_28_to_100cm double,"
               " spi_30d double, spi_90d double")
    rows = [
        (10.0, 10.0, 301.0, None, None, -2.1, -1.6),
        (61.0, 10.0, 201.0, 0.46, 0.39, -2.1, -1.4),
        (31.0, 160.0, 101.0, 0.41, 0.1, -0.9, -1.1),
        (51.0, 81.0, 10.0, 0.1, 0.1, None, None),
        (101.0, 0.0, None, None, 0.46, 0.0, -1.6),
    ]
    df = spark.createDataFrame(rows, columns)
    for rule in (sev.flood_rule_v0, sev.drought_rule_v0, sev.landslide_rule_v0):
        df = rule(df)
    got = [tuple(r)[-3:] for r in df.collect()]
    assert got == [
        ("Extreme", "Extreme", "Normal"),
        ("Extreme", "Severe", "Severe"),
        ("Severe", "Moderate", "Severe"),
        ("Moderate", "Normal", "Moderate"),
        ("Moderate", "Severe", "Extreme"),
    ]
