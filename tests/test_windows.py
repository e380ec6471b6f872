import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hydrorisk.operators.forecast import horizon_targets
from hydrorisk.operators.spi import long_sums
from hydrorisk.operators.windows import (
    antecedent_rain,
    over_rows,
    positions,
    rolling_sums,
    running_total,
)
from tests.conftest import sorted_pandas, to_spark

SPLITS = [4_000_000, 10, 97]


def pandas_rolling(frame, n, min_periods):
    return frame.groupby("division")["rain_sum"].transform(
        lambda s: s.rolling(n, min_periods=min_periods).sum()
    )


def same(got, expected):
    np.testing.assert_allclose(
        got.to_numpy(dtype=float), expected.to_numpy(dtype=float), rtol=1e-9, atol=1e-9
    )


@pytest.mark.parametrize("rows_per_task", SPLITS)
def test_antecedent_rain_matches_pandas(panel, panel_df, rows_per_task):
    got = sorted_pandas(over_rows(panel_df, antecedent_rain, back=6, rows_per_task=rows_per_task))
    expected = panel.sort_values(["division", "date"]).reset_index(drop=True)
    assert len(got) == len(expected)
    assert list(got.columns) == [*panel.columns, "rain_lag_1", "rain_rolling_3d", "rain_rolling_7d"]
    same(got["rain_lag_1"], expected.groupby("division")["rain_sum"].shift(1))
    same(got["rain_rolling_3d"], pandas_rolling(expected, 3, 1))
    same(got["rain_rolling_7d"], pandas_rolling(expected, 7, 1))


@pytest.mark.parametrize("rows_per_task", SPLITS)
@pytest.mark.parametrize("lengths", [[30, 90, 180], [4, 6], [5], [3, 7]])
def test_full_window_sums_match_pandas(panel, panel_df, rows_per_task, lengths):
    stages, helpers = rolling_sums("rain_sum", {n: f"s{n}" for n in lengths})
    got = sorted_pandas(
        over_rows(panel_df, *stages, back=max(lengths) - 1, rows_per_task=rows_per_task).drop(*helpers)
    )
    expected = panel.sort_values(["division", "date"]).reset_index(drop=True)
    assert len(got) == len(expected)
    for n in lengths:
        same(got[f"s{n}"], pandas_rolling(expected, n, n))


def test_dry_windows_sum_to_exact_zero(spark):
    frame = pd.DataFrame({
        "date": pd.date_range("2000-01-01", periods=400).date,
        "division": "d",
        "rain_sum": [0.1 + i * 0.3 for i in range(100)] + [0.0] * 300,
    })
    df = to_spark(spark, frame, "date date, division string, rain_sum double")
    got = sorted_pandas(long_sums(df))
    assert (got["rain_rolling_180d"].iloc[279:] == 0.0).all()


@pytest.mark.parametrize("rows_per_task", SPLITS)
def test_targets_look_ahead(panel, panel_df, rows_per_task):
    df = panel_df.withColumn("level", F.floor(F.col("rain_sum")))
    whole = sorted_pandas(horizon_targets(df, "level"))
    got = sorted_pandas(
        over_rows(
            df,
            lambda w: {f"target_day{h}": F.lead("level", h).over(w) for h in (1, 2, 3)},
            ahead=3,
            rows_per_task=rows_per_task,
        )
    )
    expected = panel.sort_values(["division", "date"]).reset_index(drop=True)
    level = np.floor(expected["rain_sum"]).groupby(expected["division"])
    for h in (1, 2, 3):
        same(got[f"target_day{h}"], level.shift(-h))
        same(whole[f"target_day{h}"], level.shift(-h))


def test_slices_keep_repeated_days(spark):
    rows = [("d", "2000-01-01", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "division string, day string, rain_sum double").select(
        "division", F.to_date("day").alias("date"), "rain_sum"
    )
    got = over_rows(df, antecedent_rain, back=6, rows_per_task=7)
    assert sorted(r["rain_sum"] for r in got.collect()) == [float(i) for i in range(50)]
    assert got.filter(F.col("rain_lag_1").isNull()).count() == 1


def test_no_slice_task_exceeds_its_bound(panel_df):
    sliced = over_rows(
        panel_df,
        lambda w: {"in_task": F.count(F.lit(1)).over(w.rowsBetween(-10_000, 10_000))},
        back=6, ahead=3, rows_per_task=50,
    )
    assert panel_df.groupBy("division").count().agg(F.max("count")).first()[0] > 1000
    assert sliced.agg(F.max("in_task")).first()[0] <= 50 + 6 + 3


def test_positions_equal_row_number(panel_df):
    placed = positions(
        panel_df.withColumn("m", F.trunc("date", "month")), ["division"], "m", ["date"]
    )
    rank = F.row_number().over(Window.partitionBy("division").orderBy("date"))
    assert placed.withColumn("r", rank).filter("r <> position").count() == 0
    assert placed.count() == panel_df.count()


def test_running_total(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i:05d}", int(v)) for i, v in enumerate(rng.integers(0, 9, 3000))]
    df = spark.createDataFrame(rows, "k string, v long").repartition(16)
    got = sorted((r["k"], r["t"]) for r in running_total(df, ["k"], "v", "t").collect())
    assert got == [(k, int(t)) for (k, _), t in zip(rows, np.cumsum([v for _, v in rows]))]


@pytest.mark.parametrize("rows_per_task", [7, 50, 1000])
def test_repeated_days_and_no_division_agree_both_ways(spark, rows_per_task):
    """Whole divisions and slices place equal days, NULL days and NULL divisions alike."""
    rng = np.random.default_rng(rows_per_task)
    rows = [
        (
            None if d == 1 else f"d{d}",
            None if i % 50 == 0 else f"2000-{1 + i // 28:02d}-{1 + i % 28:02d}",
            float(v),
        )
        for d in range(3)
        for i in range(300)
        for v in rng.integers(0, 40, 2)
    ]
    df = spark.createDataFrame(rows, "division string, day string, rain_sum double").select(
        "division", F.to_date("day").alias("date"), "rain_sum"
    )
    whole = over_rows(df, antecedent_rain, back=6)
    sliced = over_rows(df, antecedent_rain, back=6, rows_per_task=rows_per_task)
    assert sorted(map(str, whole.collect())) == sorted(map(str, sliced.collect()))
    assert whole.count() == len(rows)
