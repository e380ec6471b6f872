import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrorisk.operators import batch_profile, quality
from hydrorisk.schemas import RAIN
from hydrorisk.session import shared_path

EXACT = ["measure", "rows", "date_min", "date_max", "null_count"]


def test_merged_batches_equal_one_scan(spark, panel_df):
    path = shared_path(spark, "t-profile")
    rows = panel_df.withColumn("temperature", F.when(F.dayofmonth("date") > 3, F.dayofmonth("date") * 1.5))
    measures = [RAIN, "temperature"]
    for year in range(1990, 1996):
        part = rows.filter(F.year("date") == year)
        batch_profile.land_profile(part.withColumn(RAIN, F.lit(1e6)), path, f"{year}", measures)
        batch_profile.land_profile(part, path, f"{year}", measures)
    merged = {r["measure"]: r for r in batch_profile.merged_profile(spark, path, measures).collect()}
    exact = {r["measure"]: r for r in quality.profile(rows, measures).collect()}
    for m in measures:
        assert [merged[m][c] for c in EXACT] == [exact[m][c] for c in EXACT]
        assert merged[m]["divisions"] == pytest.approx(exact[m]["divisions"], rel=0.05)
        np.testing.assert_allclose(
            [merged[m][c] for c in ("min", "max", "mean")], [exact[m][c] for c in ("min", "max", "mean")], atol=1e-4
        )
        values = np.array([r[0] for r in rows.select(m).dropna().collect()])
        for share, estimate in zip(batch_profile.QUANTILES, merged[m]["quantiles"], strict=True):
            assert (values < estimate).mean() - 0.03 <= share <= (values <= estimate).mean() + 0.03


def test_no_batches_no_values_and_missing_divisions(spark):
    path = shared_path(spark, "t-none")
    assert batch_profile.merged_profile(spark, path, [RAIN]).first()["rows"] == 0
    empty = spark.createDataFrame([], f"date date, division string, {RAIN} double")
    batch_profile.land_profile(empty, path, "0", [RAIN])
    nothing = batch_profile.merged_profile(spark, path, [RAIN]).first()
    assert (nothing["rows"], nothing["divisions"], nothing["mean"], nothing["quantiles"]) == (0, 0, None, None)
    rows = spark.createDataFrame([(None, None, None), (None, "A", float("nan"))], empty.schema)
    batch_profile.land_profile(rows, path, "1", [RAIN])
    found = batch_profile.merged_profile(spark, path, [RAIN]).first()
    assert (found["rows"], found["divisions"], found["null_count"], found["min"]) == (2, 2, 2, None)
