import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrorisk.operators import baseline
from hydrorisk.operators.spi import fit_spi, spi_against_baseline
from hydrorisk.schemas import RAIN
from hydrorisk.session import shared_path, settle
from hydrorisk.sources.committed import current_commits

PARAMS = [f"{RAIN}_{p}" for p in ("n", "q", "alpha", "beta")]


def same(one, two):
    a, b = (d.orderBy("division").toPandas().set_index("division") for d in (one, two))
    assert list(a.index) == list(b.index)
    np.testing.assert_allclose(a[PARAMS].astype(float), b[PARAMS].astype(float), rtol=1e-9, atol=1e-12)


def test_batches_added_replaced_and_removed_equal_full_refits(spark, panel_df):
    path = shared_path(spark, "t-baseline")
    year = F.year("date")
    batches = {str(y): panel_df.filter(year == y) for y in (1990, 1991, 1992)}
    for name, rows in batches.items():
        baseline.add_to_baseline(rows, path, name)
        baseline.add_to_baseline(rows, path, name)
    same(baseline.baseline_params(spark, path), fit_spi(panel_df.filter(year <= 1992), [RAIN]))
    # A corrected batch takes the old one's place.
    corrected = batches["1991"].withColumn(RAIN, F.col(RAIN) * 1.5 + 0.1)
    baseline.add_to_baseline(corrected, path, "1991")
    now = batches["1990"].unionByName(batches["1992"]).unionByName(corrected)
    same(baseline.baseline_params(spark, path), fit_spi(now, [RAIN]))
    # Compaction changes nothing, and a batch can be taken out after it.
    assert baseline.compact_baseline(spark, path) == 3
    same(baseline.baseline_params(spark, path), fit_spi(now, [RAIN]))
    baseline.remove_from_baseline(spark, path, "1992")
    left = batches["1990"].unionByName(corrected)
    same(baseline.baseline_params(spark, path), fit_spi(left, [RAIN]))
    assert current_commits(spark, path).count() == 3


def test_taking_away_a_batch_of_huge_values_leaves_the_rest_exact(spark):
    path = shared_path(spark, "t-huge")
    small = settle(spark.range(200).select(F.lit("A").alias("division"), (F.col("id") * 0.01 + 0.003).alias(RAIN)))
    huge = spark.range(50).select(F.lit("A").alias("division"), (F.col("id") + 1e15).alias(RAIN))
    baseline.add_to_baseline(small, path, "1")
    before = baseline.baseline_statistics(spark, path).first()
    baseline.add_to_baseline(huge, path, "2")
    baseline.remove_from_baseline(spark, path, "2")
    assert baseline.baseline_statistics(spark, path).first() == before
    same(baseline.baseline_params(spark, path), fit_spi(small, [RAIN]))


def test_no_rows_no_positive_values_and_missing_ones(spark):
    path = shared_path(spark, "t-none")
    assert baseline.baseline_params(spark, path).collect() == []
    rows = [("A", 0.0), ("A", None), ("B", None), (None, 1.0), (None, 2.0), ("A", float("nan"))]
    df = spark.createDataFrame(rows, f"division string, {RAIN} double")
    baseline.add_to_baseline(df, path, "1")
    same(baseline.baseline_params(spark, path), fit_spi(df, [RAIN]))
    scored = spi_against_baseline(df, baseline.baseline_params(spark, path))
    assert scored.filter("division is null").count() == 2


@pytest.mark.parametrize("cut", [1, 7])
def test_statistics_do_not_depend_on_the_split(spark, panel_df, cut):
    whole = baseline.batch_statistics(panel_df, [RAIN])
    parts = [baseline.batch_statistics(panel_df.filter(F.pmod(F.dayofmonth("date"), cut) == k), [RAIN]) for k in range(cut)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    exact = ["division", f"{RAIN}_n", f"{RAIN}_zeros", f"{RAIN}_sum_whole", f"{RAIN}_log_whole"]
    assert baseline.merged(union).select(exact).exceptAll(whole.select(exact)).count() == 0
