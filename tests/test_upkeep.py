import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrorisk.operators import upkeep
from hydrorisk.operators.spi import fit_spi, long_sums, transform_spi
from hydrorisk.operators.upkeep import SUMS, WINDOW_COLUMNS, FeatureStore
from hydrorisk.operators.windows import antecedent_rain, over_rows
from hydrorisk.schemas import RAIN
from hydrorisk.session import settle, shared_path
from hydrorisk.sources.committed import vacuum
from tests.conftest import random_panel, sorted_pandas, to_spark

SCHEMA = "date date, division string, rain_sum double"


@pytest.fixture(scope="module")
def long_panel(spark):
    """Thirteen years, a division with a row a month, so that its frames span many years, and one of NULL."""
    frame = random_panel(7, divisions=4, days=900, gaps=0.05)
    frame["division"] = frame["division"].replace({"div 0": "div 2x"})
    sparse = frame[frame["division"] == "div 1"].iloc[::30].assign(division="sparse")
    unnamed = frame[frame["division"] == "div 2"].assign(division=None)
    import pandas as pd

    return settle(to_spark(spark, pd.concat([frame, sparse, unnamed]), SCHEMA))


def full_rebuild(panel):
    return long_sums(over_rows(panel, antecedent_rain, back=6))


def same(got, expected):
    got, expected = sorted_pandas(got), sorted_pandas(expected)
    assert len(got) == len(expected)
    np.testing.assert_allclose(
        got[[RAIN, *WINDOW_COLUMNS]].astype(float), expected[[RAIN, *WINDOW_COLUMNS]].astype(float), rtol=1e-9, atol=1e-9
    )


def years_read(df):
    return {int(y) for file in df.inputFiles() for y in re.findall(r"year=(\d+)", file)}


def test_three_batches_equal_a_full_rebuild(spark, long_panel, monkeypatch):
    store = FeatureStore(spark, shared_path(spark, "t-store"), [RAIN])
    day = F.col("date")
    late = (day == "1991-03-05") | (day.between("1993-05-01", "1993-05-03") & (F.col("division") == "sparse"))
    base = long_panel.filter((day < "1994-01-01") & ~late)
    new = long_panel.filter((day >= "1994-01-01") & ~late)
    assert store.features().count() == 0
    assert store.update(base) == [1990, 1991, 1992, 1993]
    same(store.features(), full_rebuild(base))
    store.update(new)
    same(store.features(), full_rebuild(base.unionByName(new)))
    # Late days, and a corrected one.
    wrong = (day == "1992-02-02") & F.col("division").eqNullSafe("div 1")
    fixed = long_panel.filter(wrong).withColumn(RAIN, F.lit(77.5))
    store.update(long_panel.filter(late).unionByName(fixed))
    final = long_panel.filter(~wrong).unionByName(fixed)
    same(store.features(), full_rebuild(final))
    params = settle(fit_spi(full_rebuild(final), list(SUMS.values())))
    expected = transform_spi(full_rebuild(final), params, {c: f"spi_{n}d" for n, c in SUMS.items()})
    a, b = (sorted_pandas(d)[[f"spi_{n}d" for n in SUMS]].astype(float) for d in (store.matrix(params), expected))
    np.testing.assert_allclose(a, b, atol=1e-9)
    vacuum(spark, store.path)
    same(store.features(), full_rebuild(final))


def test_only_the_years_a_batch_reaches_are_read_and_written(spark, long_panel, monkeypatch):
    daily = long_panel.filter("division in ('div 1', 'div 2')")
    store = FeatureStore(spark, shared_path(spark, "t-store"), [RAIN])
    store.update(daily)
    everything = {r["year"] for r in daily.select(F.year("date").alias("year")).distinct().collect()}
    assert years_read(store.features()) == everything and len(everything) > 10
    read, plain = [], FeatureStore._read

    def watched(self, table, schema, years=None):
        df = plain(self, table, schema, years)
        if table == upkeep.TABLE:
            read.append(years_read(df))
        return df

    monkeypatch.setattr(FeatureStore, "_read", watched)
    one = daily.filter("division = 'div 1' and date = '1995-12-20'").withColumn(RAIN, F.lit(3.25))
    if one.count() == 0:
        one = spark.createDataFrame([(datetime.date(1995, 12, 20), "div 1", 3.25)], SCHEMA)
    # The next 179 rows lie in 1996; the 179 rows before and the counts of whole years reach 1994.
    assert store.update(one) == [1995, 1996]
    assert set().union(*read) == {1994, 1995, 1996}
    monkeypatch.undo()
    rest = daily.join(one.select("date", "division"), ["date", "division"], "left_anti")
    same(store.features(), full_rebuild(rest.select("date", "division", RAIN).unionByName(one)))


def test_empty_batches_and_days_that_are_missing(spark):
    store = FeatureStore(spark, shared_path(spark, "t-store"), [RAIN])
    assert store.update(spark.createDataFrame([], SCHEMA)) == []
    with pytest.raises(ValueError, match="without a day"):
        store.update(spark.createDataFrame([(None, "A", 1.0)], SCHEMA))
    one = spark.createDataFrame([(datetime.date(2000, 1, 1), "A", None)], SCHEMA)
    assert store.update(one) == [2000] and store.update(one) == [2000]
    assert [tuple(r) for r in store.features().collect()] == [(datetime.date(2000, 1, 1), "A", *[None] * 7)]


def test_rows_of_a_first_batch_are_written_twice(spark, long_panel, monkeypatch):
    """The batch and the table are all that is stored, no copy in between; no row is lost or told twice."""
    staged = []
    monkeypatch.setattr(upkeep, "settle", lambda df, name="stage": (staged.append(name), settle(df, name))[1])
    store = FeatureStore(spark, shared_path(spark, "t-copies"), [RAIN])
    store.update(long_panel)
    assert staged == ["batch"]
    same(store.features(), full_rebuild(long_panel))
