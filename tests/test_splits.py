import datetime

from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hydrorisk.operators import splits
from tests.conftest import to_spark


def keys(df):
    return sorted((r["division"], r["date"]) for r in df.select("division", "date").collect())


@pytest.mark.parametrize("rows", [1, 7, 100, 1000, 2500, 10_000])
def test_tail_matches_pandas(panel, panel_df, rows):
    ordered = panel.sort_values(["division", "date"])
    train, test = splits.split_tail(panel_df, rows)
    expected = ordered.iloc[-rows:]
    assert keys(test) == sorted(zip(expected["division"], expected["date"]))
    assert train.count() == max(len(panel) - rows, 0)


@pytest.mark.parametrize("share", [0.0, 0.37, 0.8, 1.0])
def test_fraction_matches_pandas(panel, panel_df, share):
    ordered = panel.sort_values(["division", "date"])
    head, rest = splits.split_fraction(panel_df, share)
    n = int(len(panel) * share)
    assert keys(head) == sorted(zip(ordered["division"][:n], ordered["date"][:n]))
    assert rest.count() == len(panel) - n


def test_cut_among_repeated_days(spark):
    day = pd.Timestamp("2000-01-01").date()
    frame = pd.DataFrame(
        [(day, "a", float(i)) for i in range(30)] + [(day, "b", 1.0)] * 10,
        columns=["date", "division", "rain_sum"],
    )
    df = to_spark(spark, frame, "date date, division string, rain_sum double")
    for rows in (3, 10, 15, 39):
        train, test = splits.split_tail(df, rows)
        assert (train.count(), test.count()) == (40 - rows, rows)
        both = Counter(map(tuple, train.unionByName(test).collect()))
        assert both == Counter(map(tuple, df.collect()))


def test_rows_without_key_stay_in_the_tail(spark, panel_df):
    nameless = panel_df.limit(3).withColumn("division", F.lit(None).cast("string"))
    undated = panel_df.limit(6).withColumn("date", F.lit(None).cast("date"))
    everything = panel_df.unionByName(nameless).unionByName(undated)
    train, test = splits.split_tail(everything, 50)
    assert train.filter("division IS NULL").count() == 0
    assert test.filter("division IS NULL").count() == 3
    assert train.count() + test.count() == everything.count()
    assert train.exceptAll(everything).count() == 0


def test_rows_must_be_positive(panel_df):
    with pytest.raises(ValueError):
        splits.split_tail(panel_df, 0)


def test_temporal(panel_df):
    parts = splits.split_temporal(panel_df, "1990-06-01", "1991-01-01")
    assert sum(p.count() for p in parts) == panel_df.count()
    assert str(parts[1].agg(F.min("date")).first()[0]) >= "1990-06-01"
    assert str(parts[1].agg(F.max("date")).first()[0]) < "1991-01-01"


def test_folds_are_balanced_within_classes(panel_df):
    classed = panel_df.withColumn("y", (F.coalesce("rain_sum", F.lit(0.0)) > 20).cast("int"))
    dealt = splits.stratified_folds(classed, "y", folds=3, seed=1)
    assert dealt.columns == [*classed.columns, "fold"]
    sizes = Counter((r["y"], r["fold"]) for r in dealt.collect())
    assert sum(sizes.values()) == classed.count()
    for y in (0, 1):
        counts = [sizes[(y, k)] for k in range(3)]
        assert max(counts) - min(counts) <= 1
    again = {(r["division"], r["date"]): r["fold"] for r in dealt.collect()}
    other = splits.stratified_folds(classed.repartition(5), "y", folds=3, seed=1)
    assert again == {(r["division"], r["date"]): r["fold"] for r in other.collect()}
    reseeded = splits.stratified_folds(classed, "y", folds=3, seed=2)
    assert again != {(r["division"], r["date"]): r["fold"] for r in reseeded.collect()}


def test_folds_of_rows_without_a_class_are_even(spark):
    first = datetime.date(2000, 1, 1)
    rows = [
        ("d", first + datetime.timedelta(days=i), None if i % 3 else 1) for i in range(150)
    ]
    df = spark.createDataFrame(rows, "division string, date date, c int")
    sizes = splits.stratified_folds(df, "c", 3).groupBy("c", "fold").count().collect()
    for kind in (None, 1):
        own = [r["count"] for r in sizes if r["c"] == kind]
        assert len(own) == 3 and max(own) - min(own) <= 1


def test_folds_move_the_rows_once(spark):
    """Ranks and block sizes meet without a second shuffle of the rows; NULL classes keep their folds."""
    df = spark.range(500).select(
        F.col("id").cast("string").alias("division"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("c"),
        F.rand(1).alias("wide"),
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = splits.stratified_folds(df, "c", 3)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hash") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert dealt.count() == 500
    digest = F.md5(F.concat_ws("|", "division", "date", F.lit("42")))
    place = F.row_number().over(Window.partitionBy("c").orderBy(digest, "division", "date"))
    plain = df.withColumn("fold", ((place - 1) % 3).cast("int"))
    assert plain.exceptAll(dealt).isEmpty()
