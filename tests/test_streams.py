import datetime
import os
from glob import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrorisk.operators.windows import antecedent_rain, over_rows
from hydrorisk.plans.stream_queries import run_to_end
from hydrorisk.session import shared_path
from hydrorisk.streaming.antecedent import stream_antecedent_rain
from hydrorisk.streaming.daily import stream_daily_means
from tests.conftest import sorted_pandas

def append_file(df, path, turn):
    """One more file of a streamed folder; file times give the order of the triggers."""
    folder = path.removeprefix("file:")
    before = set(glob(f"{folder}/*.parquet"))
    df.coalesce(1).write.mode("append").parquet(path)
    for new in set(glob(f"{folder}/*.parquet")) - before:
        os.utime(new, (1_700_000_000 + 60 * turn,) * 2)


COLUMNS = ["rain_lag_1", "rain_rolling_3d", "rain_rolling_7d"]


def test_antecedent_rain_over_several_triggers(spark, panel, panel_df):
    """State carried from file to file gives the batch result, missing values included."""
    path = shared_path(spark, "t-actuals")
    days = sorted(panel["date"].unique())
    cuts = [days[0], days[3], days[40], days[41], days[600], datetime.date(2100, 1, 1)]
    for turn, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = panel_df.filter((F.col("date") >= low) & (F.col("date") < high))
        append_file(part, path, turn)
    stream = (
        spark.readStream.schema(panel_df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    )
    got = sorted_pandas(run_to_end(stream_antecedent_rain(stream), "t-antecedent"))
    expected = sorted_pandas(over_rows(panel_df, antecedent_rain, back=6))
    assert len(got) == len(expected)
    np.testing.assert_allclose(
        got[COLUMNS].astype(float), expected[COLUMNS].astype(float), rtol=1e-9, atol=1e-9
    )


def test_late_and_repeated_days(spark):
    path = shared_path(spark, "t-late")
    schema = "division string, date date, rain_sum double"
    long = [(d, 10.0) for d in range(1, 21)]
    batches = [
        [("A", 1, 1.0), ("A", 2, 2.0), ("A", 4, 4.0), ("A", 4, 4.0)] + [("B", d, v) for d, v in long],
        [("A", 3, 3.0), ("A", 2, 2.0), ("B", 6, 10.0), ("B", 20, 10.0)],
        [("A", 5, 5.0), ("B", 21, 1.0)],
    ]
    for turn, rows in enumerate(batches):
        data = [(k, datetime.date(2015, 1, d), v) for k, d, v in rows]
        append_file(spark.createDataFrame(data, schema), path, turn)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = run_to_end(stream_antecedent_rain(stream), "t-late-out").collect()
    days = {r["date"].day: r for r in rows if r["division"] == "A"}
    assert days[3]["late"] and days[3]["rain_lag_1"] == 2.0 and days[3]["rain_rolling_3d"] == 6.0
    assert not days[5]["late"] and days[5]["rain_lag_1"] == 4.0 and days[5]["rain_rolling_3d"] == 12.0
    late = [r for r in rows if r["division"] == "B" and r["late"]]
    # Day 6 lies before all that is remembered: nothing can be said; day 20 came twice.
    assert [(r["date"].day, r["rain_lag_1"], r["rain_rolling_7d"]) for r in late] == [(6, None, None)]
    assert len(rows) == 5 + 20 + 1 + 1
    last = next(r for r in rows if r["division"] == "B" and r["date"].day == 21)
    assert last["rain_rolling_7d"] == 61.0 and last["rain_lag_1"] == 10.0


@pytest.fixture(params=["UTC", "Asia/Colombo", "America/New_York"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_daily_means_and_watermark(spark, zone):
    path = shared_path(spark, "t-hours")
    schema = "division string, ts timestamp_ntz, v double, u double"
    start = datetime.datetime(2024, 1, 1)
    first = [("A", start + datetime.timedelta(hours=h), float(h), None) for h in range(96)]
    first += [("B", start, None, None), ("B", start, None, 2.0)]
    late = [("A", start, 1000.0, 1.0), ("A", start + datetime.timedelta(hours=200), 1.0, 1.0)]
    more = [("B", start + datetime.timedelta(hours=95), 4.0, None)]
    # a trigger drops what the watermark of the trigger before had passed
    for turn, rows in enumerate((first, more, late)):
        append_file(spark.createDataFrame(rows, schema), path, turn)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = run_to_end(stream_daily_means(stream, ["v", "u"]), "t-daily").collect()
    got = {(r["division"], r["date"].day): (r["v"], r["u"]) for r in rows}
    # the reading of day 1 in the last file comes too late
    assert got == {
        ("A", 1): (11.5, None), ("A", 2): (35.5, None), ("A", 3): (59.5, None),
        ("A", 4): (83.5, None), ("B", 1): (None, 2.0), ("B", 4): (4.0, None),
    }
