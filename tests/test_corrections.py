import datetime
import random

import numpy as np
import pandas as pd

from hydrorisk.operators.windows import antecedent_rain, over_rows
from hydrorisk.session import settle, shared_path
from hydrorisk.streaming import corrections
from hydrorisk.streaming.corrections import COLUMNS, _Division, merged_rain, newest_versions, rocksdb_state, stream_corrected_rain
from tests.conftest import sorted_pandas
from tests.test_streams import append_file

SCHEMA = "division string, date date, rain_sum double"


def day(n):
    return datetime.date(2015, 1, 1) + datetime.timedelta(days=n)


def run(spark, path, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    with rocksdb_state(spark):
        query = (
            stream_corrected_rain(stream)
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{out}-progress")
            .outputMode("append")
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
    return spark.read.schema(corrections.OUTPUT).parquet(out)


def same_features(got, expected):
    got, expected = sorted_pandas(got), sorted_pandas(expected)
    assert list(map(tuple, got[["division", "date"]].values)) == list(map(tuple, expected[["division", "date"]].values))
    np.testing.assert_allclose(got[COLUMNS].astype(float), expected[COLUMNS].astype(float), rtol=1e-9, atol=1e-9)


def test_late_corrected_and_repeated_days_give_the_batch_result(spark):
    rng = random.Random(3)
    turns = [{} for _ in range(4)]
    for division, n in (("A", 120), ("B", 90), ("C", 1)):
        for i in range(n):
            if rng.random() < 0.1:
                continue
            rain = rng.choice([None, 0.0, round(rng.uniform(0, 30), 1)])
            turn = min(3, i // 30)
            # Late by a delivery, corrected in the next one, or sent again.
            late = turn + 1 if i % 30 > 20 and rng.random() < 0.3 and turn < 3 else turn
            turns[late][division, i] = rain
            if rng.random() < 0.1 and late < 3:
                turns[late + 1][division, i] = rng.choice([rain, 7.5, None])
    # Far behind what is remembered: left to the batch operator.
    turns[3].update({("A", -5): 3.0, ("A", 2): 99.0})
    path, out = shared_path(spark, "t-turns"), shared_path(spark, "t-corrected")
    final = {}
    for number, rows in enumerate(turns):
        final |= rows
        data = [(division, day(i), v) for (division, i), v in rows.items()]
        rng.shuffle(data)
        append_file(spark.createDataFrame([*data, ("A", None, 1.0)], SCHEMA), path, number)
    output = run(spark, path, out)
    panel = settle(spark.createDataFrame([(d, day(i), v) for (d, i), v in final.items()], SCHEMA))
    same_features(merged_rain(output, panel), over_rows(panel, antecedent_rain, back=6))
    kinds = {r["kind"]: r["count"] for r in output.groupBy("kind").count().collect()}
    assert set(kinds) == {"new", "late", "corrected", "redo"} and kinds["redo"] == 2
    versions = output.filter("kind <> 'redo'").groupBy("division", "date", "version").count()
    assert versions.filter("count > 1").count() == 0


def test_one_division_against_batch_windows_for_every_order():
    """The kept rows, fed in random order a few days at a time, without Spark."""
    rng = random.Random(8)
    for trial in range(60):
        days = rng.sample(range(60), rng.randint(1, 30))
        rain = {d: rng.choice([np.nan, 0.0, 1.5, 4.0]) for d in days}
        state, newest = ([], [], [], False), {}
        while days:
            division = _Division(*state)
            for _ in range(min(len(days), rng.randint(1, 6))):
                d = days.pop()
                division.put(d, rain[d])
            for d, value, *features, version, kind in division.rows():
                assert kind != "redo" and version == newest.get(d, (None, -1))[1] + 1
                newest[d] = (features, version)
            state = division.state()
        known = pd.Series(rain).sort_index()
        expected = pd.DataFrame(
            {
                "lag": known.shift(1),
                "three": known.rolling(3, min_periods=1).sum(),
                "seven": known.rolling(7, min_periods=1).sum(),
            }
        )
        got = [newest[d][0] for d in known.index]
        np.testing.assert_allclose(np.array(got, float), expected.to_numpy(), rtol=1e-9, atol=1e-9)


def test_unchanged_repeats_give_nothing(spark):
    path, out = shared_path(spark, "t-again"), shared_path(spark, "t-again-out")
    rows = [("A", day(i), float(i)) for i in range(10)] + [(None, day(0), None)]
    for turn in range(3):
        append_file(spark.createDataFrame(rows, SCHEMA), path, turn)
    output = run(spark, path, out)
    assert output.count() == 11 and newest_versions(output).count() == 11
    assert {r["kind"] for r in output.collect()} == {"new"}


def test_sums_of_all_rows_at_once():
    """Every row's sums in one pass, as of each frame by itself."""
    rng = np.random.default_rng(3)
    rain = np.where(rng.random(300) < 0.4, np.nan, rng.gamma(0.8, 12.0, 300))
    for rows in (3, 7):
        frames = [rain[max(0, i - rows + 1) : i + 1] for i in range(len(rain))]
        alone = [np.nan if np.isnan(f).all() else np.nansum(f) for f in frames]
        np.testing.assert_array_equal(corrections._sums(rain, rows), alone)
    assert len(corrections._sums(rain[:0], 3)) == 0 and corrections._sums(rain[:2], 7).shape == (2,)
