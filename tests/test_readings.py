import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hydrorisk.session import shared_path
from hydrorisk.sources import committed
from hydrorisk.streaming import readings as module
from hydrorisk.streaming.readings import DailyReadings
from tests.test_streams import append_file

SCHEMA = "division string, ts timestamp_ntz, v double, u double"
START = datetime.datetime(2024, 1, 1)


def at(hours):
    return START + datetime.timedelta(hours=hours)


def run(spark, source, sink, path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{path}-progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def brute(batches, delay=24):
    """Parts by division and day: (readings, repeats, mean of v) of closed and open, dropped counts."""
    passed, seen, sums, closed, dropped = None, set(), {}, {}, Counter()
    for batch in batches:
        known = [r for r in batch if r[2] is not None or r[3] is not None]
        best = {}
        for division, ts, v, u in known:
            end = datetime.datetime.combine(ts.date() + datetime.timedelta(days=1), datetime.time())
            if passed is not None and end <= passed:
                dropped[division, ts.date()] += 1
                continue
            cell = sums.setdefault((division, ts.date()), [0, 0, []])
            if (division, ts) in seen:
                cell[1] += 1
                continue
            old = best.get((division, ts))
            rank = lambda r: tuple((x is not None, x or 0) for x in r)
            if old is None or rank((v, u)) < rank(old):
                best[division, ts] = (v, u)
            cell[1] += old is not None
        for (division, ts), (v, _) in best.items():
            cell = sums[division, ts.date()]
            cell[0] += 1
            cell[2] += [] if v is None else [v]
        seen |= set(best)
        times = [r[1] - datetime.timedelta(hours=delay) for r in known]
        passed = max([*times, *([passed] if passed else [])], default=None)
        for key in list(sums):
            if passed and datetime.datetime.combine(key[1] + datetime.timedelta(days=1), datetime.time()) <= passed:
                closed[key] = sums.pop(key)
        seen = {(d, ts) for d, ts in seen if (d, ts.date()) in sums}
    mean = lambda c: (c[0], c[1], round(sum(c[2]) / len(c[2]), 4) if c[2] else None)
    return {k: mean(c) for k, c in closed.items()}, {k: mean(c) for k, c in sums.items()}, dict(dropped)


def got(parts, spark):
    def listed(df):
        return {(r["division"], r["date"]): (r["readings"], r["repeated"], r["v"]) for r in df.collect()}

    schema = spark.createDataFrame([], SCHEMA).schema
    dropped = Counter((r["division"], r["date"]) for r in parts.dropped(spark, schema).collect())
    return listed(parts.closed(spark)), listed(parts.open(spark)), dict(dropped)


def deliveries(seed, batches=5):
    """Hourly readings in order, some late by hours or days, some delivered again."""
    rng = random.Random(seed)
    turns = [[] for _ in range(batches)]
    for hour in range(0, 24 * 3 * batches, 3):
        for division in ("A", "B", None):
            v = rng.choice([None, round(rng.uniform(0, 9), 1)])
            row = (division, at(hour), v, rng.choice([None, 1.0]))
            turn = min(batches - 1, hour // 72 + rng.choice([0, 0, 0, 0, 1, 2]))
            turns[turn].append(row)
            if rng.random() < 0.2:
                turns[min(batches - 1, turn + rng.choice([0, 1]))].append(row)
    return turns


@pytest.mark.parametrize("seed", [1])
def test_parts_equal_brute_force_also_after_a_crash(spark, monkeypatch, seed):
    source, path = shared_path(spark, "t-source"), shared_path(spark, "t-parts")
    turns = deliveries(seed)
    for turn, rows in enumerate(turns):
        append_file(spark.createDataFrame(rows, SCHEMA), source, turn)
    parts = DailyReadings(path, ["v", "u"])
    whole = module.commit

    def crash(spark, path, task, batches, attempt, note=None):
        if batches == [f"{2:018d}"]:
            raise RuntimeError("killed before the commit")
        whole(spark, path, task, batches, attempt, note)

    with monkeypatch.context() as patch:
        patch.setattr(module, "commit", crash)
        with pytest.raises(Exception, match="killed before the commit"):
            run(spark, source, parts.sink(), path)
    assert got(parts, spark) == brute(turns[:2])
    run(spark, source, parts.sink(), path)
    closed, still_open, dropped = brute(turns)
    assert got(parts, spark) == (closed, still_open, dropped)
    assert closed and still_open and dropped
    delivered = sum(r[2] is not None or r[3] is not None for turn in turns for r in turn)
    counted = sum(n + m for n, m, _ in [*closed.values(), *still_open.values()])
    assert counted + sum(dropped.values()) == delivered
    # Only what a commit points to is there to read.
    committed.vacuum(spark, path)
    assert got(parts, spark) == (closed, still_open, dropped)


def test_empty_batches_and_other_columns(spark):
    path = shared_path(spark, "t-empty")
    parts = DailyReadings(path, ["v"])
    empty = spark.createDataFrame([], SCHEMA)
    parts.sink()(empty, 0)
    rows = [("A", at(1), 1.0, None), ("A", at(1), 1.0, None), ("A", None, 4.0, None), ("A", at(2), None, None)]
    parts.sink()(spark.createDataFrame(rows, SCHEMA).withColumn("_old", F.lit("x")), 1)
    parts.sink()(empty, 2)
    assert parts.closed(spark).count() == 0
    found = {r["date"]: (r["readings"], r["repeated"], r["v"]) for r in parts.open(spark).collect()}
    assert found == {START.date(): (1, 1, 1.0), None: (1, 0, 4.0)}
    assert [tuple(r) for r in parts.batches(spark).orderBy("batch").collect()][0] == (0, None)
