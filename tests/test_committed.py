import datetime

import pytest
from pyspark.sql import functions as F

from hydrorisk.schemas import RAIN, measurement_schema
from hydrorisk.session import shared_path
from hydrorisk.sources import committed
from hydrorisk.sources.landing import pending
from tests.test_streams import append_file

SCHEMA = measurement_schema([RAIN])


def day(n):
    return datetime.date(2015, 1, 1) + datetime.timedelta(days=n)


def rows_of(spark, path, **kw):
    return sorted(map(tuple, committed.read_committed(spark, path, SCHEMA, **kw).collect()), key=str)


def test_nothing_is_read_before_its_commit(spark, monkeypatch):
    path = shared_path(spark, "t-commits")
    assert rows_of(spark, path) == [] and committed.committed_manifest(spark, path).count() == 0
    one, two = [(day(0), "007", 1.0), (day(0), None, 2.0)], [(day(1), "B", 3.0)]
    committed.land_committed(spark.createDataFrame(one, SCHEMA), path, "rain", "1")

    def crash(*_, **__):
        raise RuntimeError("killed before the commit")

    with monkeypatch.context() as patch:
        patch.setattr(committed, "commit", crash)
        with pytest.raises(RuntimeError, match="killed"):
            committed.land_committed(spark.createDataFrame(two, SCHEMA), path, "rain", "2")
    assert rows_of(spark, path) == sorted(one, key=str)
    marked = {(r["task"], r["division"]) for r in committed.committed_manifest(spark, path).collect()}
    assert marked == {("rain", "007"), ("rain", None)}
    committed.land_committed(spark.createDataFrame(two, SCHEMA), path, "rain", "2")
    assert rows_of(spark, path) == sorted(one + two, key=str)
    assert rows_of(spark, path, task="soil") == [] and rows_of(spark, path, batches=["2"]) == two
    # The killed attempt is all that goes.
    assert committed.vacuum(spark, path) == 1
    assert rows_of(spark, path) == sorted(one + two, key=str)
    registry = spark.createDataFrame([("007",), ("Z",)], "id string")
    left = pending(registry, committed.committed_manifest(spark, path), "rain")
    assert [r["id"] for r in left.collect()] == ["Z"]


def test_compaction_under_an_open_reader_and_a_batch_landed_again(spark):
    path = shared_path(spark, "t-compact")
    for batch in range(6):
        rows = [(day(batch), division, float(batch)) for division in ("A", "B")]
        committed.land_committed(spark.createDataFrame(rows, SCHEMA), path, "rain", f"{batch}")
    committed.land_committed(spark.createDataFrame([(day(9), "C", 9.0)], SCHEMA), path, "soil", "0")
    before = rows_of(spark, path)
    reader = committed.read_committed(spark, path, SCHEMA, "rain")
    assert committed.compact(spark, path, SCHEMA, "rain") == 6
    assert rows_of(spark, path) == before
    assert reader.count() == 12
    files = committed.read_committed(spark, path, SCHEMA, "rain").select(F.input_file_name()).distinct()
    assert files.count() == 1
    # A batch that lands again leaves its old rows in the compacted files unread.
    committed.land_committed(spark.createDataFrame([(day(2), "A", 20.0)], SCHEMA), path, "rain", "2")
    expected = [r for r in before if r[0] != day(2)] + [(day(2), "A", 20.0)]
    assert rows_of(spark, path) == sorted(expected, key=str)
    assert committed.compact(spark, path, SCHEMA, "rain") == 6
    assert committed.compact(spark, path, SCHEMA, "soil") == 0
    committed.vacuum(spark, path)
    assert rows_of(spark, path) == sorted(expected, key=str)
    attempts = {r["attempt"] for r in committed.current_commits(spark, path).collect()}
    assert len(attempts) == 2


def test_a_stream_killed_between_write_and_commit_resumes(spark, monkeypatch):
    source, clean, broken = (shared_path(spark, f"t-{n}") for n in ("source", "clean", "broken"))
    for turn in range(4):
        rows = [(day(10 * turn + i), f"{i % 3}", float(turn)) for i in range(10)]
        append_file(spark.createDataFrame(rows, SCHEMA), source, turn)

    def run(path):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = (
            stream.writeStream.foreachBatch(committed.landing_sink(path, "rain"))
            .option("checkpointLocation", f"{path}-progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run(clean)
    whole = committed.commit

    def crash_at_third(spark, path, task, batches, attempt, note=None):
        if batches == ["000000000000000002"]:
            raise RuntimeError("killed before the commit")
        whole(spark, path, task, batches, attempt, note)

    with monkeypatch.context() as patch:
        patch.setattr(committed, "commit", crash_at_third)
        with pytest.raises(Exception, match="killed before the commit"):
            run(broken)
    assert len(rows_of(spark, broken)) == 20
    run(broken)
    assert rows_of(spark, broken) == rows_of(spark, clean) and len(rows_of(spark, clean)) == 40
    run(broken)
    assert len(rows_of(spark, broken)) == 40
