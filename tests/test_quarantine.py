import datetime
import json

from hydrorisk.schemas import RAIN
from hydrorisk.session import shared_path
from hydrorisk.sources import documents, quarantine, tables


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def rejects(checked):
    return {(r["file"].rsplit("/", 1)[1], r["record"], r["reason"]) for r in checked.rejects.collect()}


def test_broken_csv_rows_come_back_with_file_and_text(spark, tmp_path):
    folder = tmp_path / "rain"
    write(folder, "a.csv", "date,division,rain_sum\n2015-01-01,A,1.5\n2015-01-02,A,\nyesterday,A,2\n2015-01-04,B,wet\n")
    write(folder, "b.csv", "date,division,rain_sum\n2015-01-05,B,2.5\n2015-01-06,B\n2015-01-07,,3\n2015-01-08,B,NaN\n")
    checked = quarantine.read_measurement_checked(spark, str(folder), [RAIN])
    day = lambda n: datetime.date(2015, 1, n)
    good = [(day(1), "A", 1.5), (day(2), "A", None), (day(5), "B", 2.5), (day(8), "B", None)]
    assert sorted(map(tuple, checked.rows.collect()), key=str) == sorted(good, key=str)
    found = rejects(checked)
    assert found == {
        ("a.csv", "2015-01-04,B,wet", "malformed"),
        ("a.csv", "yesterday,A,2", "malformed"),
        ("b.csv", "2015-01-06,B", "malformed"),
        ("b.csv", None, "no key"),
    }
    # Good rows are those of the plain reader.
    plain = tables.read_measurement(spark, str(folder), [RAIN])
    assert checked.rows.exceptAll(plain).count() == 0
    path = shared_path(spark, "t-rejects")
    quarantine.keep_rejects(checked, path)
    assert quarantine.keep_rejects(checked, path).count() == 2 * len(found)


def test_broken_documents_come_back_with_file_and_text(spark, tmp_path):
    folder = tmp_path / "docs"
    whole = {"division": "A", "daily": {"time": ["2015-01-01"], "rain_sum": [1.0]}}
    cut = json.dumps(whole)[:30]
    nameless = json.dumps({"daily": {"time": ["2015-01-01"], "rain_sum": [2.0]}})
    failed = json.dumps({"division": "F", "daily": {"time": []}})
    wrong = json.dumps({"division": "W", "daily": {"time": ["2015-01-01"], "rain_sum": ["wet"]}})
    write(folder, "one.json", "\n".join([json.dumps(whole), cut, nameless]))
    write(folder, "two.json", "\n".join([failed, wrong]))
    checked = quarantine.read_documents_checked(spark, str(folder), "daily", [RAIN])
    assert rejects(checked) == {
        ("one.json", cut, "malformed"),
        ("one.json", None, "no key"),
        ("two.json", wrong, "malformed"),
    }
    rows = documents.explode_daily(checked.rows, [RAIN]).collect()
    assert [tuple(r) for r in rows] == [(datetime.date(2015, 1, 1), "A", 1.0)]
    assert [r["division"] for r in documents.failed_documents(checked.rows, "daily").collect()] == ["F"]


def test_files_without_rows(spark, tmp_path):
    folder = tmp_path / "empty"
    write(folder, "a.csv", "date,division,rain_sum\n")
    checked = quarantine.read_measurement_checked(spark, str(folder), [RAIN])
    assert checked.rows.collect() == [] and checked.rejects.collect() == []
