import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from hydrorisk.session import staging
from tests.compare import normal, open_duck

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return open_duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    with staging(spark):
        mine = entry.queries()[name](spark, SF).toArrow()
    assert normal(mine) == normal(duck.sql(ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    with staging(spark):
        assert entry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).columns == ["division", "year_month", "severity", "days"]


def test_missing_divisions_reads_orders_of_all_days(spark, tmp_path):
    """A customer whose only order is old has one, in Spark and in the SQL."""
    days = {1: datetime.date(1992, 1, 1), 2: datetime.date(1999, 1, 1)}
    orders = [(customer, day) for customer, day in days.items()]
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey bigint").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_custkey bigint, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    mine = entry.queries()["missing_divisions"](spark, str(tmp_path))
    duck = duckdb.connect()
    for t in ("customer", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert [r["id"] for r in mine.collect()] == ["3"]
    assert duck.sql(ORACLES["missing_divisions"]).fetchall() == [("3",)]
