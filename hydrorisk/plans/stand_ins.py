"""The given tables read as climate data, in Spark and as SQL text for the checks.

* nations: rain from orders by customer nation and day, temperature and soil
  from line items by supplier nation and ship day (soil on returned lines only,
  so the full outer join has gaps);
* stations: one division per supplier, rain from returned lines (days without
  returns are dry), so that divisions grow in number with the data.

Money and rates have two decimals and are summed as whole hundredths, so the sums
are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrorisk.operators.panel import assemble_panel
from hydrorisk.schemas import DATE, DIVISION, MEASURES, RAIN, SOIL, TEMPERATURE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exact_sum(value: Column) -> Column:
    return F.sum(F.rint(value * 100.0).cast("bigint")) / 100.0


def _exact_mean(value: Column) -> Column:
    return F.try_divide(_exact_sum(value), F.count(value).cast("double"))


def nation_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("c_nationkey").cast("string").alias(DIVISION),
            F.to_date("o_orderdate").alias(DATE),
        )
        .agg((_exact_sum(F.col("o_totalprice")) / 10000).alias(RAIN))
        .select(DATE, DIVISION, RAIN)
    )


def _nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier")
    return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).withColumns(
        {
            DIVISION: F.col("s_nationkey").cast("string"),
            DATE: F.to_date("l_shipdate"),
        }
    )


def nation_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _nation_lines(spark, sf_dir).groupBy(DATE, DIVISION)
    return means.agg(_exact_mean(F.col("l_quantity")).alias(TEMPERATURE))


def nation_soil(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = _nation_lines(spark, sf_dir).filter(F.col("l_returnflag") == "R")
    return returned.groupBy(DATE, DIVISION).agg(
        _exact_mean(F.col("l_discount")).alias(SOIL[0]),
        _exact_mean(F.col("l_tax")).alias(SOIL[1]),
        (_exact_mean(F.col("l_quantity")) / 100).alias(SOIL[2]),
    )


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_panel(
        nation_rain(spark, sf_dir), nation_temperature(spark, sf_dir), nation_soil(spark, sf_dir)
    )


def station_panel(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Stations by day; ``together`` shuffles the lines by division, and windows on the panel need no other."""
    lines = table(spark, sf_dir, "lineitem").withColumn(DIVISION, F.col("l_suppkey").cast("string"))
    if together:
        lines = lines.repartition(DIVISION)
    returned = F.col("l_returnflag") == "R"
    return (
        lines.groupBy(F.to_date("l_shipdate").alias(DATE), DIVISION)
        .agg(
            (_exact_sum(F.when(returned, F.col("l_extendedprice")).otherwise(0)) / 1000).alias(RAIN),
            _exact_mean(F.col("l_quantity")).alias(TEMPERATURE),
            (8 * _exact_mean(F.when(returned, F.col("l_discount")))).alias(SOIL[0]),
            (10 * _exact_mean(F.when(returned, F.col("l_tax")))).alias(SOIL[1]),
            (_exact_mean(F.col("l_quantity")) / 100).alias(SOIL[2]),
        )
        .select(DATE, DIVISION, *MEASURES)
    )


def nation_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.col("n_name").alias("district"),
        F.col("r_name").alias("province"),
    )


def station_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of the stations: supplier, its nation as district, its region as province."""
    places = nation_registry(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(places, F.col("s_nationkey").cast("string") == F.col("id")).select(
        F.col("s_suppkey").cast("string").alias("id"), "district", "province"
    )


def _sum_sql(value: str) -> str:
    return f"CAST(SUM(CAST({value} AS DECIMAL(18,2))) AS DOUBLE)"


def _mean_sql(value: str) -> str:
    return f"({_sum_sql(value)} / NULLIF(CAST(COUNT({value}) AS DOUBLE), 0))"


def _returned(value: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN l_returnflag = 'R' THEN {value} ELSE {otherwise} END"


NATION_RAIN_SQL = f"""
rain AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(c_nationkey AS VARCHAR) AS division,
         {_sum_sql("o_totalprice")} / 10000 AS rain_sum
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

NATION_SQL = f"""{NATION_RAIN_SQL},
temperature AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(s_nationkey AS VARCHAR) AS division,
         {_mean_sql("l_quantity")} AS temperature_2m_mean
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
soil AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(s_nationkey AS VARCHAR) AS division,
         {_mean_sql("l_discount")} AS soil_moisture_7_to_28cm,
         {_mean_sql("l_tax")} AS soil_moisture_28_to_100cm,
         {_mean_sql("l_quantity")} / 100 AS soil_moisture_100_to_255cm
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_returnflag = 'R' GROUP BY 1, 2),
panel AS (
  SELECT * FROM rain FULL JOIN temperature USING (date, division)
                     FULL JOIN soil USING (date, division))"""

STATION_SQL = f"""
panel AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS division,
         {_sum_sql(_returned("l_extendedprice", "0"))} / 1000 AS rain_sum,
         {_mean_sql("l_quantity")} AS temperature_2m_mean,
         8 * {_mean_sql(_returned("l_discount"))} AS soil_moisture_7_to_28cm,
         10 * {_mean_sql(_returned("l_tax"))} AS soil_moisture_28_to_100cm,
         {_mean_sql("l_quantity")} / 100 AS soil_moisture_100_to_255cm
  FROM lineitem GROUP BY 1, 2)"""

NATION_REGISTRY_SQL = """
registry AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS district, r_name AS province
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

STATION_REGISTRY_SQL = """
registry AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, n_name AS district, r_name AS province
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey)"""
