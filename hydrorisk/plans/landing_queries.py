"""Queries over sources, documents, manifests and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrorisk.functions.scalars import (
    by_district,
    by_province,
    local_day,
    name_tokens,
    round_decimal,
    safe_double,
)
from hydrorisk.operators import quality
from hydrorisk.operators.panel import with_backfill, with_registry
from hydrorisk.plans.register import TIE_FREE, query, scaled, scaled_list, scaled_sql
from hydrorisk.plans.stand_ins import (
    NATION_RAIN_SQL,
    NATION_SQL,
    STATION_REGISTRY_SQL,
    STATION_SQL,
    nation_panel,
    nation_rain,
    nation_registry,
    station_panel,
    station_registry,
    table,
)
from hydrorisk.schemas import DATE, DIVISION, MEASURES, RAIN, SOIL, measurement_schema
from hydrorisk.session import shared_path
from hydrorisk.sources import documents, landing, tables
from hydrorisk.sources.registry import read_registry


@query(f"WITH {NATION_RAIN_SQL} SELECT date, division, {scaled_sql('rain_sum')} FROM rain")
def measurement_csv(spark, sf_dir):
    path = shared_path(spark, "rain-csv")
    tables.write_csv(nation_rain(spark, sf_dir), path)
    rows = tables.read_measurement(spark, path, [RAIN])
    return rows.select(DATE, DIVISION, scaled(RAIN))


@query(
    f"WITH {NATION_SQL} SELECT date, division, {scaled_list(MEASURES)} FROM panel"
    " WHERE date >= DATE '1998-03-01'"
)
def stored_panel(spark, sf_dir):
    path = shared_path(spark, "panel")
    tables.write_panel(nation_panel(spark, sf_dir), path)
    rows = tables.read_panel(spark, path, first_day="1998-03-01")
    return rows.select(DATE, DIVISION, *[scaled(m) for m in MEASURES])


def _vector_documents(spark, sf_dir, block, arrays):
    """JSON text per vector: its elements as measures over a made time axis; the
    label shortens the first measure, and vectors of class 0 have no time axis."""
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "_x", F.transform("embedding", lambda x: x.cast("double"))
    )
    step, form = ("interval 1 day", "yyyy-MM-dd") if block == "daily" else (
        "interval 1 hour", "yyyy-MM-dd'T'HH:mm")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    times = F.transform(
        F.sequence(F.lit(0), F.size("_x") - 1),
        lambda i: F.date_format(
            start + F.make_interval(days=i) if block == "daily"
            else start + F.make_interval(hours=i), form),
    )
    body = F.struct(
        F.when(F.col("label") != 0, times).alias("time"),
        *[value.alias(name) for name, value in arrays.items()],
    )
    return vectors.select(
        F.to_json(
            F.struct(F.col("vec_id").cast("string").alias(DIVISION), body.alias(block))
        ).alias("text")
    )


def _shortened(column):
    return F.slice(column, F.lit(1), F.size(column) - F.col("label"))


_ELEMENTS_SQL = """
elements AS (
  SELECT CAST(vec_id AS VARCHAR) AS division, label, len(embedding) AS size, embedding,
         UNNEST(range(1, len(embedding) + 1)) AS i
  FROM embeddings WHERE label <> 0)"""


@query(
    f"""WITH {_ELEMENTS_SQL}
    SELECT division, CAST(DATE '2024-01-01' + CAST(i - 1 AS INTEGER) AS DATE) AS date,
           {scaled_sql("CAST(embedding[i] AS DOUBLE)", "rain_sum")}
    FROM elements WHERE i <= size - label"""
)
def daily_documents(spark, sf_dir):
    text = _vector_documents(spark, sf_dir, "daily", {RAIN: _shortened(F.col("_x"))})
    rows = documents.explode_daily(
        documents.parse_documents(text, "text", "daily", [RAIN]), [RAIN]
    )
    return rows.select(DIVISION, DATE, scaled(RAIN))


def _hourly(spark, sf_dir):
    x = F.col("_x")
    wet = F.transform(x, lambda v: F.when(v > 0, v))
    arrays = {SOIL[0]: _shortened(wet), SOIL[1]: F.reverse(x), SOIL[2]: x}
    text = _vector_documents(spark, sf_dir, "hourly", arrays)
    return documents.explode_hourly(
        documents.parse_documents(text, "text", "hourly", SOIL), SOIL
    )


_HOURLY_SQL = f"""{_ELEMENTS_SQL},
hours AS (
  SELECT division, TIMESTAMP '2024-01-01' + to_hours(CAST(i - 1 AS INTEGER)) AS ts,
         CASE WHEN embedding[i] > 0 THEN CAST(embedding[i] AS DOUBLE) END
           AS soil_moisture_7_to_28cm,
         CAST(embedding[size + 1 - i] AS DOUBLE) AS soil_moisture_28_to_100cm,
         CAST(embedding[i] AS DOUBLE) AS soil_moisture_100_to_255cm
  FROM elements WHERE i <= size - label)"""


@query(
    f"""WITH {_HOURLY_SQL}
    SELECT division, strftime(ts, '%Y-%m-%dT%H:%M') AS time, CAST(ts AS DATE) AS date,
           {scaled_list(SOIL)}
    FROM hours"""
)
def hourly_documents(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    return rows.select(DIVISION, "time", DATE, *[scaled(m) for m in SOIL])


@query(
    f"""WITH {_HOURLY_SQL},
    daily AS (SELECT division, CAST(ts AS DATE) AS date,
              {", ".join(f"AVG({m}) AS {m}" for m in SOIL)} FROM hours
              WHERE COALESCE({", ".join(SOIL)}) IS NOT NULL GROUP BY 1, 2)
    SELECT division, date, {scaled_list(SOIL, 9)} FROM daily"""
)
def hourly_documents_to_daily(spark, sf_dir):
    daily = documents.hourly_to_daily(_hourly(spark, sf_dir), SOIL, digits=None)
    return daily.select(DIVISION, DATE, *[scaled(m, 9) for m in SOIL])


@query(
    f"""WITH daily AS (SELECT CAST(user_id AS VARCHAR) AS division, CAST(ts AS DATE) AS date,
                    AVG(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT division, date, {scaled_sql("value", factor=TIE_FREE)} FROM daily"""
)
def readings_to_daily(spark, sf_dir):
    """Unrounded daily means of the event readings."""
    day = local_day(F.col("ts").cast("string"))
    readings = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias(DIVISION), day.alias(DATE), "value"
    )
    daily = documents.hourly_to_daily(readings, ["value"], digits=None)
    return daily.select(DIVISION, DATE, scaled("value", factor=TIE_FREE))


# A mean a hair from the middle of two roundings may go either way in floating point.
_CLEAR = "abs(value * 1e4 - floor(value * 1e4) - 0.5) > 1e-6"


@query(
    f"""WITH daily AS (SELECT CAST(user_id AS VARCHAR) AS division, CAST(ts AS DATE) AS date,
                    AVG(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT division, date, CASE WHEN {_CLEAR} THEN CAST(round(value * 1e4) AS BIGINT) END AS value
    FROM daily"""
)
def rounded_daily_means(spark, sf_dir):
    """Daily means of the event readings to the default four digits."""
    day = local_day(F.col("ts").cast("string"))
    readings = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias(DIVISION), day.alias(DATE), "value"
    )
    exact = documents.hourly_to_daily(readings, ["value"], digits=None)
    rounded = documents.hourly_to_daily(readings, ["value"]).withColumnRenamed("value", "rounded")
    return exact.join(rounded, [DIVISION, DATE]).select(
        DIVISION, DATE, F.when(F.expr(_CLEAR), scaled("rounded", 4)).alias("value")
    )


@query(
    f"""WITH {_ELEMENTS_SQL}
    SELECT division, CAST(DATE '2024-01-01' + CAST(i - 1 AS INTEGER) AS DATE) AS date,
           {scaled_sql("CAST(embedding[i] AS DOUBLE)", "rain_sum")}
    FROM elements WHERE i <= size - label"""
)
def daily_document_files(spark, sf_dir):
    """The daily documents written as JSON lines and read back from the files."""
    path = shared_path(spark, "documents")
    text = _vector_documents(spark, sf_dir, "daily", {RAIN: _shortened(F.col("_x"))})
    text.write.text(path)
    rows = documents.explode_daily(documents.read_documents(spark, path, "daily", [RAIN]), [RAIN])
    return rows.select(DIVISION, DATE, scaled(RAIN))


@query("SELECT CAST(vec_id AS VARCHAR) AS division FROM embeddings WHERE label = 0")
def failed_documents(spark, sf_dir):
    text = _vector_documents(spark, sf_dir, "daily", {RAIN: F.col("_x")})
    return documents.failed_documents(
        documents.parse_documents(text, "text", "daily", [RAIN]), "daily"
    )


def _segment_manifest(spark, sf_dir):
    """Manifest documents task → [divisions] of all customers, by segment."""
    return landing.parse_manifest(_manifest_texts(spark, sf_dir), "text")


def _manifest_texts(spark, sf_dir):
    """One document per customer; its nation is a task of its own without divisions."""
    customer = table(spark, sf_dir, "customer")
    ids = F.array(F.col("c_custkey").cast("string"), F.col("c_name"))
    idle = F.concat(F.lit("idle "), F.col("c_nationkey").cast("string"))
    tasks = F.create_map("c_mktsegment", ids, idle, F.array().cast("array<string>"))
    return customer.select(F.to_json(tasks).alias("text"))


_MANIFEST_SQL = """
manifest AS (
  SELECT c_mktsegment AS task, UNNEST([CAST(c_custkey AS VARCHAR), c_name]) AS division
  FROM customer)"""


@query(f"WITH {_MANIFEST_SQL} SELECT task, division FROM manifest")
def manifest_rows(spark, sf_dir):
    return _segment_manifest(spark, sf_dir)


@query(
    f"""WITH {_MANIFEST_SQL}
    SELECT task, COUNT(*) AS completed FROM manifest GROUP BY task UNION ALL
    SELECT DISTINCT 'idle ' || c_nationkey, 0 FROM customer"""
)
def manifest_counts(spark, sf_dir):
    """Finished divisions per task, tasks without any included."""
    tasks = landing.manifest_tasks(_manifest_texts(spark, sf_dir), "text")
    return landing.manifest_counts(_segment_manifest(spark, sf_dir), tasks)


@query(
    f"WITH {_MANIFEST_SQL} SELECT task, COUNT(DISTINCT division) AS divisions"
    " FROM manifest GROUP BY task"
)
def manifest_files(spark, sf_dir):
    """Manifest documents written as files and read back, one JSON object per file."""
    path = shared_path(spark, "manifest-files")
    whole = _segment_manifest(spark, sf_dir).groupBy("task").agg(F.collect_set(DIVISION).alias("ids"))
    text = whole.select("task", F.to_json(F.create_map("task", "ids")).alias("value"))
    text.write.partitionBy("task").text(path)
    rows = landing.read_manifest(spark, path)
    return rows.groupBy("task").agg(F.countDistinct(DIVISION).alias("divisions"))


@query(f"WITH {_MANIFEST_SQL} SELECT task, division FROM manifest WHERE task <> 'BUILDING'")
def manifest_reset(spark, sf_dir):
    return landing.manifest_reset(_segment_manifest(spark, sf_dir), "BUILDING")


@query(
    f"""WITH {_MANIFEST_SQL}
    SELECT task, division FROM manifest UNION
    SELECT 'BUILDING', CAST(o_custkey AS VARCHAR) FROM orders"""
)
def manifest_marked(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias(DIVISION))
    return landing.mark_done(_segment_manifest(spark, sf_dir), seen, "BUILDING")


@query(
    f"""WITH {_MANIFEST_SQL}
    SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS district FROM customer
    WHERE CAST(c_custkey AS VARCHAR) NOT IN
          (SELECT division FROM manifest WHERE task = 'BUILDING')"""
)
def pending_divisions(spark, sf_dir):
    registry = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("district")
    )
    return landing.pending(registry, _segment_manifest(spark, sf_dir), "BUILDING")


_LANDED_SQL = f"""WITH {NATION_RAIN_SQL}
    SELECT division, 'rain' AS task, COUNT(*) AS days,
           CAST(round_even(SUM(rain_sum) * 1e3, 0) AS BIGINT) AS rain_sum
    FROM rain GROUP BY division"""


def _landed(spark, batches):
    """Land each (batch, rows) in turn; days and rain per division, with its mark."""
    path, manifest = shared_path(spark, "landed"), shared_path(spark, "manifest")
    for batch, rows in batches:
        landing.land(rows, path, manifest, "rain", batch)
    stored = landing.read_landed(spark, path, measurement_schema([RAIN]))
    return (
        stored.groupBy(DIVISION)
        .agg(F.count(F.lit(1)).alias("days"), scaled(F.sum(RAIN), 3, RAIN))
        .join(landing.stored_manifest(spark, manifest), DIVISION)
        .select(DIVISION, "task", "days", RAIN)
    )


@query(_LANDED_SQL)
def landed_twice(spark, sf_dir):
    """Landing the same batch again replaces it and marks nothing twice."""
    return _landed(spark, [("all", nation_rain(spark, sf_dir))] * 2)


@query(_LANDED_SQL)
def landed_increments(spark, sf_dir):
    """A first batch and newer days, both landed twice: nothing is lost, nothing doubled."""
    rain = nation_rain(spark, sf_dir)
    first, newer = rain.filter(F.col(DATE) < "1997-01-01"), rain.filter(F.col(DATE) >= "1997-01-01")
    return _landed(spark, [("first", first), ("newer", newer)] * 2)


@query(
    f"""WITH {NATION_RAIN_SQL},
    merged AS (
      SELECT date, division, rain_sum FROM rain WHERE date >= DATE '1995-04-01' UNION ALL
      SELECT h.date, h.division, h.rain_sum / 2 FROM rain h WHERE h.date < DATE '1995-07-01'
        AND NOT h.date >= DATE '1995-04-01')
    SELECT date, division, {scaled_sql('rain_sum', digits=7)} FROM merged"""
)
def rain_with_backfill(spark, sf_dir):
    rain = nation_rain(spark, sf_dir)
    history = rain.filter(F.col(DATE) < "1995-07-01").withColumn(RAIN, F.col(RAIN) / 2)
    merged = with_backfill(rain.filter(F.col(DATE) >= "1995-04-01"), history)
    return merged.select(DATE, DIVISION, scaled(RAIN, 7))


@query(f"WITH {STATION_REGISTRY_SQL} SELECT id, district, province FROM registry")
def registry_dimension(spark, sf_dir):
    return station_registry(spark, sf_dir)


@query(
    f"""WITH {STATION_REGISTRY_SQL}
    SELECT id, district, province, CAST(id AS DOUBLE) / 4 AS lat, -CAST(id AS DOUBLE) / 8 AS lon
    FROM registry"""
)
def registry_files(spark, sf_dir):
    """The registry written as a JSON array and read back."""
    path = shared_path(spark, "registry")
    number = F.col("id").cast("double")
    places = station_registry(spark, sf_dir).withColumns({"lat": number / 4, "lon": -number / 8})
    # One array per file, several files: no task gathers the registry.
    part = F.pmod(F.xxhash64("id"), F.lit(8)).alias("part")
    arrays = places.groupBy(part).agg(F.collect_list(F.struct(*places.columns)).alias("all"))
    arrays.select("part", F.to_json("all").alias("value")).write.partitionBy("part").text(path)
    return read_registry(spark, path).select("id", "district", "province", "lat", "lon")


@query(
    f"""WITH {STATION_REGISTRY_SQL}
    SELECT 'district' AS level, id FROM registry WHERE lower(district) = 'nation_3' UNION ALL
    SELECT 'province', id FROM registry WHERE lower(province) = 'asia'"""
)
def registry_lookup(spark, sf_dir):
    registry = station_registry(spark, sf_dir)
    found = by_district(registry, "Nation_3").select(F.lit("district").alias("level"), "id")
    return found.unionByName(
        by_province(registry, "Asia").select(F.lit("province").alias("level"), "id")
    )


@query("SELECT true AS has_files, true AS has_bytes, true AS text_fits")
def dataset_size(spark, sf_dir):
    """File sizes are not visible to SQL over the views: what must hold of them is."""
    size = tables.dataset_size(spark, f"{sf_dir}/lineitem.parquet")
    number = F.split("size", " ")[0].cast("double")
    unit = F.when(F.endswith(F.col("size"), F.lit(" MB")), 1024.0**2).when(
        F.endswith(F.col("size"), F.lit(" GB")), 1024.0**3
    )
    return size.select(
        (F.col("files") > 0).alias("has_files"),
        (F.col("bytes") > 0).alias("has_bytes"),
        (F.abs(number - F.col("bytes") / unit) <= 0.00501).alias("text_fits"),
    )


_PROFILE_SQL = "UNION ALL".join(
    f"""
    SELECT '{m}' AS measure, COUNT(*) AS rows, COUNT(DISTINCT division) AS divisions,
           MIN(date) AS date_min, MAX(date) AS date_max,
           CAST(round_even(MIN({m}) * 1e4, 0) AS BIGINT) AS min,
           CAST(round_even(MAX({m}) * 1e4, 0) AS BIGINT) AS max,
           CAST(round_even(AVG({m}) * 1e4, 0) AS BIGINT) AS mean,
           COUNT(*) - COUNT({m}) AS null_count,
           CAST(round_even(100.0 * (COUNT(*) - COUNT({m})) / COUNT(*) * 100, 0) AS BIGINT)
             AS null_pct
    FROM panel """
    for m in MEASURES
)


@query(f"WITH {NATION_SQL} {_PROFILE_SQL}")
def panel_profile(spark, sf_dir):
    return quality.profile(nation_panel(spark, sf_dir), MEASURES).select(
        "measure", "rows", "divisions", "date_min", "date_max",
        *[scaled(c, 4) for c in ("min", "max", "mean")],
        "null_count", scaled("null_pct", 2),
    )


@query(
    f"""WITH {STATION_SQL},
    found AS (SELECT COUNT(DISTINCT division) AS found FROM panel),
    expected AS (SELECT COUNT(*) AS expected FROM nation),
    share AS (SELECT found, expected, 100.0 * found / expected AS pct FROM found, expected)
    SELECT found, expected, CAST(round_even(pct * 10, 0) AS BIGINT) AS coverage_pct,
           repeat('█', CAST(floor(pct / 5) AS BIGINT)) ||
           repeat('░', greatest(0, 20 - CAST(floor(pct / 5) AS BIGINT))) AS coverage_bar
    FROM share"""
)
def panel_coverage(spark, sf_dir):
    """Stations found against the nations registered: more than all of them."""
    cover = quality.coverage(station_panel(spark, sf_dir), nation_registry(spark, sf_dir))
    return cover.withColumn("coverage_pct", scaled("coverage_pct", 1))


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def missing_divisions(spark, sf_dir):
    """Customers as the registry: those without any order are missing."""
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias(DIVISION))
    return quality.missing_divisions(registry, seen)


# Characters trimmed around a name: every white-space character.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_NAMES_SQL = rf"""
names AS (
  SELECT DISTINCT name FROM (
    SELECT regexp_replace(token, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS name
    FROM (SELECT UNNEST(regexp_split_to_array(text, ',+|\n')) AS token FROM documents))
  WHERE name <> '' AND NOT starts_with(name, 'Image') AND NOT contains(name, 'Total'))"""


@query(f"WITH {_NAMES_SQL} SELECT name FROM names")
def names_in_text(spark, sf_dir):
    return name_tokens(table(spark, sf_dir, "documents"), "text")


@query(
    f"""WITH {_NAMES_SQL}, known AS (
      SELECT DISTINCT lang AS name FROM documents UNION SELECT source FROM documents)
    SELECT name FROM names EXCEPT SELECT name FROM known"""
)
def unregistered_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = docs.select(F.explode(F.array("lang", "source")).alias("id"))
    return quality.reconcile_names(name_tokens(docs, "text"), known)


@query(
    """WITH requested AS (SELECT DISTINCT c_name AS name FROM customer UNION
                          SELECT DISTINCT s_name FROM supplier)
    SELECT COUNT(*) AS requested,
           COUNT(*) FILTER (name NOT IN (SELECT s_name FROM supplier)) AS missing
    FROM requested"""
)
def name_reconciliation(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    registry = suppliers.withColumnRenamed("name", "id")
    return quality.reconcile_counts(customers.unionByName(suppliers), registry)


@query(
    f"""WITH {STATION_REGISTRY_SQL}
    SELECT CASE WHEN GROUPING(province) = 1 THEN 'TOTAL' ELSE province END AS province,
           CASE WHEN GROUPING(district) = 1 THEN 'TOTAL' ELSE district END AS district,
           COUNT(*) AS members
    FROM registry GROUP BY ROLLUP (province, district)"""
)
def registry_rollup(spark, sf_dir):
    return quality.registry_rollup(station_registry(spark, sf_dir))


@query(
    f"""WITH {STATION_REGISTRY_SQL}
    SELECT 'district' AS level, district AS place, id,
           COUNT(*) OVER (PARTITION BY district) AS members FROM registry UNION ALL
    SELECT 'province', province, id, COUNT(*) OVER (PARTITION BY province) FROM registry"""
)
def registry_members(spark, sf_dir):
    """Members of every district and of every province."""
    registry = station_registry(spark, sf_dir)
    levels = [
        quality.registry_members(registry, level).select(
            F.lit(level).alias("level"), F.col(level).alias("place"), "id", "members"
        )
        for level in ("district", "province")
    ]
    return levels[0].unionByName(levels[1])


@query(
    f"""WITH {STATION_SQL}, {STATION_REGISTRY_SQL.strip()}
    SELECT date, division, district, province, {scaled_sql('rain_sum')}
    FROM panel JOIN registry ON division = id"""
)
def panel_with_places(spark, sf_dir):
    placed = with_registry(station_panel(spark, sf_dir), station_registry(spark, sf_dir))
    return placed.select(DATE, DIVISION, "district", "province", scaled(RAIN))


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS division,
           date_diff('day', CAST(MIN(o_orderdate) AS DATE), CAST(MAX(o_orderdate) AS DATE))
             AS expected_days,
           date_diff('day', CAST(MIN(o_orderdate) AS DATE), CAST(MAX(o_orderdate) AS DATE)) + 1
             AS expected_days_inclusive
    FROM orders GROUP BY 1"""
)
def expected_days(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias(DIVISION)).agg(
        F.min(F.to_date("o_orderdate")).alias("start"), F.max(F.to_date("o_orderdate")).alias("end")
    )
    start, end = F.col("start"), F.col("end")
    return spans.select(
        DIVISION,
        quality.expected_days(start, end).cast("bigint").alias("expected_days"),
        quality.expected_days_inclusive(start, end).cast("bigint").alias("expected_days_inclusive"),
    )


@query(
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
           TRY_CAST(event_type AS DOUBLE) AS kind,
           CAST(round_even(CAST(value AS DOUBLE) * 10, 0) AS BIGINT) AS value
    FROM events"""
)
def lenient_numbers(spark, sf_dir):
    """Text read as numbers where it is one."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        safe_double(F.get_json_object("props", "$.k")).alias("k"),
        safe_double("event_type").alias("kind"),
        scaled(round_decimal(F.col("value"), 1), 1, "value"),
    )
