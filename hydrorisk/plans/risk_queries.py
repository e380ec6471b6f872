"""Queries over the precipitation index, severity labels and forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrorisk.functions import severity
from hydrorisk.functions.scalars import (
    month_start,
    round_half_even,
    severity_name,
    severity_ordinal,
)
from hydrorisk.operators import forecast, metrics, quality, spi
from hydrorisk.operators.panel import (
    balanced_weights,
    fit_division_encoder,
    with_class_weight,
)
from hydrorisk.operators.splits import split_fraction, split_temporal
from hydrorisk.operators.windows import antecedent_rain, over_rows, rolling_sums
from hydrorisk.plans import spi_sql as sql
from hydrorisk.plans.features import feature_matrix
from hydrorisk.plans.hazards import labelled_sets
from hydrorisk.plans.panel_queries import _ANTECEDENT_SQL, _LONG_SQL
from hydrorisk.plans.register import TIE_FREE, query, scaled, scaled_list, scaled_sql
from hydrorisk.plans.stand_ins import (
    NATION_SQL,
    STATION_SQL,
    nation_rain,
    nation_soil,
    nation_temperature,
    station_panel,
    table,
)
from hydrorisk.schemas import (
    DATE,
    DIVISION,
    FEATURES,
    KEY,
    MEASURES,
    PREDICTIONS,
    RAIN,
    SEVERITIES,
    TARGETS,
)
from hydrorisk.session import settle, shared_path


def _stations(spark, sf_dir):
    return settle(station_panel(spark, sf_dir), "stations")


_PARAMS_SQL = (
    f"division, n, {scaled_sql('q')}, {scaled_sql('alpha')}, {scaled_sql('beta')}"
)


_STATISTICS = ["q", "mean", "mean_log"]


@query(
    f"""WITH {STATION_SQL},
    stats AS (SELECT division, COUNT(rain_sum) AS n,
                     AVG(CASE WHEN rain_sum = 0 THEN 1.0 ELSE 0.0 END) AS q,
                     AVG(CASE WHEN rain_sum > 0 THEN rain_sum END) AS mean,
                     AVG(CASE WHEN rain_sum > 0 THEN ln(rain_sum) END) AS mean_log
              FROM panel GROUP BY division)
    SELECT division, n, {scaled_list(_STATISTICS, factor=TIE_FREE)} FROM stats"""
)
def gamma_statistics(spark, sf_dir):
    stats = spi.gamma_stats(station_panel(spark, sf_dir), [RAIN])
    return stats.select(
        DIVISION,
        F.col(f"{RAIN}_n").alias("n"),
        *[scaled(f"{RAIN}_{c}", name=c, factor=TIE_FREE) for c in _STATISTICS],
    )


@query(
    f"""WITH RECURSIVE {STATION_SQL}, {sql.fit_sql("panel", "rain_sum", "fit")}
    SELECT {_PARAMS_SQL} FROM fit"""
)
def fitted_parameters(spark, sf_dir):
    params = spi.fit_spi(station_panel(spark, sf_dir), [RAIN])
    return params.select(
        DIVISION,
        F.col(f"{RAIN}_n").alias("n"),
        *[scaled(f"{RAIN}_{c}", 6, c) for c in ("q", "alpha", "beta")],
    )


@query(
    f"""WITH RECURSIVE {STATION_SQL}, {sql.daily_sql()}
    SELECT date, division, {scaled_sql('spi', digits=3)} FROM daily"""
)
def daily_index(spark, sf_dir):
    return spi.spi_daily(_stations(spark, sf_dir)).select(*KEY, scaled("spi", 3))


_WINDOWED_SQL = f"""
summed AS (SELECT *, {_LONG_SQL} FROM panel WINDOW w AS (PARTITION BY division ORDER BY date)),
{sql.spi_sql("summed", "rain_rolling_30d", "with30", "spi_30d")},
{sql.spi_sql("with30", "rain_rolling_90d", "with90", "spi_90d")},
{sql.spi_sql("with90", "rain_rolling_180d", "indexed", "spi_180d")}"""

_INDICES = ["spi_30d", "spi_90d", "spi_180d"]


@query(
    f"""WITH RECURSIVE {STATION_SQL}, {_WINDOWED_SQL}
    SELECT date, division, {scaled_list(_INDICES, 3)} FROM indexed"""
)
def window_indices(spark, sf_dir):
    rows = spi.spi_window(_stations(spark, sf_dir))
    return rows.select(*KEY, *[scaled(c, 3) for c in _INDICES])


@query(
    f"""WITH RECURSIVE {STATION_SQL},
    early AS (SELECT division, rain_sum FROM panel WHERE date < DATE '1999-01-01'),
    late AS (SELECT * FROM panel WHERE date >= DATE '1999-01-01'),
    {sql.fit_sql("early", "rain_sum", "fit")},
    {sql.score_sql("late", "rain_sum", "fit", "scored", "spi")}
    SELECT date, division, {scaled_sql('spi', digits=3)} FROM scored"""
)
def index_against_baseline(spark, sf_dir):
    panel = _stations(spark, sf_dir)
    early, late = panel.filter(F.col(DATE) < "1999-01-01"), panel.filter(F.col(DATE) >= "1999-01-01")
    scored = spi.spi_against_baseline(late, spi.store_fit(early, [RAIN]))
    return scored.select(*KEY, scaled("spi", 3))


_MATRIX = [
    *MEASURES, "rain_lag_1", "rain_rolling_3d", "rain_rolling_7d", "month_sin", "month_cos",
    *_INDICES,
]


@query(
    f"""WITH RECURSIVE {NATION_SQL}, {_ANTECEDENT_SQL.replace("antecedent AS", "lagged AS")},
    seasonal AS (SELECT *, sin(2 * pi() * month(date) / 12) AS month_sin,
                 cos(2 * pi() * month(date) / 12) AS month_cos FROM lagged),
    {_WINDOWED_SQL.replace("FROM panel", "FROM seasonal")}
    SELECT date, division, {scaled_list(_MATRIX, 3)} FROM indexed
    WHERE date >= DATE '1996-01-01'"""
)
def master_feature_matrix(spark, sf_dir):
    matrix = feature_matrix(
        nation_rain(spark, sf_dir),
        nation_temperature(spark, sf_dir),
        nation_soil(spark, sf_dir),
        first_day="1996-01-01",
    )
    return matrix.select(*KEY, *[scaled(c, 3) for c in _MATRIX])


_LABELS = f"""{sql.flood_case("spi")} AS flood_severity,
    {sql.drought_case("spi")} AS drought_severity,
    {sql.landslide_case("rain_sum", "spi")} AS landslide_severity"""

_SHORT_INDEX_SQL = f"""
summed AS (SELECT *, {_LONG_SQL} FROM panel WINDOW w AS (PARTITION BY division ORDER BY date)),
{sql.spi_sql("summed", "rain_rolling_30d", "raw", "spi_raw")},
indexed AS (SELECT *, round_even(spi_raw * 1000, 0) / 1000 AS spi FROM raw)"""


def _short_index(spark, sf_dir):
    """Stations with the 30-row index, 3 digits, as ``spi``: it reaches every class."""
    rows = spi.spi_window(station_panel(spark, sf_dir, together=True), [30])
    return rows.withColumn("spi", round_half_even(F.col("spi_30d"), 3)).drop("spi_30d")


@query(
    f"""WITH RECURSIVE {STATION_SQL}, {_SHORT_INDEX_SQL}
    SELECT date, division, {_LABELS} FROM indexed"""
)
def severity_labels(spark, sf_dir):
    labelled = severity.label_all(_short_index(spark, sf_dir))
    return labelled.select(*KEY, "flood_severity", "drought_severity", "landslide_severity")


@query(
    f"""WITH RECURSIVE {STATION_SQL}, {sql.daily_sql()},
    labelled AS (SELECT *, {_LABELS} FROM daily)
    SELECT 'flood' AS hazard, flood_severity AS severity, COUNT(*) AS rows FROM labelled
    GROUP BY 2 UNION ALL
    SELECT 'drought', drought_severity, COUNT(*) FROM labelled GROUP BY 2 UNION ALL
    SELECT 'landslide', landslide_severity, COUNT(*) FROM labelled GROUP BY 2"""
)
def hazard_class_distribution(spark, sf_dir):
    indexed = settle(spi.spi_daily(_stations(spark, sf_dir)))
    counts = [
        quality.class_distribution(df, f"{hazard}_severity").select(
            F.lit(hazard).alias("hazard"), F.col(f"{hazard}_severity").alias("severity"), "rows"
        )
        for hazard, df in severity.hazard_datasets(indexed).items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    f"""WITH RECURSIVE {STATION_SQL}, {_ANTECEDENT_SQL},
    {_WINDOWED_SQL.replace("FROM panel", "FROM antecedent")}
    SELECT date, division,
      CASE WHEN rain_rolling_7d > 300 OR (rain_rolling_7d > 200 AND soil_moisture_7_to_28cm > 0.45)
             THEN 'Extreme'
           WHEN rain_rolling_7d > 150 OR (rain_rolling_7d > 100 AND soil_moisture_7_to_28cm > 0.40)
             THEN 'Severe'
           WHEN rain_rolling_7d > 70 OR rain_sum > 50 THEN 'Moderate' ELSE 'Normal' END
        AS flood_label_v0,
      CASE WHEN round_even(spi_30d * 1e3, 0) < -2000 AND round_even(spi_90d * 1e3, 0) < -1500
             THEN 'Extreme'
           WHEN round_even(spi_30d * 1e3, 0) < -1500 OR round_even(spi_90d * 1e3, 0) < -1500
             THEN 'Severe'
           WHEN round_even(spi_30d * 1e3, 0) < -1000 OR round_even(spi_90d * 1e3, 0) < -1000
             THEN 'Moderate' ELSE 'Normal' END AS drought_label_v0,
      CASE WHEN rain_sum > 100 AND soil_moisture_28_to_100cm > 0.45 THEN 'Extreme'
           WHEN (rain_sum > 60 AND soil_moisture_28_to_100cm > 0.38) OR rain_rolling_3d > 150
             THEN 'Severe'
           WHEN rain_sum > 30 OR rain_rolling_3d > 80 THEN 'Moderate' ELSE 'Normal' END
        AS landslide_label_v0
    FROM indexed"""
)
def planned_rule_labels(spark, sf_dir):
    """All windows in one pass, then the two indices and the three rules."""
    sums = {n: f"_sum_{n}" for n in (30, 90)}
    stages, helpers = rolling_sums(RAIN, sums)
    rows = over_rows(_stations(spark, sf_dir), antecedent_rain, *stages, back=89).drop(*helpers)
    rows = settle(rows, "windowed")
    fit = spi.store_fit(rows, list(sums.values()))
    rows = spi.transform_spi(rows, fit, {c: f"spi_{n}d" for n, c in sums.items()})
    rows = rows.withColumns({c: round_half_even(F.col(c), 3) for c in ("spi_30d", "spi_90d")})
    for rule in (severity.flood_rule_v0, severity.drought_rule_v0, severity.landslide_rule_v0):
        rows = rule(rows)
    return rows.select(*KEY, "flood_label_v0", "drought_label_v0", "landslide_label_v0")


_MONTHLY_FLOOD_SQL = f"""WITH RECURSIVE {STATION_SQL}, {_SHORT_INDEX_SQL},
    labelled AS (SELECT division, CAST(date_trunc('month', date) AS DATE) AS year_month,
                 {sql.flood_case("spi")} AS severity FROM indexed)
    SELECT division, year_month, severity, COUNT(*) AS days FROM labelled GROUP BY 1, 2, 3"""


@query(_MONTHLY_FLOOD_SQL)
def monthly_flood_severity(spark, sf_dir):
    """Days of each flood class of the 30-row index, by division and month."""
    labelled = _short_index(spark, sf_dir).select(
        DIVISION,
        month_start(DATE).alias("year_month"),
        severity.flood_severity(F.col("spi")).alias("severity"),
    )
    return labelled.groupBy(DIVISION, "year_month", "severity").agg(
        F.count(F.lit(1)).alias("days")
    )


@query(
    f"""SELECT event_id, event_type AS severity,
           CASE WHEN value < 50 THEN 0 WHEN value < 100 THEN 1 END AS ordinal,
           CASE WHEN value < 50 THEN 'Normal' WHEN value < 100 THEN 'Moderate' END AS name
    FROM events"""
)
def severity_codes(spark, sf_dir):
    """Names to ordinals and back; an unknown name is missing."""
    word = F.when(F.col("value") < 50, "Normal").when(F.col("value") < 100, "Moderate")
    coded = table(spark, sf_dir, "events").withColumn(
        "ordinal", severity_ordinal(F.coalesce(word, F.lit("Unheard of")))
    )
    return coded.select(
        "event_id",
        F.col("event_type").alias("severity"),
        "ordinal",
        severity_name(F.col("ordinal")).alias("name"),
    )


_PREPARED_SQL = f"""{STATION_SQL}, {_SHORT_INDEX_SQL},
labelled AS (SELECT *, {sql.flood_case("spi")} AS flood_severity FROM indexed),
{_ANTECEDENT_SQL.replace("FROM panel", "FROM labelled")},
kept AS (SELECT *, sin(2 * pi() * month(date) / 12) AS month_sin,
         cos(2 * pi() * month(date) / 12) AS month_cos,
         {sql.ordinal_case("flood_severity")} AS level
         FROM antecedent WHERE rain_lag_1 IS NOT NULL),
encoder AS (SELECT division, CAST(row_number() OVER (ORDER BY division) - 1 AS INTEGER)
            AS division_encoded FROM (SELECT DISTINCT division FROM kept)),
ahead AS (SELECT kept.*, division_encoded,
          LEAD(level, 1) OVER w AS target_day1, LEAD(level, 2) OVER w AS target_day2,
          LEAD(level, 3) OVER w AS target_day3
          FROM kept JOIN encoder USING (division)
          WINDOW w AS (PARTITION BY division ORDER BY date)),
prepared AS (SELECT * FROM ahead WHERE target_day1 IS NOT NULL AND target_day2 IS NOT NULL
             AND target_day3 IS NOT NULL)"""


def _prepared(spark, sf_dir):
    labelled = _short_index(spark, sf_dir).withColumn(
        "flood_severity", severity.flood_severity(F.col("spi"))
    )
    return forecast.prepare_horizon(labelled, "flood_severity")[0]


@query(
    f"""WITH RECURSIVE {_PREPARED_SQL}
    SELECT date, division, {scaled_list(FEATURES[:-1], 3)}, division_encoded,
           target_day1, target_day2, target_day3 FROM prepared"""
)
def prepared_horizons(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    return rows.select(
        *KEY, *[scaled(c, 3) for c in FEATURES[:-1]], "division_encoded", *TARGETS
    )


@query(
    f"""WITH {STATION_SQL}
    SELECT date, division, CASE WHEN rain_sum > 0 THEN 1 ELSE 0 END AS wet,
           LEAD(CASE WHEN rain_sum > 0 THEN 1 ELSE 0 END, 1) OVER w AS target_day1,
           LEAD(CASE WHEN rain_sum > 0 THEN 1 ELSE 0 END, 2) OVER w AS target_day2,
           LEAD(CASE WHEN rain_sum > 0 THEN 1 ELSE 0 END, 3) OVER w AS target_day3
    FROM panel WINDOW w AS (PARTITION BY division ORDER BY date)"""
)
def horizon_targets(spark, sf_dir):
    wet = _stations(spark, sf_dir).select(*KEY, (F.col(RAIN) > 0).cast("int").alias("wet"))
    return forecast.horizon_targets(wet, "wet").select(*KEY, "wet", *TARGETS)


@query(
    f"""WITH RECURSIVE {_PREPARED_SQL},
    counts AS (SELECT target_day1, COUNT(*) AS class_rows FROM prepared GROUP BY 1)
    SELECT target_day1, class_rows,
           {scaled_sql("SUM(class_rows) OVER () / (COUNT(*) OVER () * class_rows)", "class_weight")}
    FROM counts"""
)
def class_weights(spark, sf_dir):
    weights = balanced_weights(_prepared(spark, sf_dir), TARGETS[0])
    return weights.select(TARGETS[0], "class_rows", scaled("class_weight"))


@query(
    f"""WITH RECURSIVE {_PREPARED_SQL},
    counts AS (SELECT target_day1, COUNT(*) AS class_rows FROM prepared GROUP BY 1),
    weights AS (SELECT target_day1,
                SUM(class_rows) OVER () / (COUNT(*) OVER () * class_rows) AS class_weight
                FROM counts)
    SELECT date, division, target_day1, {scaled_sql("class_weight")}
    FROM prepared JOIN weights USING (target_day1)"""
)
def weighted_rows(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    weighted = with_class_weight(rows, balanced_weights(rows, TARGETS[0]), TARGETS[0])
    return weighted.select(*KEY, TARGETS[0], scaled("class_weight"))


# Persistence forecast: each horizon is predicted to keep today's class, with the
# landslide class standing in as the truth so that classes differ.
_PERSISTENCE_SQL = f"""{STATION_SQL}, {_SHORT_INDEX_SQL},
labelled AS (SELECT date, division,
             {sql.ordinal_case("(" + sql.landslide_case("rain_sum", "spi") + ")")} AS truth,
             {sql.ordinal_case("(" + sql.flood_case("spi") + ")")} AS guess FROM indexed),
ahead AS (SELECT *, LEAD(truth, 1) OVER w AS t1, LEAD(truth, 2) OVER w AS t2,
          LEAD(truth, 3) OVER w AS t3
          FROM labelled WINDOW w AS (PARTITION BY division ORDER BY date)),
wide AS (SELECT * FROM ahead WHERE t1 IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL),
pairs AS (SELECT 1 AS horizon, t1 AS y_true, guess AS y_pred FROM wide UNION ALL
          SELECT 2, t2, guess FROM wide UNION ALL SELECT 3, t3, guess FROM wide),
counts AS (SELECT horizon, y_true, y_pred, COUNT(*) AS n FROM pairs GROUP BY 1, 2, 3)"""


def _persistence(spark, sf_dir):
    labelled = severity.label_all(_short_index(spark, sf_dir)).select(
        *KEY,
        severity_ordinal(F.col("landslide_severity")).alias("truth"),
        severity_ordinal(F.col("flood_severity")).alias("guess"),
    )
    ahead = forecast.horizon_targets(labelled, "truth").na.drop(subset=TARGETS)
    return ahead.withColumns({p: F.col("guess") for p in PREDICTIONS})


@query(f"WITH RECURSIVE {_PERSISTENCE_SQL} SELECT horizon, y_true, y_pred, n AS rows FROM counts")
def forecast_confusion(spark, sf_dir):
    return metrics.confusion(metrics.horizon_pairs(_persistence(spark, sf_dir)), by=["horizon"])


@query(
    f"""WITH RECURSIVE {_PERSISTENCE_SQL},
    overall AS (SELECT AVG(CASE WHEN t1 = guess AND t2 = guess AND t3 = guess
                           THEN 1.0 ELSE 0.0 END) AS exact_match FROM wide),
    acc AS (SELECT horizon, SUM(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / SUM(n) AS accuracy,
            SUM(n) AS total FROM counts GROUP BY 1),
    classes AS (SELECT horizon, y_true AS c FROM counts UNION SELECT horizon, y_pred FROM counts),
    placed AS (SELECT horizon, c, row_number() OVER (PARTITION BY horizon ORDER BY c) AS place
               FROM classes),
    per_class AS (
      SELECT p.horizon, p.c, p.place,
             SUM(CASE WHEN y_true = c AND y_pred = c THEN n ELSE 0 END) AS hit,
             SUM(CASE WHEN y_true = c THEN n ELSE 0 END) AS t,
             SUM(CASE WHEN y_pred = c THEN n ELSE 0 END) AS g
      FROM placed p JOIN counts USING (horizon) GROUP BY 1, 2, 3),
    f1 AS (SELECT horizon, AVG(CASE WHEN t + g = 0 THEN 0 ELSE 2.0 * hit / (t + g) END) AS f1_macro,
           SUM(t * CASE WHEN t + g = 0 THEN 0 ELSE 2.0 * hit / (t + g) END) / SUM(t) AS f1_weighted
           FROM per_class GROUP BY 1),
    seen AS (SELECT k.horizon, SUM(n * (a.place - b.place) ** 2) AS w
             FROM counts k JOIN placed a ON a.horizon = k.horizon AND a.c = y_true
                           JOIN placed b ON b.horizon = k.horizon AND b.c = y_pred GROUP BY 1),
    chance AS (SELECT a.horizon,
               SUM((a.place - b.place) ** 2 * CAST(a.t AS DOUBLE) * b.g) / MAX(total) AS w
               FROM per_class a JOIN per_class b ON a.horizon = b.horizon
               JOIN acc ON acc.horizon = a.horizon GROUP BY 1)
    SELECT 'landslide' AS hazard, CAST(horizon AS INTEGER) AS horizon, {scaled_sql("accuracy")},
           {scaled_sql("f1_macro")}, {scaled_sql("f1_weighted")},
           {scaled_sql("1 - seen.w / chance.w", "kappa")}, {scaled_sql("exact_match")}
    FROM acc JOIN f1 USING (horizon) JOIN seen USING (horizon) JOIN chance USING (horizon), overall"""
)
def forecast_metrics(spark, sf_dir):
    table_ = metrics.evaluate_predictions(_persistence(spark, sf_dir), "landslide")
    scores = ("accuracy", "f1_macro", "f1_weighted", "kappa", "exact_match")
    return table_.select("hazard", "horizon", *[scaled(s) for s in scores])


# Rows that a model query fits on at most, drawn by a hash of the keys: the bound of the
# sample, whatever the input's size. Every row that is held out is predicted. The folds of
# ``cross_validated_model`` and the settings of ``tuned_model`` are fitted on all their rows.
FIT_ROWS = 5_000

_HAZARDS = ["flood", "landslide", "drought"]


def _trained(spark, sf_dir):
    """A weighted forest of drawn settings, fitted on the days before 2000."""
    train, _, test = split_temporal(_prepared(spark, sf_dir), "2000-01-01", "2000-01-01")
    train = settle(forecast.bounded_sample(train, FIT_ROWS), "fit-rows")
    params = forecast.draw_params(42, 0, "forest")
    model = forecast.fit_hazard(train, settle(balanced_weights(train, TARGETS[0])), params)
    return model, test


def _on_scale(*columns):
    """Whether every column is one of the four ordinals."""
    inside = [F.coalesce(F.col(c).between(0, len(SEVERITIES) - 1), F.lit(False)) for c in columns]
    return reduce(Column.__and__, inside)


def _learned(predicted):
    """One row: do all three horizons beat the majority class on macro F1?"""
    counts = settle(metrics.confusion(metrics.horizon_pairs(predicted), by=["horizon"]), "confusion")
    beaten = metrics.against_majority(counts, ["horizon"])
    return beaten.agg(F.coalesce(F.bool_and(F.col("f1_macro") > F.col("majority_f1_macro")), F.lit(False)).alias("learned"))


@query(
    f"""WITH RECURSIVE {_PREPARED_SQL}
    SELECT date, division, target_day1, target_day2, target_day3, true AS on_scale, true AS named, true AS learned
    FROM prepared WHERE date >= DATE '2000-01-01'"""
)
def predicted_severities(spark, sf_dir):
    """Forecasts for every row after the training period, which must beat the majority class there."""
    model, test = _trained(spark, sf_dir)
    ordinals = settle(forecast.predict(test, model), "predicted").withColumn("on_scale", _on_scale(*PREDICTIONS))
    names = [F.col(p).isin(SEVERITIES) for p in PREDICTIONS]
    named = forecast.predicted_names(ordinals).select(
        *KEY, *TARGETS, "on_scale", reduce(Column.__and__, names).alias("named")
    )
    return named.join(_learned(ordinals), F.lit(True))


_BOOSTED_SQL = _PREPARED_SQL.replace(
    f"{sql.flood_case('spi')} AS flood_severity", f"{sql.landslide_case('rain_sum', 'spi')} AS landslide_severity"
).replace("flood_severity", "landslide_severity")


@query(
    f"""WITH RECURSIVE {_BOOSTED_SQL},
    held AS (SELECT * FROM prepared WHERE date >= DATE '2000-01-01')
    SELECT 1 AS horizon, target_day1 AS y_true, COUNT(*) AS rows, true AS beats_majority, true AS stopped_early
    FROM held GROUP BY 2 UNION ALL
    SELECT 2, target_day2, COUNT(*), true, true FROM held GROUP BY 2 UNION ALL
    SELECT 3, target_day3, COUNT(*), true, true FROM held GROUP BY 2"""
)
def boosted_hazard(spark, sf_dir):
    """Weighted boosting of the landslide classes, a booster per class and horizon, ended by held-back rows."""
    labelled = severity.label_all(_short_index(spark, sf_dir))
    rows = settle(forecast.prepare_horizon(labelled, "landslide_severity")[0], "prepared")
    train, _, test = split_temporal(rows, "2000-01-01", "2000-01-01")
    train = settle(forecast.bounded_sample(train, FIT_ROWS).coalesce(1), "fit-rows")
    params = forecast.TreeParams(kind="boosted", trees=50, depth=4, learning_rate=0.2, row_share=0.9, column_share=0.9)
    model = forecast.fit_hazard(train, settle(balanced_weights(train, TARGETS[0])), params)
    stopped = any(rounds < params.trees for rounds in forecast.boosting_rounds(model).values())
    pairs = metrics.horizon_pairs(forecast.predict(test, model))
    counts = settle(metrics.confusion(pairs, by=["horizon"]), "confusion")
    beats = metrics.against_majority(counts, ["horizon"]).select(
        "horizon", (F.col("f1_macro") > F.col("majority_f1_macro")).alias("beats_majority")
    )
    classes = counts.groupBy("horizon", "y_true").agg(F.sum("rows").alias("rows"))
    return classes.join(beats, "horizon").withColumn("stopped_early", F.lit(stopped))


def _moved(test, model, other):
    """Predictions of ``model`` that ``other`` does not give. Rows on which both agree take each other out."""
    names = {p: f"_first_{p}" for p in PREDICTIONS}
    both = forecast.predict(forecast.predict(test, model).withColumnsRenamed(names), other)
    agree = [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()]
    apart = settle(both.filter(~reduce(Column.__and__, agree)), "apart")
    one = apart.select(*KEY, *[F.col(b).alias(a) for a, b in names.items()])
    return one.exceptAll(apart.select(*KEY, *PREDICTIONS))


@query(
    f"""WITH RECURSIVE {STATION_SQL},
    hazards AS (SELECT * FROM (VALUES ('flood'), ('landslide'), ('drought')) AS h(hazard)),
    horizons AS (SELECT CAST(h AS INTEGER) AS horizon FROM range(1, 4) AS r(h))
    SELECT hazard, horizon, 0 AS moved, true AS in_range FROM hazards, horizons"""
)
def evaluated_model(spark, sf_dir):
    """Models of all hazards, stored with their encoders and loaded: do they score, and predict, alike?"""
    labelled = settle(severity.label_all(_short_index(spark, sf_dir)), "labelled")
    first, later = (labelled.filter(c) for c in (F.col(DATE) < "2000-01-01", F.col(DATE) >= "2000-01-01"))
    labels = [f"{hazard}_severity" for hazard in _HAZARDS]
    known_days = settle(forecast.horizon_rows(first, labels), "features")
    encoder = fit_division_encoder(known_days)
    later_days = settle(forecast.horizon_rows(later, labels), "later")
    results = []
    for hazard, label in zip(_HAZARDS, labels, strict=True):
        train = forecast.encode_horizon(known_days, label, encoder)
        train = settle(forecast.bounded_sample(train, FIT_ROWS), "fit-rows")
        weights = settle(balanced_weights(train, TARGETS[0]))
        model = forecast.fit_hazard(train, weights, forecast.draw_params(42, 1, "forest"))
        path = shared_path(spark, "model")
        forecast.save_model(model, encoder, path)
        loaded, known = forecast.load_model(spark, path)
        test = forecast.encode_horizon(later_days, label, known)
        moved = _moved(test, model, loaded).agg(F.count(F.lit(1)).cast("int").alias("moved"))
        scores = forecast.evaluate_hazard(test, loaded, hazard)
        limits = [F.col(m).between(0, 1) for m in ("accuracy", "f1_macro", "f1_weighted", "exact_match")]
        inside = reduce(Column.__and__, limits) & F.col("kappa").between(-1, 1)
        results.append(
            scores.join(moved, F.lit(True)).select(
                "hazard", "horizon", "moved", F.coalesce(inside, F.lit(True)).alias("in_range")
            )
        )
    return reduce(DataFrame.unionByName, results)


_HOLDOUT_SQL = f"""{_PREPARED_SQL},
ranked AS (SELECT *, row_number() OVER (ORDER BY division, date) AS place, COUNT(*) OVER () AS total FROM prepared),
holdout AS (SELECT * FROM ranked WHERE place > floor(0.8 * total)),
triples AS (SELECT target_day1, target_day2, target_day3, COUNT(*) AS n FROM holdout GROUP BY 1, 2, 3),
majority AS (SELECT max(n) / sum(n) AS share, CAST(sum(n) AS BIGINT) AS rows FROM triples)"""


@query(
    f"""WITH RECURSIVE {_HOLDOUT_SQL}
    SELECT CAST(t AS INTEGER) AS trial, true AS in_ranges, true AS scored, 1 AS best, rows AS holdout_rows,
           {scaled_sql("share", "majority_share")}, true AS best_beats_chance
    FROM range(5) AS r(t), majority"""
)
def tuned_model(spark, sf_dir):
    """Five drawn settings tried on the held-out tail of the training rows; one is the best.

    The best must match more triples of classes than guesses drawn from the three horizons'
    own class shares would on average.
    """
    rows = _prepared(spark, sf_dir)
    parts = split_fraction(rows, 0.8)
    best, scores = forecast.tune_hazard(rows, trials=5, parts=parts)
    top = max(score for _, score in scores)
    holdout = parts[1].groupBy(*TARGETS).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in holdout)
    chance = 1.0
    for target in TARGETS:
        shares = {}
        for r in holdout:
            shares[r[target]] = shares.get(r[target], 0) + r["n"] / total
        chance *= sum(s * s for s in shares.values())
    majority = int(round(max(r["n"] for r in holdout) / total * 1e6))
    tried = [
        (
            trial,
            50 <= p.trees <= 150 and 3 <= p.depth <= 8 and p == forecast.draw_params(42, trial, p.kind),
            0 <= score <= 1,
            sum(p == best and score == top for p, score in scores),
            total,
            majority,
            top > chance,
        )
        for trial, (p, score) in enumerate(scores)
    ]
    return spark.createDataFrame(
        tried,
        "trial int, in_ranges boolean, scored boolean, best int, holdout_rows bigint, majority_share bigint,"
        " best_beats_chance boolean",
    )


@query(
    f"""WITH RECURSIVE {_PREPARED_SQL},
    sizes AS (SELECT target_day1 AS y_true, COUNT(*) AS n FROM prepared GROUP BY 1)
    SELECT CAST(fold AS INTEGER) AS fold, y_true, n // 3 + CASE WHEN fold < n % 3 THEN 1 ELSE 0 END AS rows,
           true AS beats_majority
    FROM sizes, range(3) AS f(fold) WHERE n // 3 + CASE WHEN fold < n % 3 THEN 1 ELSE 0 END > 0"""
)
def cross_validated_model(spark, sf_dir):
    """Day-1 classifiers over three folds: rows scored per fold and class, better than the majority class."""
    params = forecast.draw_params(42, 2, "forest")
    counts = forecast.cross_validation_counts(_prepared(spark, sf_dir), params)
    beats = metrics.against_majority(counts, ["fold"]).select(
        "fold", (F.col("f1_macro") > F.col("majority_f1_macro")).alias("beats_majority")
    )
    return counts.groupBy("fold", "y_true").agg(F.sum("rows").alias("rows")).join(beats, "fold")


_NEWEST_SQL = f"""{STATION_SQL},
early AS (SELECT division, rain_sum FROM panel WHERE date < DATE '1999-01-01'),
{sql.fit_sql("early", "rain_sum", "fit")},
{sql.score_sql("panel", "rain_sum", "fit", "scored", "spi")},
{_ANTECEDENT_SQL.replace("FROM panel", "FROM scored")},
encoder AS (SELECT division, CAST(row_number() OVER (ORDER BY division) - 1 AS INTEGER)
            AS division_encoded FROM (SELECT DISTINCT division FROM early)),
newest AS (
  SELECT *, sin(2 * pi() * month(date) / 12) AS month_sin,
         cos(2 * pi() * month(date) / 12) AS month_cos,
         row_number() OVER (PARTITION BY division ORDER BY date DESC) AS back
  FROM antecedent JOIN encoder USING (division) WHERE rain_lag_1 IS NOT NULL)"""


def _newest(spark, sf_dir):
    """Inputs of the last three days per division, against a stored baseline and encoder."""
    panel = _stations(spark, sf_dir)
    early = panel.filter(F.col(DATE) < "1999-01-01")
    scored = spi.spi_against_baseline(panel, spi.store_fit(early, [RAIN]))
    return forecast.newest_features(scored, fit_division_encoder(early), rows=3)


@query(
    f"""WITH RECURSIVE {_NEWEST_SQL}
    SELECT date, division, {scaled_list(FEATURES[:-1], 3)}, division_encoded FROM newest
    WHERE back <= 3"""
)
def newest_inputs(spark, sf_dir):
    rows = _newest(spark, sf_dir)
    return rows.select(*KEY, *[scaled(c, 3) for c in FEATURES[:-1]], "division_encoded")


@query(
    f"""WITH RECURSIVE {_NEWEST_SQL}
    SELECT date, division, true AS on_scale, true AS learned FROM newest WHERE back <= 3"""
)
def newest_forecasts(spark, sf_dir):
    """The next three days' classes, asked from the newest rows, for which no target is known."""
    model, test = _trained(spark, sf_dir)
    predicted = forecast.predict(_newest(spark, sf_dir), model)
    rows = predicted.select(*KEY, _on_scale(*PREDICTIONS).alias("on_scale"))
    return rows.join(_learned(forecast.predict(test, model)), F.lit(True))


_SPLIT_SQL = f"""{STATION_SQL},
placed AS (SELECT *, row_number() OVER (ORDER BY division, date) AS place,
           COUNT(*) OVER () AS total FROM panel),
train AS (SELECT * EXCLUDE (place, total) FROM placed WHERE place <= total - 8630),
test AS (SELECT * EXCLUDE (place, total) FROM placed WHERE place > total - 8630),
{sql.daily_sql("train", "train_index")},
{sql.daily_sql("test", "test_index")}"""


@query(
    f"""WITH RECURSIVE {_SPLIT_SQL},
    both_parts AS (SELECT 'train' AS part, * FROM train_index
                   UNION ALL SELECT 'test', * FROM test_index)
    SELECT part, date, division, {scaled_sql("spi", digits=3)}, {_LABELS} FROM both_parts"""
)
def separate_spi_fits(spark, sf_dir):
    """Split, an index fitted on each part by itself, and the three labels."""
    training, test = labelled_sets(_stations(spark, sf_dir), 8630)
    names = [f"{h}_severity" for h in _HAZARDS]
    train = training["flood"]
    for hazard in _HAZARDS[1:]:
        train = train.join(training[hazard].select(*KEY, f"{hazard}_severity"), KEY)
    parts = [
        df.select(F.lit(part).alias("part"), *KEY, scaled("spi", 3), *names)
        for part, df in (("train", train), ("test", test))
    ]
    return parts[0].unionByName(parts[1])
