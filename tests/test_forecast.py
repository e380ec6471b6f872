import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrorisk.operators import forecast, metrics
from hydrorisk.operators.panel import balanced_weights, fit_division_encoder
from hydrorisk.operators.splits import split_fraction
from hydrorisk.plans import risk_queries
from hydrorisk.plans.hazards import evaluate_all, labelled_sets, train_all
from hydrorisk.schemas import FEATURES, PREDICTIONS, SEVERITIES, SOIL, TARGETS
from hydrorisk.session import settle, shared_path
from tests.conftest import random_panel, sorted_pandas, to_spark

SMALL = forecast.TreeParams(trees=8, depth=4)


@pytest.fixture(scope="module")
def frame():
    """Labelled panel whose label depends on rain and persists, with a few gaps."""
    panel = random_panel(11, divisions=6, days=250, missing=0.02)
    rng = np.random.default_rng(12)
    panel["temperature_2m_mean"] = np.round(rng.normal(25, 3, len(panel)), 2)
    for m in SOIL:
        panel[m] = np.round(rng.uniform(0.1, 0.5, len(panel)), 4)
    panel.loc[rng.random(len(panel)) < 0.05, SOIL[2]] = np.nan
    week = panel.groupby("division")["rain_sum"].transform(lambda s: s.rolling(9, min_periods=1).sum())
    panel["spi"] = np.round((week - week.mean()) / week.std(), 3)
    panel["flood_severity"] = pd.cut(
        panel["spi"], [-np.inf, 0.5, 1.0, 1.5, np.inf], labels=SEVERITIES
    ).astype(object)
    panel.loc[panel["spi"].isna(), "flood_severity"] = "Normal"
    panel.loc[panel.index % 97 == 5, "flood_severity"] = "Unknown"
    return panel


SCHEMA = (
    "date date, division string, rain_sum double, temperature_2m_mean double, "
    + ", ".join(f"{m} double" for m in SOIL)
    + ", spi double, flood_severity string"
)


@pytest.fixture(scope="module")
def labelled(spark, frame):
    return settle(to_spark(spark, frame, SCHEMA))


@pytest.fixture(scope="module")
def prepared(labelled):
    return settle(forecast.prepare_horizon(labelled, "flood_severity")[0])


def expected_rows(frame, known=None):
    """The same preparation with pandas, step by step."""
    df = frame.sort_values(["division", "date"]).reset_index(drop=True)
    by = df.groupby("division")["rain_sum"]
    df["rain_lag_1"] = by.shift(1)
    for n in (3, 7):
        df[f"rain_rolling_{n}d"] = by.transform(lambda s, n=n: s.rolling(n, min_periods=1).sum())
    month = pd.to_datetime(df["date"]).dt.month
    df["month_sin"], df["month_cos"] = np.sin(2 * np.pi * month / 12), np.cos(2 * np.pi * month / 12)
    df = df[df["rain_lag_1"].notna()]
    names = sorted(df["division"].unique()) if known is None else known
    df = df[df["division"].isin(names)].copy()
    df["division_encoded"] = df["division"].map({n: i for i, n in enumerate(names)})
    df["level"] = df["flood_severity"].map({s: i for i, s in enumerate(SEVERITIES)})
    for h, t in enumerate(TARGETS, start=1):
        df[t] = df.groupby("division")["level"].shift(-h)
    return df.dropna(subset=[*TARGETS, "level"]).reset_index(drop=True)


def same_rows(got, expected):
    assert len(got) == len(expected)
    assert list(got["division"]) == list(expected["division"])
    assert list(got["date"]) == list(expected["date"])
    columns = [*FEATURES, *TARGETS]
    np.testing.assert_allclose(got[columns].astype(float), expected[columns].astype(float), atol=1e-9)


def test_preparation_matches_pandas(frame, prepared):
    assert prepared.columns == ["division", "date", *FEATURES, *TARGETS]
    same_rows(sorted_pandas(prepared), expected_rows(frame))


def test_preparation_with_a_given_encoder(spark, frame, labelled):
    names = ["div 1", "div 3", "div 4"]
    encoder = fit_division_encoder(spark.createDataFrame([(n,) for n in names], "division string"))
    got, same = forecast.prepare_horizon(labelled, "flood_severity", encoder)
    assert same is encoder
    same_rows(sorted_pandas(got), expected_rows(frame, names))


def majority_f1(df):
    top = df.groupBy(TARGETS[0]).count().orderBy(F.desc("count")).first()[0]
    counts = metrics.confusion(df.withColumn("p", F.lit(top)), TARGETS[0], "p")
    return metrics.f1_scores(counts).first()["f1_macro"]


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_fit_predict_save_load(spark, prepared, kind):
    cut = datetime.date(1992, 6, 1)
    train, test = prepared.filter(F.col("date") < cut), prepared.filter(F.col("date") >= cut)
    params = forecast.TreeParams(kind=kind, trees=8 if kind == "forest" else 3, depth=3)
    model = forecast.fit_hazard(train, balanced_weights(train, TARGETS[0]), params)
    predicted = forecast.predict(test, model)
    assert predicted.columns == [*test.columns, *PREDICTIONS]
    assert predicted.count() == test.count()
    assert predicted.filter(" OR ".join(f"{p} NOT IN (0, 1, 2, 3)" for p in PREDICTIONS)).count() == 0
    counts = metrics.confusion(predicted, TARGETS[0], PREDICTIONS[0])
    assert metrics.f1_scores(counts).first()["f1_macro"] > majority_f1(test)
    path = shared_path(spark, "t-model")
    encoder = fit_division_encoder(train)
    forecast.save_model(model, encoder, path)
    loaded, codes = forecast.load_model(spark, path)
    again = forecast.predict(test, loaded)
    assert again.exceptAll(predicted).count() == 0
    assert codes.exceptAll(encoder).count() == 0
    names = forecast.predicted_names(predicted).select(PREDICTIONS[0]).distinct().collect()
    assert {r[0] for r in names} <= set(SEVERITIES)


def test_boosting_ends_by_held_back_rows(prepared):
    """Rounds end before the limit, and class weights are taken."""
    params = forecast.TreeParams(kind="boosted", trees=40, depth=2, learning_rate=0.2)
    model = forecast.fit_hazard(prepared.coalesce(1), balanced_weights(prepared, TARGETS[0]), params)
    rounds = forecast.boosting_rounds(model)
    assert set(rounds) == {(t, level) for t in TARGETS for level in range(len(SEVERITIES))}
    assert max(rounds.values()) <= 40 and min(rounds.values()) < 40


def test_a_constant_or_random_answer_does_not_count_as_learned(prepared):
    """What the model queries call learned is false for an answer that looks at nothing."""
    constant = prepared.withColumns({p: F.lit(0) for p in PREDICTIONS})
    perfect = prepared.withColumns({p: F.col(t) for p, t in zip(PREDICTIONS, TARGETS)})
    assert not risk_queries._learned(constant).first()["learned"]
    assert risk_queries._learned(perfect).first()["learned"]
    assert not risk_queries._learned(perfect.limit(0)).first()["learned"]


def test_drawn_settings_stay_in_range():
    drawn = [forecast.draw_params(7, t, "boosted") for t in range(200)]
    assert drawn == [forecast.draw_params(7, t, "boosted") for t in range(200)]
    assert {50 <= p.trees <= 150 and 3 <= p.depth <= 8 for p in drawn} == {True}
    assert {0.01 <= p.learning_rate <= 0.2 for p in drawn} == {True}
    assert {0.6 <= min(p.row_share, p.column_share) for p in drawn} == {True}
    assert {max(p.row_share, p.column_share) <= 1.0 for p in drawn} == {True}


def test_tuning_picks_the_best_candidate(prepared):
    candidates = [forecast.TreeParams(trees=2, depth=1), SMALL]
    best, scores = forecast.tune_hazard(prepared, candidates=candidates)
    assert best == max(scores, key=lambda s: s[1])[0]
    assert all(0 <= s <= 1 for _, s in scores)


def test_settings_are_scored_together(spark, prepared, monkeypatch):
    """The hold-out passes Python once for all settings; trees too large for that are walked by Spark."""
    calls, ask = [], forecast.forest_classes
    monkeypatch.setattr(forecast, "forest_classes", lambda *args: (calls.append(args), ask(*args))[1])
    candidates = [forecast.TreeParams(trees=3, depth=d) for d in (1, 3, 12)]
    _, scores = forecast.tune_hazard(prepared, candidates=candidates)
    assert len(calls) == 1 and len(calls[0][2]) in (6, 9)
    fitting, holdout = split_fraction(prepared, 0.8)
    weights = settle(balanced_weights(prepared, TARGETS[0]))
    for params, score in scores:
        predicted = forecast.predict(holdout, forecast.fit_hazard(fitting, weights, params))
        assert score == metrics.exact_match(predicted).first()["exact_match"]


def test_cross_validation(prepared):
    row = forecast.cross_validate_day1(prepared, SMALL).first()
    assert 0.5 < row["accuracy"] <= 1
    assert 0 < row["f1_macro"] <= row["f1_weighted"] <= 1


def test_whole_run_from_matrix_to_evaluation(spark, labelled, monkeypatch):
    matrix = labelled.drop("spi", "flood_severity")
    training, test = labelled_sets(matrix, test_rows=300)
    assert test.count() == 300
    monkeypatch.setattr(forecast, "draw_params", lambda seed, trial, kind: SMALL)
    path = shared_path(spark, "t-hazards")
    scores = train_all(training, path, trials=1)
    assert set(scores) == {"flood", "landslide", "drought"}
    table = evaluate_all(test, path).collect()
    # the tail starts inside the last-but-one division, which training knows
    assert {(r["hazard"], r["horizon"]) for r in table} >= {("flood", 1), ("landslide", 3)}


def test_batches_give_the_classes_of_transform(spark, prepared):
    """Trees of all sizes that fit a word, in batches, with missing inputs; none walks them row by row."""
    for params in (forecast.TreeParams(trees=9, depth=3), forecast.TreeParams(trees=30, depth=6)):
        model = forecast.fit_hazard(prepared, None, params)
        asked = forecast.predict(prepared, model)
        assert "Arrow" in asked._jdf.queryExecution().executedPlan().toString()
        walked = model.transform(prepared).select(
            *asked.columns[:-3], *[F.col(p).cast("int").alias(p) for p in PREDICTIONS]
        )
        assert asked.exceptAll(walked).isEmpty() and asked.count() == prepared.count()


def test_labels_of_all_hazards_share_one_shuffle(spark, labelled):
    """Rows of two labels prepared together are those of each alone, moved once."""
    both = labelled.withColumn("drought_severity", F.when(F.col("rain_sum") > 5, "Severe").otherwise("Normal"))
    rows = forecast.horizon_rows(both, ["flood_severity", "drought_severity"])
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    encoder = fit_division_encoder(both)
    for label in ("flood_severity", "drought_severity"):
        alone = forecast.prepare_horizon(both, label, encoder)[0]
        together = forecast.encode_horizon(rows, label, encoder)
        assert alone.exceptAll(together).isEmpty() and together.exceptAll(alone).isEmpty()


def test_models_that_differ_are_told(spark, prepared):
    models = [forecast.fit_hazard(prepared, None, forecast.TreeParams(trees=5, depth=d)) for d in (2, 5)]
    one, two = (forecast.predict(prepared, m).select("division", "date", *PREDICTIONS) for m in models)
    assert risk_queries._moved(prepared, *models).count() == one.exceptAll(two).count() > 0
