"""From the feature matrix to labelled data sets, models and evaluation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from hydrorisk.functions.severity import hazard_datasets, label_all
from hydrorisk.operators.forecast import (
    evaluate_hazard,
    load_model,
    prepare_horizon,
    save_model,
    train_hazard,
)
from hydrorisk.operators.spi import spi_daily
from hydrorisk.operators.splits import split_tail
from hydrorisk.session import settle

HAZARDS = ["flood", "landslide", "drought"]

# Fixed size of the held-out tail.
TEST_ROWS = 86_300


def labelled_sets(
    matrix: DataFrame, test_rows: int = TEST_ROWS
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Training set per hazard, and one test set with all labels.

    The daily index is fitted separately on the training and on the test rows.
    """
    train, test = split_tail(matrix, test_rows)
    indexed = settle(spi_daily(train), "training")
    return hazard_datasets(indexed), settle(label_all(spi_daily(test)), "test")


def train_all(
    training: dict[str, DataFrame], path: str, trials: int = 5, kind: str = "forest"
) -> dict[str, dict[str, float]]:
    """Tune, fit and store one model per hazard; returns exact match on both parts."""
    scores = {}
    for hazard in HAZARDS:
        prepared, encoder = prepare_horizon(training[hazard], f"{hazard}_severity")
        model, _, scores[hazard] = train_hazard(settle(prepared, "prepared"), trials, kind=kind)
        save_model(model, encoder, f"{path}/{hazard}")
    return scores


def evaluate_all(test: DataFrame, path: str) -> DataFrame:
    """Metric table of the stored models, hazard x horizon."""
    tables = []
    for hazard in HAZARDS:
        model, encoder = load_model(test.sparkSession, f"{path}/{hazard}")
        prepared, _ = prepare_horizon(test, f"{hazard}_severity", encoder)
        tables.append(evaluate_hazard(prepared, model, hazard))
    return reduce(DataFrame.unionByName, tables)
