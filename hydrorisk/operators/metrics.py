"""Classification metrics from confusion counts.

A confusion table holds at most classes² rows per group, so everything after
the first grouped count is small.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrorisk.schemas import HORIZONS, PREDICTIONS, TARGETS
from hydrorisk.session import settle


def exact_match(
    df: DataFrame, truths: list[str] = TARGETS, guesses: list[str] = PREDICTIONS
) -> DataFrame:
    """Rows, and share of rows whose horizons are all right."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(_all_right(truths, guesses)).alias("exact_match"),
    )


def _all_right(truths: list[str], guesses: list[str]) -> Column:
    pairs = zip(truths, guesses, strict=True)
    return reduce(and_, [F.col(y) == F.col(p) for y, p in pairs]).cast("int")


def horizon_pairs(
    df: DataFrame, truths: list[str] = TARGETS, guesses: list[str] = PREDICTIONS
) -> DataFrame:
    """(horizon, y_true, y_pred) rows of a wide prediction table, and whether all were right."""
    pairs = [
        F.struct(
            F.lit(h).alias("horizon"),
            F.col(y).cast("int").alias("y_true"),
            F.col(p).cast("int").alias("y_pred"),
            _all_right(truths, guesses).alias("all_right"),
        )
        for h, y, p in zip(HORIZONS, truths, guesses, strict=True)
    ]
    return df.select(F.inline(F.array(*pairs)))


def confusion(
    df: DataFrame, y: str = "y_true", p: str = "y_pred", by: list[str] | None = None
) -> DataFrame:
    """Rows per (group, true class, predicted class)."""
    return df.groupBy(*(by or []), F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def _keyed(counts: DataFrame, by: list[str] | None) -> tuple[DataFrame, list[str]]:
    return (counts, by) if by else (counts.withColumn("_all", F.lit(1)), ["_all"])


def accuracy(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    counts, keys = _keyed(counts, by)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("rows")).otherwise(0)
    return (
        counts.groupBy(*keys).agg((F.sum(hit) / F.sum("rows")).alias("accuracy")).drop("_all")
    )


def class_f1(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per class of the union of true and predicted: F1 and true rows; undefined F1 is 0."""
    counts, keys = _keyed(counts, by)
    sides = F.array(
        F.struct(
            F.col("y_true").alias("class"),
            F.col("rows").alias("true_rows"),
            F.lit(0).cast("bigint").alias("predicted_rows"),
        ),
        F.struct(
            F.col("y_pred").alias("class"),
            F.lit(0).cast("bigint").alias("true_rows"),
            F.col("rows").alias("predicted_rows"),
        ),
    )
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("true_rows")).otherwise(0)
    return (
        counts.select(*keys, "y_true", "y_pred", F.inline(sides))
        .groupBy(*keys, "class")
        .agg(
            F.sum("true_rows").alias("true_rows"),
            F.sum("predicted_rows").alias("predicted_rows"),
            F.sum(hit).alias("hits"),
        )
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(2 * F.col("hits"), F.col("true_rows") + F.col("predicted_rows")),
                F.lit(0.0),
            ),
        )
        .drop("_all")
    )


def f1_scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Plain mean of the class F1 values, and the mean weighted by true rows."""
    classes, keys = _keyed(class_f1(counts, by), by)
    return (
        classes.groupBy(*keys)
        .agg(
            F.avg("f1").alias("f1_macro"),
            (F.sum(F.col("f1") * F.col("true_rows")) / F.sum("true_rows")).alias("f1_weighted"),
        )
        .drop("_all")
    )


def against_majority(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro F1 of the predictions, and of always saying the group's most frequent true class."""
    counts, keys = _keyed(counts, by)
    truth = counts.groupBy(*keys, "y_true").agg(F.sum("rows").alias("rows"))
    size = F.struct(F.col("rows"), -F.col("y_true"))
    most = truth.groupBy(*keys).agg(F.max_by("y_true", size).alias("y_pred"))
    constant = f1_scores(truth.join(most, keys), keys).select(
        *keys, F.col("f1_macro").alias("majority_f1_macro")
    )
    own = f1_scores(counts, keys).select(*keys, "f1_macro")
    return own.join(constant, keys).drop("_all")


def quadratic_kappa(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Agreement beyond chance with squared class distance.

    Distance counts positions in the sorted union of classes, so an absent class
    closes up. The expected disagreement follows from first and second moments of
    the two margins; no class pairs are formed. Missing if it is zero.
    """
    counts, keys = _keyed(counts, by)
    ranked = Window.partitionBy(*keys).orderBy("class")
    place = (
        counts.select(*keys, F.explode(F.array("y_true", "y_pred")).alias("class"))
        .distinct()
        .withColumn("place", F.dense_rank().over(ranked))
    )
    true_place = place.select(*keys, F.col("class").alias("y_true"), F.col("place").alias("i"))
    pred_place = place.select(*keys, F.col("class").alias("y_pred"), F.col("place").alias("j"))
    i, j, n = F.col("i"), F.col("j"), F.col("rows")
    sums = (
        counts.join(true_place, [*keys, "y_true"])
        .join(pred_place, [*keys, "y_pred"])
        .groupBy(*keys)
        .agg(
            F.sum(n).alias("n"),
            F.sum(n * (i - j) * (i - j)).alias("seen"),
            F.sum(n * i).alias("i1"),
            F.sum(n * j).alias("j1"),
            F.sum(n * i * i).alias("i2"),
            F.sum(n * j * j).alias("j2"),
        )
    )
    total = F.col("n").cast("double")
    chance = F.col("i2") + F.col("j2") - 2.0 * F.col("i1") * F.col("j1") / total
    return sums.select(
        *keys, (1 - F.try_divide(F.col("seen").cast("double"), chance)).alias("kappa")
    ).drop("_all")


def metric_table(counts: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, both F1 means and kappa, one row per group."""
    return (
        accuracy(counts, by)
        .join(f1_scores(counts, by), by)
        .join(quadratic_kappa(counts, by), by)
    )


def evaluate_predictions(df: DataFrame, hazard: str) -> DataFrame:
    """Metric table hazard x horizon of a wide prediction table, with the exact match.

    The predictions are read once: all scores follow from the confusion counts.
    """
    counts = settle(
        horizon_pairs(df)
        .groupBy("horizon", "y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("all_right").alias("all_right")),
        "confusion",
    )
    exact = counts.groupBy("horizon").agg(
        (F.sum("all_right") / F.sum("rows")).alias("exact_match")
    )
    return (
        metric_table(counts.drop("all_right"), ["horizon"])
        .join(exact, "horizon")
        .select(
            F.lit(hazard).alias("hazard"),
            "horizon",
            "accuracy",
            "f1_macro",
            "f1_weighted",
            "kappa",
            "exact_match",
        )
    )
