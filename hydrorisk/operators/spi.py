"""Standardized Precipitation Index: grouped gamma fit, mixed CDF, normal quantile.

The fit needs four sufficient statistics per division, one ordinary grouped
aggregation with map-side partials; only the shape equation (one row per
division) and the final score (one Arrow pass, no shuffle of its own) use Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrorisk.functions.gamma import gamma_shape, spi_score
from hydrorisk.functions.scalars import no_nan, round_half_even
from hydrorisk.operators.windows import over_rows, rolling_sums
from hydrorisk.schemas import DIVISION, RAIN
from hydrorisk.session import settle

WINDOWS = [30, 90, 180]


def gamma_stats(df: DataFrame, columns: list[str], by: str = DIVISION) -> DataFrame:
    """Per group and column: present values, share of exact zeros, mean and mean log
    of the positive values."""
    aggregates = []
    for c in columns:
        x = no_nan(F.col(c).cast("double"))
        positive = F.when(x > 0, x)
        aggregates += [
            F.count(x).alias(f"{c}_n"),
            F.avg(F.when(x.isNotNull(), (x == 0).cast("int"))).alias(f"{c}_q"),
            F.avg(positive).alias(f"{c}_mean"),
            F.avg(F.ln(positive)).alias(f"{c}_mean_log"),
        ]
    return df.groupBy(by).agg(*aggregates)


def fit_spi(df: DataFrame, columns: list[str], by: str = DIVISION) -> DataFrame:
    """Fitted parameters, one row per group: n, q, alpha, beta of each column.

    alpha and beta are missing where no value is positive or all are equal.
    """
    return fit_from_stats(gamma_stats(df, columns, by), columns, by)


def fit_from_stats(stats: DataFrame, columns: list[str], by: str = DIVISION) -> DataFrame:
    """The same from the statistics that :func:`gamma_stats` gives."""
    shaped = stats.withColumns(
        {f"{c}_alpha": gamma_shape(F.ln(f"{c}_mean") - F.col(f"{c}_mean_log")) for c in columns}
    )
    fitted = []
    for c in columns:
        fitted += [
            f"{c}_n",
            f"{c}_q",
            f"{c}_alpha",
            (F.col(f"{c}_mean") / F.col(f"{c}_alpha")).alias(f"{c}_beta"),
        ]
    return shaped.select(by, *fitted)


def apply_spi_params(df: DataFrame, params: DataFrame, by: str = DIVISION) -> DataFrame:
    """Attach the fitted parameters.

    No broadcast hint: stored parameters have a known size, so the planner
    broadcasts them while they are small, without shuffling the panel, and
    otherwise joins by division and splits a skewed one.
    """
    return df.join(params, by, "left")


def transform_spi(
    df: DataFrame, params: DataFrame, outputs: dict[str, str], by: str = DIVISION
) -> DataFrame:
    """Score columns with given parameters; ``outputs`` maps column → new index column."""
    scored = apply_spi_params(df, params, by).withColumns(
        {
            target: spi_score(
                F.col(c).cast("double"), F.col(f"{c}_q"), F.col(f"{c}_alpha"), F.col(f"{c}_beta")
            )
            for c, target in outputs.items()
        }
    )
    return scored.select(*df.columns, *outputs.values())


def store_fit(df: DataFrame, columns: list[str], by: str = DIVISION) -> DataFrame:
    """:func:`fit_spi`, written to the shared folder so that its size is known."""
    return settle(fit_spi(df, columns, by), "fit")


def spi_daily(df: DataFrame, digits: int = 3) -> DataFrame:
    """One-day index of the rain, fitted on the rows given, as column ``spi``."""
    scored = transform_spi(df, store_fit(df, [RAIN]), {RAIN: "spi"})
    return scored.withColumn("spi", round_half_even(F.col("spi"), digits))


def long_sums(
    df: DataFrame, windows: list[int] = WINDOWS, rows_per_task: int | None = None
) -> DataFrame:
    """Full-window rolling rain sums, missing until the window is filled."""
    stages, helpers = rolling_sums(RAIN, {n: f"rain_rolling_{n}d" for n in windows})
    reach = max(windows) - 1
    return over_rows(df, *stages, back=reach, rows_per_task=rows_per_task).drop(*helpers)


def spi_window(
    df: DataFrame, windows: list[int] = WINDOWS, rows_per_task: int | None = None
) -> DataFrame:
    """Index of the rolling sums as ``spi_<n>d``, all windows in one pass.

    Fit and score both read the sums, so they are written once to the shared
    folder. Fit on all rows: apply a date limit afterwards. Starts jobs.
    """
    sums = settle(long_sums(df, windows, rows_per_task), "rolling-sums")
    columns = [f"rain_rolling_{n}d" for n in windows]
    outputs = {f"rain_rolling_{n}d": f"spi_{n}d" for n in windows}
    return transform_spi(sums, store_fit(sums, columns), outputs).drop(*columns)


def spi_against_baseline(df: DataFrame, params: DataFrame) -> DataFrame:
    """One-day index of new rain against stored historical parameters."""
    return transform_spi(df, params, {RAIN: "spi"})
