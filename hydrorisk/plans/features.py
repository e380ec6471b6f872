"""From the three sources to the master feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hydrorisk.functions.scalars import month_cyclic, round_frame, since
from hydrorisk.operators.panel import assemble_unique_panel
from hydrorisk.operators.spi import WINDOWS, store_fit, transform_spi
from hydrorisk.operators.windows import antecedent_rain, over_rows, rolling_sums
from hydrorisk.schemas import DATE, DIVISION, MEASURES, RAIN
from hydrorisk.session import settle

FIRST_DAY = "2015-01-01"


def feature_matrix(
    rain: DataFrame,
    temperature: DataFrame,
    soil: DataFrame,
    first_day: str = FIRST_DAY,
    windows: list[int] = WINDOWS,
) -> DataFrame:
    """Join, antecedent rain, seasonal encoding and indices, from ``first_day`` on, 3 digits.

    Earlier rows still warm up the windows and take part in the fits. A key that a source
    repeats is an error. All window
    columns share one pass over the panel, written once because fit and score
    both read it.
    """
    panel = assemble_unique_panel(rain, temperature, soil)
    sums = {n: f"_sum_{n}" for n in windows}
    stages, helpers = rolling_sums(RAIN, sums)
    windowed = over_rows(panel, antecedent_rain, *stages, back=max(windows) - 1)
    staged = settle(month_cyclic(windowed).drop(*helpers), "windowed")
    fit = store_fit(staged, list(sums.values()))
    scored = transform_spi(staged, fit, {s: f"spi_{n}d" for n, s in sums.items()})
    matrix = round_frame(since(scored, first_day))
    return matrix.select(
        DATE,
        DIVISION,
        *MEASURES,
        "rain_lag_1",
        "rain_rolling_3d",
        "rain_rolling_7d",
        "month_sin",
        "month_cos",
        *[f"spi_{n}d" for n in windows],
    )
