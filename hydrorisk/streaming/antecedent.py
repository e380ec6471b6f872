"""Antecedent rain of a stream of daily actuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hydrorisk.schemas import DATE, DIVISION, RAIN

MEMORY = 7

OUTPUT = (
    f"{DIVISION} string, {DATE} date, {RAIN} double,"
    " rain_lag_1 double, rain_rolling_3d double, rain_rolling_7d double, late boolean"
)
STATE = "days array<date>, rain array<double>, forgotten boolean"


def _extend(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Put the new days of one division among its last days and emit their features.

    Days that are remembered, or arrive twice together, are repeated deliveries and are
    dropped. ``late`` marks a day at or before the last remembered one. Where older days
    are forgotten that its sums would need, its features are missing: such rows, and
    the days after a late one, are for the batch operator to redo.
    """
    new = pd.concat([f[[DATE, RAIN]].astype({RAIN: float}) for f in frames], ignore_index=True)
    days, remembered, forgotten = state.get if state.exists else ([], [], False)
    new = new.sort_values([DATE, RAIN]).drop_duplicates(DATE)
    new = new[~new[DATE].isin(days)].assign(_new=True)
    if len(days):
        held = pd.DataFrame({DATE: days, RAIN: pd.Series(remembered, dtype=float), "_new": False})
        new = pd.concat([held, new], ignore_index=True) if len(new) else held
    rows = new.sort_values(DATE, kind="stable").reset_index(drop=True)
    rain = rows[RAIN].to_numpy(dtype=float)
    fresh = rows["_new"].to_numpy(dtype=bool)
    result = pd.DataFrame(
        {
            DIVISION: key[0],
            DATE: rows[DATE],
            RAIN: rain,
            "rain_lag_1": np.concatenate([[np.nan], rain[:-1]]),
            "rain_rolling_3d": _window_sum(rain, 3),
            "rain_rolling_7d": _window_sum(rain, 7),
            "late": rows[DATE] <= days[-1] if len(days) else False,
        }
    )
    if forgotten:
        before = (rows[DATE] < days[0]).sum()
        result.loc[: before + MEMORY - 2, ["rain_lag_1", "rain_rolling_3d", "rain_rolling_7d"]] = np.nan
    last = rows.tail(MEMORY)
    kept = [None if np.isnan(v) else float(v) for v in last[RAIN]]
    state.update((list(last[DATE]), kept, bool(forgotten or len(rows) > MEMORY)))
    yield result[fresh]


def _window_sum(values: np.ndarray, rows: int) -> np.ndarray:
    """Sum of the values present in the last ``rows``; missing if none is."""
    padded = np.concatenate([np.full(rows - 1, np.nan), values])
    frames = np.lib.stride_tricks.sliding_window_view(padded, rows)
    return np.where(np.isnan(frames).all(axis=1), np.nan, np.nansum(frames, axis=1))


def stream_antecedent_rain(stream: DataFrame) -> DataFrame:
    """Lag and 3 / 7 row sums per division from at most seven remembered days.

    The new days of one division are one task's: bound a trigger with the source's
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``, above all for a first load.
    """
    return (
        stream.select(DIVISION, DATE, RAIN)
        .groupBy(DIVISION)
        .applyInPandasWithState(
            _extend, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
        )
    )
