"""Row-based windows per division, and exact positions, without one-task groups.

History is counted in rows, not calendar days: a missing date shortens it.

Rows of a division are in one total order: by date, and rows of one day by a hash of
their content, so that repeated days are placed alike in every run. A division is a
window task of its own unless the caller sets ``rows_per_task``: then every row gets its
exact position in the division, slices are cut by position, and each slice also
receives the rows just outside it that its frames reach. Both give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hydrorisk.schemas import DATE, DIVISION, RAIN
from hydrorisk.session import shared_root

# Builds new columns from the window they are to run over.
Stage = Callable[[WindowSpec], dict[str, Column]]


def panel_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(DIVISION, DATE)


def positions(
    df: DataFrame, by: list[str], block: str, order: list[str | Column], name: str = "position"
) -> DataFrame:
    """1-based rank of each row within ``by``, exact, ranked block by block.

    ``block`` is a coarser form of ``order`` (month of the date, prefix of a
    hash), so no task ranks more than one block of a group; the sizes of the
    earlier blocks shift the ranks. NULLs in ``by`` and ``block`` are values like others,
    and come first.
    """
    group = F.struct(*dict.fromkeys([*by, block]))
    before = Window.partitionBy(*[f"_group.{c}" for c in by]).orderBy(f"_group.{block}")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(group.alias("_group"))
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_group", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    # Ranks and starts meet by the one struct, which is never NULL: the rows move once.
    rank = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    ranked = df.withColumn("_group", group).withColumn("_rank", rank)
    return ranked.join(starts, "_group").select(
        *df.columns, (F.col("_start") + F.col("_rank")).alias(name)
    )


def over_rows(
    df: DataFrame,
    *stages: Stage,
    back: int = 0,
    ahead: int = 0,
    rows_per_task: int | None = None,
    block: str = "month",
) -> DataFrame:
    """Add window columns computed over (division, date) order.

    Later stages may use the columns of earlier ones; together their frames may
    reach at most ``back`` rows before and ``ahead`` rows after the current one.
    By default a task holds a whole division, which daily rows keep small: thirty years
    are 11,000 of them. Set ``rows_per_task`` where a division may hold many times that;
    it costs one more shuffle and changes no row. A NULL division is one division.
    """
    ordered = df.withColumn("_content", F.xxhash64(*df.columns))
    if rows_per_task is None:
        window = Window.partitionBy(DIVISION).orderBy(DATE, "_content")
        return _add_stages(ordered, stages, window).drop("_content")
    return _over_slices(ordered, stages, back, ahead, rows_per_task, block)


def _add_stages(df: DataFrame, stages: tuple[Stage, ...], window: WindowSpec) -> DataFrame:
    for stage in stages:
        df = df.withColumns(stage(window))
    return df


def _over_slices(
    df: DataFrame,
    stages: tuple[Stage, ...],
    back: int,
    ahead: int,
    rows_per_task: int,
    block: str,
) -> DataFrame:
    size = max(rows_per_task, back, ahead)
    placed = positions(
        df.withColumn("_block", F.trunc(DATE, block)),
        [DIVISION],
        "_block",
        [DATE, "_content"],
        "_position",
    ).drop("_block", "_content")
    index = F.col("_position") - 1
    home = F.floor(index / size)
    offset = index % size
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= size - back, home + 1),
            F.when((offset < ahead) & (home > 0), home - 1),
        )
    )
    spread = placed.withColumn("_home", home).withColumn("_slice", F.explode(copies))
    window = Window.partitionBy(DIVISION, "_slice").orderBy("_position")
    return (
        _add_stages(spread, stages, window)
        .filter(F.col("_slice") == F.col("_home"))
        .drop("_slice", "_home", "_position")
    )


def lag_rows(window: WindowSpec, column: str = RAIN) -> Column:
    """Value of the previous row."""
    return F.lag(column, 1).over(window)


def rolling_sum(window: WindowSpec, column: str, rows: int, min_periods: int) -> Column:
    """Sum of the last ``rows`` rows; missing below ``min_periods`` present values."""
    frame = window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(column).over(frame) >= min_periods, F.sum(column).over(frame))


def rolling_sums(column: str, names: dict[int, str]) -> tuple[list[Stage], list[str]]:
    """Full-window sums of several lengths, as stages and the helper columns to drop.

    A sum over k units of rows is the last unit's sum plus the ones k-1, k-2, …
    units back, so each row adds one unit and a few earlier results instead of
    every row of every frame.
    """
    unit = math.gcd(*names)

    def units(window: WindowSpec) -> dict[str, Column]:
        frame = window.rowsBetween(-(unit - 1), 0)
        return {
            "_unit_sum": F.coalesce(F.sum(column).over(frame), F.lit(0.0)),
            "_unit_rows": F.count(column).over(frame),
        }

    def earlier(window: WindowSpec) -> dict[str, Column]:
        back = range(1, max(names) // unit)
        sums = {f"_unit_sum_{k}": F.lag("_unit_sum", k * unit, 0.0).over(window) for k in back}
        rows = {f"_unit_rows_{k}": F.lag("_unit_rows", k * unit, 0).over(window) for k in back}
        return {**sums, **rows}

    def totals(_: WindowSpec) -> dict[str, Column]:
        result = {}
        for n, name in names.items():
            total, rows = F.col("_unit_sum"), F.col("_unit_rows")
            for k in range(1, n // unit):
                total, rows = total + F.col(f"_unit_sum_{k}"), rows + F.col(f"_unit_rows_{k}")
            result[name] = F.when(rows >= n, total)
        return result

    helpers = ["_unit_sum", "_unit_rows"]
    for k in range(1, max(names) // unit):
        helpers += [f"_unit_sum_{k}", f"_unit_rows_{k}"]
    return [units, earlier, totals], helpers


def antecedent_rain(window: WindowSpec) -> dict[str, Column]:
    """Yesterday's rain and the 3 and 7 row sums."""
    return {
        "rain_lag_1": lag_rows(window),
        "rain_rolling_3d": rolling_sum(window, RAIN, 3, 1),
        "rain_rolling_7d": rolling_sum(window, RAIN, 7, 1),
    }


def lead_rows(window: WindowSpec, column: str, horizons: list[int]) -> dict[str, Column]:
    """Value 1, 2, … rows ahead as ``target_day<h>``."""
    return {f"target_day{h}": F.lead(column, h).over(window) for h in horizons}


def running_total(df: DataFrame, order: list[str | Column], value: str, name: str) -> DataFrame:
    """Running sum over a global order, without one task for all rows.

    A range-partitioned sort is fixed by a checkpoint; the partition totals (one
    row per partition) shift the sums made inside each partition.
    """
    shared_root(df.sparkSession)
    ordered = df.orderBy(*order).withColumn("_slice", F.spark_partition_id()).checkpoint()
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy("_slice")
        .agg(F.sum(value).alias("_size"))
        .select("_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = (
        Window.partitionBy("_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ordered.withColumn("_inside", F.sum(value).over(inside))
        .join(starts, "_slice")
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_slice", "_start", "_inside")
    )
