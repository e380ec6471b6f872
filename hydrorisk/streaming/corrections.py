"""Antecedent rain of a stream in which days come late, come again, or come corrected.

``stream_corrected_rain`` keeps the last rows of every division as state. A day that arrives
behind others is put in its place, and it and the six rows after it, whose frames it is
in, are given out again with a higher ``version``; so is a day that comes again with another
value, and the rows after it. A day that comes again unchanged gives nothing. What the newest
versions say is what the batch operator says of all days delivered so far.

A day so late that its own frame reaches behind the remembered rows is given out as kind
``redo`` without features; ``redo_from_panel`` recomputes it and the six rows after it
from the stored panel, reading only the divisions concerned. ``merged_rain`` puts both together.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hydrorisk.operators.windows import antecedent_rain, over_rows
from hydrorisk.schemas import DATE, DIVISION, KEY, RAIN

# Rows a frame spans, and rows remembered: days late by up to their difference are corrected here.
FRAME = 7
REMEMBERED = 60

COLUMNS = ["rain_lag_1", "rain_rolling_3d", "rain_rolling_7d"]
NEW, LATE, CORRECTED, REDO = "new", "late", "corrected", "redo"
OUTPUT = (
    f"{DIVISION} string, {DATE} date, {RAIN} double, rain_lag_1 double, rain_rolling_3d double,"
    " rain_rolling_7d double, version int, kind string"
)
STATE = "days array<date>, rain array<double>, versions array<int>, forgotten boolean"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which this operator's state needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _sums(rain: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the values present among the last ``rows`` rows, oldest first; missing if none is."""
    present = ~np.isnan(rain)
    total, count = np.zeros(len(rain)), np.zeros(len(rain), int)
    for back in range(min(rows, len(rain)) - 1, -1, -1):
        end = len(rain) - back
        total[back:] += np.where(present[:end], rain[:end], 0.0)
        count[back:] += present[:end]
    return np.where(count > 0, total, np.nan)


class _Division:
    """The remembered rows of one division, in order of days."""

    def __init__(self, days: list, rain: list, versions: list, forgotten: bool):
        self.days, self.versions, self.forgotten = list(days), list(versions), forgotten
        self.rain = [np.nan if v is None else float(v) for v in rain]
        self.newest = self.days[-1] if self.days else None
        self.first: dict = {}
        self.changed: set = set()
        self.redo: list[tuple] = []

    def put(self, day, rain: float) -> None:
        """Take one delivered day; notes whose frames it changes."""
        at = bisect.bisect_left(self.days, day)
        if at < len(self.days) and self.days[at] == day:
            old = self.rain[at]
            if old == rain or (np.isnan(old) and np.isnan(rain)):
                return
            self.rain[at] = rain
        elif self.forgotten and at == 0:
            self.redo.append((day, rain))
            return
        else:
            self.days.insert(at, day)
            self.rain.insert(at, rain)
            self.versions.insert(at, -1)
            self.first[day] = LATE if self.newest is not None and day <= self.newest else NEW
        self.changed.add(day)

    def rows(self) -> list[tuple]:
        """Every row that is new or in whose frame something changed, once."""
        found, rain = [], np.array(self.rain, float)
        places = sorted({bisect.bisect_left(self.days, day) for day in self.changed})
        affected = sorted({i for p in places for i in range(p, min(p + FRAME, len(self.days)))})
        lag = np.concatenate([[np.nan], rain[:-1]]) if len(rain) else rain
        sums = [lag.tolist(), _sums(rain, 3).tolist(), _sums(rain, FRAME).tolist()]
        for i in affected:
            day = self.days[i]
            if self.forgotten and i < FRAME - 1:
                if day in self.changed:
                    self.redo.append((day, self.rain[i]))
                    self.versions[i] = max(self.versions[i], 0)
                continue
            self.versions[i] += 1
            kind = self.first.get(day, CORRECTED)
            found.append((day, self.rain[i], *[values[i] for values in sums], self.versions[i], kind))
        found += [(day, value, np.nan, np.nan, np.nan, None, REDO) for day, value in self.redo]
        return found

    def state(self) -> tuple:
        keep = slice(-REMEMBERED, None)
        rain = [None if np.isnan(v) else float(v) for v in self.rain[keep]]
        forgotten = bool(self.forgotten or len(self.days) > REMEMBERED)
        return self.days[keep], rain, self.versions[keep], forgotten


class _Corrections(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("rows", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict = {}
        for frame in rows:
            for day, rain in zip(frame[DATE].tolist(), frame[RAIN].to_numpy(float).tolist(), strict=True):
                least = new.get(day)
                if least is None or rain < least or least != least:
                    new[day] = rain
        held = self._state.get() or ([], [], [], False)
        division = _Division(*held)
        for day in sorted(new):
            division.put(day, new[day])
        found = division.rows()
        if division.changed:
            self._state.update(division.state())
        if found:
            names = [DATE, RAIN, *COLUMNS, "version", "kind"]
            columns = dict(zip(names, map(list, zip(*found, strict=True)), strict=True))
            columns["version"] = pd.array(columns["version"], dtype="Int32")
            yield pd.DataFrame({DIVISION: [key[0]] * len(found), **columns})

    def close(self) -> None:
        pass


def stream_corrected_rain(stream: DataFrame) -> DataFrame:
    """Versioned lag and 3 / 7 row sums per division, days in any order; start it in ``rocksdb_state``.

    Of a day delivered twice in one trigger the least rain counts. Rows without a day are
    left out. A division's new days are one task's: bound a trigger with ``maxFilesPerTrigger``.
    """
    known = stream.select(DIVISION, DATE, RAIN).filter(F.col(DATE).isNotNull())
    return known.groupBy(DIVISION).transformWithStateInPandas(
        _Corrections(), outputStructType=T.StructType.fromDDL(OUTPUT), outputMode="Append", timeMode="None"
    )


def newest_versions(output: DataFrame) -> DataFrame:
    """The newest version of every row given out; days left to the batch operator are not among them."""
    values = F.struct("version", RAIN, *COLUMNS, "kind")
    known = output.filter(F.col("kind") != REDO)
    newest = known.groupBy(*KEY).agg(F.max_by(values, "version").alias("_v"))
    return newest.select(*KEY, "_v.*")


def redo_from_panel(output: DataFrame, panel: DataFrame) -> DataFrame:
    """Batch features of the days marked ``redo`` and the six rows after each; unique keys.

    ``panel`` holds all days delivered. Only divisions with such a day are read into windows.
    """
    marks = output.filter(F.col("kind") == REDO).select(*KEY).distinct().withColumn("_redo", F.lit(1))
    known = [F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in KEY]
    hit = F.col(f"p.{DIVISION}").eqNullSafe(F.col(f"m.{DIVISION}"))
    rows = panel.select(*KEY, RAIN).alias("p")
    rows = rows.join(marks.select(DIVISION).distinct().alias("m"), hit, "left_semi").alias("p")
    marked = rows.join(marks.alias("m"), known[0] & known[1], "left").select("p.*", "_redo")

    def reached(window) -> dict:
        return {"_near": F.max("_redo").over(window.rowsBetween(-(FRAME - 1), 0))}

    done = over_rows(marked, antecedent_rain, reached, back=FRAME - 1)
    return done.filter("_near = 1").select(*KEY, RAIN, *COLUMNS)


def merged_rain(output: DataFrame, panel: DataFrame) -> DataFrame:
    """One row per key: newest versions, with what had to be redone taken from the panel."""
    columns = [*KEY, RAIN, *COLUMNS]
    redone = redo_from_panel(output, panel).withColumn("version", F.lit(1 << 30))
    both = newest_versions(output).select(*columns, "version").unionByName(redone)
    first = Window.partitionBy(*KEY).orderBy(F.col("version").desc())
    return both.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").select(*columns)
