"""Train / test splits and folds.

Positional splits cut the (division, date) order at a row number. Only counts
per division, and per day of one division, are sorted; the panel itself is
merely filtered at the row found, so both parts keep pushdown and need no shuffle.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrorisk.operators.windows import positions, running_total
from hydrorisk.schemas import DATE, DIVISION, KEY

# Hex digits of a digest that are ranked together.
PREFIX = 3


@dataclass(frozen=True)
class Cut:
    """Place in the (division, date) order; ``rows`` of that day's ``day_rows`` are before it."""

    division: str
    day: datetime.date
    rows: int
    day_rows: int


def _division_totals(df: DataFrame) -> DataFrame:
    counts = df.filter(F.col(DIVISION).isNotNull()).groupBy(DIVISION).count()
    return running_total(counts, [DIVISION], "count", "upto")


def _first_reaching(totals: DataFrame, rows: int):
    return totals.filter(F.col("upto") >= rows).orderBy("upto").first()


def _find_cut(df: DataFrame, totals: DataFrame, rows: int) -> Cut:
    owner = _first_reaching(totals, rows)
    within = rows - (owner["upto"] - owner["count"])
    days = df.filter(F.col(DIVISION) == owner[DIVISION]).groupBy(DATE).count()
    day = _first_reaching(running_total(days, [DATE], "count", "upto"), within)
    return Cut(owner[DIVISION], day[DATE], within - (day["upto"] - day["count"]), day["count"])


def _cut_at(df: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    division, day = F.col(DIVISION), F.col(DATE)
    on_day = (division == cut.division) & (day == cut.day)
    before = (division < cut.division) | ((division == cut.division) & (day < cut.day))
    # Rows without a key compare to nothing and stay in the second part.
    keyless = division.isNull() | ((division == cut.division) & day.isNull())
    if cut.rows == cut.day_rows:
        before = before | on_day
        return df.filter(before), df.filter(~before | keyless)
    # The cut falls among rows of one (division, day): rank just those, by content.
    ranked = positions(
        df.filter(on_day)
        .withColumn("_digest", F.md5(F.to_json(F.struct(*df.columns))))
        .withColumn("_block", F.substring("_digest", 1, 4)),
        KEY,
        "_block",
        ["_digest"],
        "_nth",
    )
    first = ranked.filter(F.col("_nth") <= cut.rows).select(df.columns)
    rest = ranked.filter(F.col("_nth") > cut.rows).select(df.columns)
    after = ~(before | on_day) | keyless
    return df.filter(before).unionByName(first), df.filter(after).unionByName(rest)


def _split_after(df: DataFrame, rows: int, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    if rows <= 0:
        return df.filter(F.lit(False)), df
    return _cut_at(df, _find_cut(df, totals, rows))


def _rows_in(totals: DataFrame) -> int:
    return totals.agg(F.max("upto")).first()[0] or 0


def split_tail(df: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """The last ``rows`` rows of the (division, date) order are the second part.

    This holds out whole divisions, late in name order, not recent time.
    """
    if rows <= 0:
        raise ValueError("rows must be positive")
    totals = _division_totals(df)
    return _split_after(df, _rows_in(totals) - rows, totals)


def split_fraction(df: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The first ``int(share x rows)`` rows of the (division, date) order, and the rest."""
    totals = _division_totals(df)
    return _split_after(df, int(_rows_in(totals) * share), totals)


def split_temporal(
    df: DataFrame, validate_from: str, test_from: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train before ``validate_from``, validate before ``test_from``, test from there on."""
    day = F.col(DATE)
    first, second = (F.lit(d).cast("date") for d in (validate_from, test_from))
    return (
        df.filter(day < first),
        df.filter((day >= first) & (day < second)),
        df.filter(day >= second),
    )


def stratified_folds(
    df: DataFrame, target: str, folds: int = 3, seed: int = 42, keys: list[str] = KEY
) -> DataFrame:
    """Add ``fold``: a seeded shuffle inside each class, dealt out in turn.

    Fold sizes of a class differ by at most one; rows without a class are a class. The
    shuffle order is a digest of the row key; ranking runs per ``PREFIX`` hex digits of
    it, so a class that holds most rows is ranked by many tasks.
    """
    digest = F.md5(F.concat_ws("|", *keys, F.lit(str(seed))))
    block = F.substring(digest, 1, PREFIX)
    dealt = positions(
        df.withColumn("_digest", F.unhex(digest)).withColumn("_block", block),
        [target],
        "_block",
        ["_digest", *keys],
        "_nth",
    )
    fold = ((F.col("_nth") - 1) % folds).cast("int")
    return dealt.withColumn("fold", fold).drop("_digest", "_block", "_nth")
