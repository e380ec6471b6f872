"""Column expressions: dates, rounding, missing values, small text helpers.

A missing value is NULL everywhere. NaN sorts above every number in Spark, so a
NaN reaching a threshold rule would count as extreme; readers and UDF outputs
turn it into NULL with :func:`no_nan`.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrorisk.schemas import DATE, DIVISION, SEVERITIES


def no_nan(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def local_day(col: Column | str) -> Column:
    """Day of a local ISO timestamp text, without any time-zone shift."""
    return F.to_date(F.substring(F.col(col) if isinstance(col, str) else col, 1, 10))


def month_start(col: Column | str) -> Column:
    return F.trunc(col, "month")


def month_cyclic(df: DataFrame, date: str = DATE) -> DataFrame:
    """Month of the year on the unit circle, so that December and January meet."""
    angle = F.month(date) * F.lit(2 * math.pi) / F.lit(12)
    return df.withColumns({"month_sin": F.sin(angle), "month_cos": F.cos(angle)})


def since(df: DataFrame, first_day: str, date: str = DATE) -> DataFrame:
    return df.filter(F.col(date) >= F.lit(first_day).cast("date"))


def round_half_even(col: Column, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back (array-library rounding)."""
    scale = float(10**digits)
    return F.rint(col * scale) / scale


def round_frame(df: DataFrame, digits: int = 3) -> DataFrame:
    """Round every floating-point column."""
    rounded = {
        f.name: round_half_even(F.col(f.name), digits)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(rounded) if rounded else df


def round_decimal(col: Column, digits: int) -> Column:
    """Round the decimal reading of a value, ties to even (scalar rounding of reports)."""
    return F.bround(col, digits)


def drop_missing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def severity_ordinal(col: Column) -> Column:
    """Normal 0 … Extreme 3; any other text is missing."""
    ordinal = F.when(col == SEVERITIES[0], 0)
    for rank, name in enumerate(SEVERITIES[1:], start=1):
        ordinal = ordinal.when(col == name, rank)
    return ordinal


def severity_name(col: Column) -> Column:
    """Inverse of :func:`severity_ordinal`."""
    return F.try_element_at(F.array(*map(F.lit, SEVERITIES)), (col + 1).cast("int"))


def row_mean(columns: Iterable[str]) -> Column:
    """Mean across columns, skipping missing ones; missing if all are."""
    cols = [F.col(c) for c in columns]
    total, present = F.lit(0.0), F.lit(0)
    for c in cols:
        total = total + F.coalesce(c, F.lit(0.0))
        present = present + c.isNotNull().cast("int")
    return F.try_divide(total, present)


def clip(col: Column, low: float, high: float) -> Column:
    return F.when(col.isNotNull(), F.greatest(F.least(col, F.lit(high)), F.lit(low)))


def safe_double(col: Column | str) -> Column:
    """Text to double; anything unreadable, and NaN, is missing."""
    return no_nan((F.col(col) if isinstance(col, str) else col).try_cast("double"))


def of_division(df: DataFrame, division: str) -> DataFrame:
    return df.filter(F.col(DIVISION) == division)


def by_district(registry: DataFrame, name: str) -> DataFrame:
    return registry.filter(F.lower("district") == name.lower())


def by_province(registry: DataFrame, name: str) -> DataFrame:
    return registry.filter(F.lower("province") == name.lower())


# White space of any script, and the separator control characters.
SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def name_tokens(df: DataFrame, text: str) -> DataFrame:
    """Distinct names of a free-text list split at commas and line ends.

    Blank entries, picture captions (``Image…``) and ``Total`` lines are left out.
    """
    return (
        df.select(F.explode(F.split(text, ",+|\n")).alias("token"))
        .select(F.btrim("token", F.lit(SPACE)).alias("name"))
        .filter((F.col("name") != "") & ~F.col("name").startswith("Image"))
        .filter(~F.col("name").contains("Total"))
        .distinct()
    )
