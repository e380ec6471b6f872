"""Severity rules. The first matching rule wins; unmatched or missing is Normal.

All thresholds in this file are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrorisk.schemas import RAIN, SOIL


def flood_severity(spi: Column) -> Column:
    return (
        F.when(spi >= 1.6, "Extreme")
        .when(spi >= 1.3, "Severe")
        .when(spi >= 0.8, "Moderate")
        .otherwise("Normal")
    )


def drought_severity(spi: Column) -> Column:
    return (
        F.when(spi <= -2.0, "Extreme")
        .when(spi <= -1.5, "Severe")
        .when(spi <= -1.0, "Moderate")
        .otherwise("Normal")
    )


def landslide_severity(rain: Column, spi: Column) -> Column:
    return (
        F.when((rain >= 150) | (spi >= 2.0), "Extreme")
        .when((rain >= 100) | (spi >= 1.5), "Severe")
        .when((rain >= 75) | (spi >= 1.0), "Moderate")
        .otherwise("Normal")
    )


def label_all(df: DataFrame, spi: str = "spi") -> DataFrame:
    """The three hazard labels in one pass."""
    index = F.col(spi)
    return df.withColumns(
        {
            "flood_severity": flood_severity(index),
            "drought_severity": drought_severity(index),
            "landslide_severity": landslide_severity(F.col(RAIN), index),
        }
    )


def hazard_datasets(df: DataFrame, spi: str = "spi") -> dict[str, DataFrame]:
    """One labelled data set per hazard, each carrying only its own label."""
    base = df.drop("flood_severity")
    index = F.col(spi)
    return {
        "flood": base.withColumn("flood_severity", flood_severity(index)),
        "drought": base.withColumn("drought_severity", drought_severity(index)),
        "landslide": base.withColumn(
            "landslide_severity", landslide_severity(F.col(RAIN), index)
        ),
    }


def _graded(extreme: Column, severe: Column, moderate: Column) -> Column:
    return (
        F.when(extreme, "Extreme")
        .when(severe, "Severe")
        .when(moderate, "Moderate")
        .otherwise("Normal")
    )


def flood_rule_v0(df: DataFrame) -> DataFrame:
    """Planned first rule set: antecedent rain with shallow soil saturation."""
    week, day, soil = F.col("rain_rolling_7d"), F.col(RAIN), F.col(SOIL[0])
    return df.withColumn(
        "flood_label_v0",
        _graded(
            (week > 300) | ((week > 200) & (soil > 0.45)),
            (week > 150) | ((week > 100) & (soil > 0.40)),
            (week > 70) | (day > 50),
        ),
    )


def drought_rule_v0(df: DataFrame) -> DataFrame:
    """Planned first rule set: agreement of the 30 and 90 day indices."""
    short, long = F.col("spi_30d"), F.col("spi_90d")
    return df.withColumn(
        "drought_label_v0",
        _graded(
            (short < -2.0) & (long < -1.5),
            (short < -1.5) | (long < -1.5),
            (short < -1.0) | (long < -1.0),
        ),
    )


def landslide_rule_v0(df: DataFrame) -> DataFrame:
    """Planned first rule set: rain intensity with mid-depth soil saturation."""
    day, three, soil = F.col(RAIN), F.col("rain_rolling_3d"), F.col(SOIL[1])
    return df.withColumn(
        "landslide_label_v0",
        _graded(
            (day > 100) & (soil > 0.45),
            ((day > 60) & (soil > 0.38)) | (three > 150),
            (day > 30) | (three > 80),
        ),
    )
