"""Assembling the division x date panel and attaching dimensions to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrorisk.functions.scalars import month_cyclic, month_start, row_mean
from hydrorisk.operators.windows import antecedent_rain, over_rows, running_total
from hydrorisk.schemas import DATE, DIVISION, KEY, MEASURES, SOIL
from hydrorisk.session import settle


def assemble_panel(rain: DataFrame, temperature: DataFrame, soil: DataFrame) -> DataFrame:
    """Chained full outer join on (date, division); repeated keys multiply.

    The keys are spread by division and day, so a large division is spread too.
    """
    joined = rain.join(temperature, KEY, "full").join(soil, KEY, "full")
    return joined.select(DATE, DIVISION, *[c for c in joined.columns if c not in KEY])


def assemble_unique_panel(*sources: DataFrame) -> DataFrame:
    """The same panel with one shuffle, for sources whose (date, division) is unique.

    Each source is padded with typed NULLs and the union is grouped once. The same
    aggregation counts the rows of each source per key: a repeated key raises an
    error instead of losing a row.
    """
    measures = [(c, t) for s in sources for c, t in s.dtypes if c not in KEY]
    padded = [
        s.select(
            *KEY,
            *[F.col(c) if c in s.columns else F.lit(None).cast(t).alias(c) for c, t in measures],
            *[F.lit(int(i == n)).alias(f"_source_{n}") for n in range(len(sources))],
        )
        for i, s in enumerate(sources)
    ]
    stacked = padded[0]
    for more in padded[1:]:
        stacked = stacked.unionByName(more)
    most = F.greatest(*[F.sum(f"_source_{n}") for n in range(len(sources))], F.lit(0))
    grouped = stacked.groupBy(*KEY).agg(
        *[F.max(c).alias(c) for c, _ in measures], most.alias("_rows")
    )
    repeated = F.concat(
        F.lit("repeated key in a source: "),
        F.coalesce(F.col(DATE).cast("string"), F.lit("no date")),
        F.lit(", "),
        F.coalesce(F.col(DIVISION).cast("string"), F.lit("no division")),
    )
    checked = F.when(F.col("_rows") > 1, F.raise_error(repeated)).otherwise(F.col(DATE))
    return grouped.select(
        checked.cast(dict(sources[0].dtypes)[DATE]).alias(DATE), DIVISION, *[c for c, _ in measures]
    )


def with_backfill(rain: DataFrame, history: DataFrame) -> DataFrame:
    """Rain with an earlier stretch put in front, one row per (division, date).

    Where both have a day, the regular series wins.
    """
    ranked = rain.withColumn("_source", F.lit(0)).unionByName(
        history.withColumn("_source", F.lit(1))
    )
    others = [c for c in rain.columns if c not in KEY]
    return (
        ranked.groupBy(*KEY)
        .agg(F.min_by(F.struct(*others), F.struct("_source", *others)).alias("_row"))
        .select(*[F.col(c) if c in KEY else F.col(f"_row.{c}").alias(c) for c in rain.columns])
    )


def panel_features(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Lag, short rolling sums and seasonal encoding."""
    return month_cyclic(over_rows(df, antecedent_rain, back=6, rows_per_task=rows_per_task))


def monthly_means(df: DataFrame) -> DataFrame:
    """Mean of every measure by division and month, and the soil average over depths."""
    means = df.groupBy(DIVISION, month_start(DATE).alias("year_month")).agg(
        *[F.avg(m).alias(m) for m in MEASURES]
    )
    return means.withColumn("soil_moisture_avg", row_mean(SOIL))


def distinct_divisions(df: DataFrame) -> DataFrame:
    return df.select(DIVISION).distinct().orderBy(DIVISION)


def fit_division_encoder(df: DataFrame) -> DataFrame:
    """division → 0-based code in name order, as a stored table of known size."""
    names = df.select(DIVISION).distinct().filter(F.col(DIVISION).isNotNull())
    coded = running_total(names.withColumn("_one", F.lit(1)), [DIVISION], "_one", "_nth")
    codes = coded.select(DIVISION, (F.col("_nth") - 1).cast("int").alias("division_encoded"))
    return settle(codes, "encoder")


def known_divisions(df: DataFrame, encoder: DataFrame) -> DataFrame:
    """Rows of divisions the encoder knows."""
    return df.join(encoder.select(DIVISION), DIVISION, "left_semi")


def encode_division(df: DataFrame, encoder: DataFrame) -> DataFrame:
    """Attach the integer code; rows of unknown divisions are left out."""
    coded = df.join(encoder.select(DIVISION, "division_encoded"), DIVISION)
    return coded.select(*df.columns, "division_encoded")


def with_registry(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach district and province."""
    places = registry.select(F.col("id").alias(DIVISION), "district", "province")
    return df.join(places, DIVISION).select(*df.columns, "district", "province")


def balanced_weights(df: DataFrame, target: str) -> DataFrame:
    """weight(class) = rows / (classes present x rows of the class)."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(
        F.count(F.lit(1)).alias("class_rows")
    )
    everything = Window.partitionBy()
    return counts.select(
        target,
        "class_rows",
        (
            F.sum("class_rows").over(everything)
            / (F.count(F.lit(1)).over(everything) * F.col("class_rows"))
        ).alias("class_weight"),
    )


def with_class_weight(df: DataFrame, weights: DataFrame, target: str) -> DataFrame:
    """Attach each row's class weight; rows of a class without one are left out."""
    weighted = df.join(weights.select(target, "class_weight"), target)
    return weighted.select(*df.columns, "class_weight")
