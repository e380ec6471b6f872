"""Column names and schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

DIVISION = "division"
DATE = "date"
KEY = [DIVISION, DATE]

# Fixed column names of the measurement tables, in file order.
RAIN = "rain_sum"
TEMPERATURE = "temperature_2m_mean"
SOIL = ["soil_moisture_7_to_28cm", "soil_moisture_28_to_100cm", "soil_moisture_100_to_255cm"]
MEASURES = [RAIN, TEMPERATURE, *SOIL]

# Fixed feature order expected by the forecasting models.
FEATURES = [
    "rain_sum",
    "temperature_2m_mean",
    "soil_moisture_7_to_28cm",
    "soil_moisture_28_to_100cm",
    "soil_moisture_100_to_255cm",
    "rain_lag_1",
    "rain_rolling_3d",
    "rain_rolling_7d",
    "month_sin",
    "month_cos",
    "spi",
    "division_encoded",
]

HORIZONS = [1, 2, 3]
TARGETS = [f"target_day{h}" for h in HORIZONS]
PREDICTIONS = [f"predicted_day{h}" for h in HORIZONS]

# Fixed ordinal scale, mildest first.
SEVERITIES = ["Normal", "Moderate", "Severe", "Extreme"]

REGISTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("district", T.StringType()),
        T.StructField("province", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ]
)

MANIFEST = T.StructType(
    [T.StructField("task", T.StringType()), T.StructField(DIVISION, T.StringType())]
)


def measurement_schema(measures: list[str]) -> T.StructType:
    """date, division, then one double per measure."""
    return T.StructType(
        [T.StructField(DATE, T.DateType()), T.StructField(DIVISION, T.StringType())]
        + [T.StructField(m, T.DoubleType()) for m in measures]
    )


def document_schema(block: str, measures: list[str]) -> T.StructType:
    """One landed document: a block of parallel arrays for one division."""
    arrays = [T.StructField("time", T.ArrayType(T.StringType()))] + [
        T.StructField(m, T.ArrayType(T.DoubleType())) for m in measures
    ]
    return T.StructType(
        [T.StructField(DIVISION, T.StringType()), T.StructField(block, T.StructType(arrays))]
    )
