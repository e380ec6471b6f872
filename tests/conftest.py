import datetime

import numpy as np
import pandas as pd
import pytest

from hydrorisk.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "hydrorisk-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def random_panel(seed=0, divisions=6, days=400, missing=0.05, gaps=0.1, dry=0.4):
    """Daily rain with missing values, missing dates, a one-row division and one hot division."""
    rng = np.random.default_rng(seed)
    parts = []
    for d in range(divisions):
        n = 1 if d == 0 else days * (5 if d == 1 else 1)
        start = datetime.date(1990, 1, 1)
        part = pd.DataFrame({"date": pd.date_range(start, periods=n), "division": f"div {d}"})
        part["rain_sum"] = np.where(
            rng.random(n) < dry, 0.0, np.round(rng.gamma(0.8, 12.0, n), 2)
        )
        part.loc[rng.random(n) < missing, "rain_sum"] = np.nan
        parts.append(part[rng.random(n) >= gaps] if n > 1 else part)
    frame = pd.concat(parts, ignore_index=True)
    frame["date"] = frame["date"].dt.date
    return frame


def to_spark(spark, frame, schema):
    """Rows of a pandas frame with NaN as NULL."""
    rows = [
        tuple(None if isinstance(v, float) and np.isnan(v) else v for v in row)
        for row in frame.itertuples(index=False)
    ]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def panel():
    return random_panel()


@pytest.fixture(scope="session")
def panel_df(spark, panel):
    from hydrorisk.session import settle

    return settle(to_spark(spark, panel, "date date, division string, rain_sum double"))


def sorted_pandas(df, keys=("division", "date")):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)
