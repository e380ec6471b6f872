import math
import time
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrorisk.functions import gamma
from hydrorisk.operators import spi
from tests.conftest import sorted_pandas, to_spark

SCHEMA = "date date, division string, rain_sum double"


def test_shape_solves_the_likelihood_equation():
    spread = np.array([1e-9, 1e-6, 0.001, 0.02, 0.3, 0.7, 1.5, 4.0, 20.0])
    a = gamma.solve_shape(spread)
    psi, _ = gamma.digamma_trigamma(a)
    ok = spread >= 1e-6
    assert np.all(np.abs(np.log(a) - psi - spread)[ok] < 1e-12 * np.maximum(1, np.abs(psi[ok])))
    assert np.all(np.isnan(gamma.solve_shape(np.array([0.0, -1.0, np.nan, 1e-13]))))


def test_digamma_is_derivative_of_log_gamma():
    for x in (0.01, 0.5, 1.0, 3.7, 25.0):
        h = 1e-5 * max(x, 0.1)
        slope = (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)
        psi, psi1 = gamma.digamma_trigamma(np.array([x]))
        assert psi[0] == pytest.approx(slope, rel=1e-6)
        up, down = gamma.digamma_trigamma(np.array([x + h]))[0], gamma.digamma_trigamma(np.array([x - h]))[0]
        assert psi1[0] == pytest.approx((up[0] - down[0]) / (2 * h), rel=1e-5)


@pytest.mark.parametrize("a", [0.3, 1.0, 2.5, 17.0, 250.0, 20_000.0])
def test_cdf_against_numeric_integration(a):
    # For small shapes, substituting u = t^a removes the pole at 0.
    for x in (0.05 * a, 0.5 * a, a, 1.01 * a + 1, 2 * a + 3):
        u = np.linspace(1e-12, 1, 400_001)
        if a < 1:
            y = np.exp(-x * u ** (1 / a) + a * math.log(x) - math.log(a) - math.lgamma(a))
        else:
            t = x * u
            y = np.exp((a - 1) * np.log(t) - t - math.lgamma(a) + math.log(x))
        integral = np.sum((y[1:] + y[:-1]) / 2) * (u[1] - u[0])
        got = gamma.gamma_cdf(np.array([a]), np.array([x]))[0]
        assert got == pytest.approx(integral, abs=1e-8)


def test_cdf_edges():
    a = np.array([2.0, 2.0, 2.0, np.nan, 2.0])
    z = np.array([0.0, -3.0, 1e4, 1.0, np.nan])
    assert gamma.gamma_cdf(a, z)[:3].tolist() == [0.0, 0.0, 1.0]
    assert np.isnan(gamma.gamma_cdf(a, z)[3:]).all()
    # shape 1 is the exponential distribution
    x = np.linspace(0.01, 30, 500)
    np.testing.assert_allclose(gamma.gamma_cdf(np.ones(500), x), 1 - np.exp(-x), rtol=1e-13)


def test_cdf_is_monotone_across_both_branches():
    for a in (0.5, 3.0, 80.0, 5000.0):
        x = np.linspace(0.5 * a, 1.5 * a + 2, 2000)
        values = gamma.gamma_cdf(np.full(2000, a), x)
        assert np.all(np.diff(values) >= -1e-15)


def test_probit_matches_standard_library():
    p = np.concatenate([np.linspace(0.0001, 0.9999, 4001), [0.075, 0.925]])
    expected = [NormalDist().inv_cdf(v) for v in p]
    np.testing.assert_allclose(gamma.probit(p), expected, rtol=1e-13, atol=1e-15)
    assert np.isnan(gamma.probit(np.array([np.nan]))).all()


def brute_force(values):
    """Index of one series by a plain search of the likelihood, independent of the solver."""
    x = np.array([v for v in values if not np.isnan(v)])
    positive = x[x > 0]
    out = np.full(len(values), np.nan)
    if not len(positive):
        return out
    s = math.log(positive.mean()) - np.log(positive).mean()
    low, high = 1e-3, 1e6
    for _ in range(200):
        mid = math.sqrt(low * high)
        psi, _ = gamma.digamma_trigamma(np.array([mid]))
        low, high = (mid, high) if math.log(mid) - psi[0] > s else (low, mid)
    beta = positive.mean() / low
    q = (x == 0).mean()
    mixed = q + (1 - q) * gamma.gamma_cdf(np.full(len(x), low), np.maximum(x, 0) / beta)
    out[~np.isnan(values)] = [NormalDist().inv_cdf(min(max(h, 1e-4), 0.9999)) for h in mixed]
    return out


def test_daily_index_matches_brute_force(panel, panel_df):
    got = sorted_pandas(spi.spi_daily(panel_df))
    frame = panel.sort_values(["division", "date"]).reset_index(drop=True)
    for division, part in frame.groupby("division"):
        mine = got.loc[got["division"] == division, "spi"].to_numpy(dtype=float)
        if len(part) == 1:
            assert np.isnan(mine).all()
            continue
        np.testing.assert_allclose(mine, np.round(brute_force(part["rain_sum"].to_numpy()), 3), atol=1.01e-3)
        assert np.nanmax(np.abs(mine - brute_force(part["rain_sum"].to_numpy()))) < 6e-4


def series(spark, name, values):
    days = pd.date_range("2001-01-01", periods=len(values)).date
    frame = pd.DataFrame({"date": days, "division": name, "rain_sum": values})
    return to_spark(spark, frame, SCHEMA)


def test_degenerate_series(spark):
    df = series(spark, "dry", [0.0] * 5).unionByName(series(spark, "same", [2.5] * 5))
    df = df.unionByName(series(spark, "none", [np.nan] * 3))
    assert spi.spi_daily(df).filter("spi IS NOT NULL").count() == 0
    params = {r["division"]: r for r in spi.fit_spi(df, ["rain_sum"]).collect()}
    assert params["dry"]["rain_sum_q"] == 1.0 and params["dry"]["rain_sum_alpha"] is None
    assert params["same"]["rain_sum_q"] == 0.0 and params["same"]["rain_sum_beta"] is None
    assert params["none"]["rain_sum_n"] == 0


def test_dry_day_floor_missing_and_bounds(spark):
    values = [0.0, 0.0, 1.0, 5.0, np.nan, 30.0, 1e6, -1.0]
    rows = spi.spi_daily(series(spark, "d", values)).orderBy("date").collect()
    scores = [r["spi"] for r in rows]
    # two exact zeros among seven present values; a negative value gets the same floor
    assert scores[0] == pytest.approx(NormalDist().inv_cdf(2 / 7), abs=5e-4)
    assert scores[7] == scores[0]
    assert scores[4] is None
    present = [s for s in scores if s is not None]
    assert max(map(abs, present)) <= 3.72
    assert scores[2] < scores[3] < scores[5] < scores[6]


def test_nan_counts_as_missing(spark):
    df = series(spark, "d", [0.0, 1.0, 4.0, 2.0]).withColumn(
        "rain_sum", F.when(F.col("rain_sum") == 4.0, float("nan")).otherwise(F.col("rain_sum"))
    )
    rows = spi.spi_daily(df).orderBy("date").collect()
    assert rows[2]["spi"] is None
    assert rows[0]["spi"] == pytest.approx(NormalDist().inv_cdf(1 / 3), abs=5e-4)


def test_window_index_and_stored_parameters(panel, panel_df):
    got = sorted_pandas(spi.spi_window(panel_df))
    assert list(got.columns) == [*panel.columns, "spi_30d", "spi_90d", "spi_180d"]
    frame = panel.sort_values(["division", "date"]).reset_index(drop=True)
    for n in (30, 90, 180):
        sums = frame.groupby("division")["rain_sum"].transform(
            lambda s, n=n: s.rolling(n, min_periods=n).sum()
        )
        # the panel has 5 % missing values, so most full windows are missing
        assert got[f"spi_{n}d"].notna().sum() == sums[frame["division"] != "div 0"].notna().sum()
        for division, part in sums.groupby(frame["division"]):
            if part.notna().sum() > 1:
                mine = got.loc[got["division"] == division, f"spi_{n}d"].to_numpy(dtype=float)
                np.testing.assert_allclose(mine, brute_force(part.to_numpy()), atol=1e-6)
    params = spi.fit_spi(panel_df, ["rain_sum"])
    scored = sorted_pandas(spi.spi_against_baseline(panel_df, params))
    daily = sorted_pandas(spi.spi_daily(panel_df))
    np.testing.assert_allclose(scored["spi"].astype(float), daily["spi"].astype(float), atol=5.1e-4)


def test_cdf_of_large_shapes_is_fast_and_right():


    rng = np.random.default_rng(1)
    for shape in (1e5, 3e5):
        x = shape + np.sqrt(shape) * rng.normal(size=200) * 2
        a = np.full(200, shape)
        exact = 1 - np.exp(a * np.log(x) - x - math.lgamma(shape)) * gamma._fraction(a, x)
        low = x < a + 1
        front = np.exp(a[low] * np.log(x[low]) - x[low] - math.lgamma(shape))
        exact[low] = front * gamma._series(a[low], x[low])
        np.testing.assert_allclose(gamma.gamma_cdf(a, x), exact, atol=2e-9)
    for shape in (1e9, 5e11):
        z = np.linspace(-4, 4, 2000)
        # Wilson and Hilferty's cube is exact to 1 / shape here.
        x = shape * (1 - 1 / (9 * shape) + z / (3 * np.sqrt(shape))) ** 3
        start = time.perf_counter()
        got = gamma.gamma_cdf(np.full(2000, shape), x)
        assert time.perf_counter() - start < 0.1
        normal = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
        np.testing.assert_allclose(got, normal, atol=1e-6)
