"""The two Arrow UDFs of the precipitation index, and the small numeric helpers they need.

Spark has no digamma, incomplete gamma or normal quantile; everything else about
the index (grouping, sums, joins) stays in native expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Probabilities are kept inside these limits before the probit.
PROBABILITY_LOW = 0.0001
PROBABILITY_HIGH = 0.9999

# Spread of log-values below which all positive values count as equal (no fit).
DEGENERATE_SPREAD = 1e-12

# Wichura's algorithm AS 241 (PPND16), low order first.
AS241_CENTRE_NUM = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
]
AS241_CENTRE_DEN = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
]
AS241_MIDDLE_NUM = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
AS241_MIDDLE_DEN = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
]


def digamma_trigamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First two derivatives of log-gamma for positive arguments."""
    x = np.asarray(x, dtype=float).copy()
    psi = np.zeros_like(x)
    psi1 = np.zeros_like(x)
    small = x < 12.0
    while small.any():
        psi[small] -= 1.0 / x[small]
        psi1[small] += 1.0 / x[small] ** 2
        x[small] += 1.0
        small = x < 12.0
    r = 1.0 / x
    r2 = r * r
    psi += np.log(x) - r / 2 - r2 * (
        1 / 12 - r2 * (1 / 120 - r2 * (1 / 252 - r2 * (1 / 240 - r2 / 132)))
    )
    psi1 += r + r2 / 2 + r * r2 * (1 / 6 - r2 * (1 / 30 - r2 * (1 / 42 - r2 * (1 / 30 - r2 * 5 / 66))))
    return psi, psi1


def solve_shape(spread: np.ndarray) -> np.ndarray:
    """Gamma shape from log(mean) - mean(log), the maximum-likelihood equation.

    NaN where the spread is missing or vanishes.
    """
    s = np.asarray(spread, dtype=float)
    usable = s > DEGENERATE_SPREAD
    shape = np.full(s.shape, np.nan)
    t = s[usable]
    a = (3 - t + np.sqrt((t - 3) ** 2 + 24 * t)) / (12 * t)
    for _ in range(12):
        psi, psi1 = digamma_trigamma(a)
        step = (np.log(a) - psi - t) / (1 / a - psi1)
        a = np.where(a - step > 0, a - step, a / 2)
    shape[usable] = a
    return shape


# Shapes from here on take the uniform asymptotic form.
UNIFORM_FROM = 1e5


def gamma_cdf(shape: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function; 0 for arguments at or below 0."""
    shape = np.asarray(shape, dtype=float)
    z = np.asarray(z, dtype=float)
    known = np.isfinite(shape) & np.isfinite(z)
    out = np.where(known, 0.0, np.nan)
    inside = known & (z > 0)
    if not inside.any():
        return out
    a, x = shape[inside], z[inside]
    large = a >= UNIFORM_FROM
    if large.any():
        out[np.flatnonzero(inside)[large]] = _uniform(a[large], x[large])
        inside[np.flatnonzero(inside)[large]] = False
        a, x = a[~large], x[~large]
        if not a.size:
            return out
    distinct, where = np.unique(a, return_inverse=True)
    log_gamma = np.array([math.lgamma(v) for v in distinct])[where]
    front = np.exp(a * np.log(x) - x - log_gamma)
    lower = x < a + 1
    value = np.empty_like(x)
    value[lower] = front[lower] * _series(a[lower], x[lower])
    value[~lower] = 1 - front[~lower] * _fraction(a[~lower], x[~lower])
    out[inside] = np.clip(value, 0.0, 1.0)
    return out


def _uniform(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Uniform asymptotic form of the lower function, leading term; errors below 1e-10.

    Series and fraction would take about the square root of the shape in steps.
    """
    mu = (x - a) / a
    eta = np.sign(mu) * np.sqrt(2 * np.maximum(mu - np.log1p(np.maximum(mu, -1 + 1e-16)), 0.0))
    near = np.abs(eta) < 1e-2
    safe = np.where(near, 1.0, eta)
    first = np.where(
        near,
        -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864,
        1 / np.where(near, 1.0, mu) - 1 / safe,
    )
    rest = np.exp(-a * eta**2 / 2) / np.sqrt(2 * np.pi * a) * first
    upper = np.array([math.erfc(v) for v in eta * np.sqrt(a / 2)]) / 2 + rest
    return np.clip(1 - upper, 0.0, 1.0)


def _series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Power series of the lower function; items leave the loop as they converge."""
    total = 1 / a
    todo = np.arange(a.size)
    term = total.copy()
    k = a.copy()
    while todo.size:
        k = k + 1
        term = term * x[todo] / k
        total[todo] += term
        open_ = term > total[todo] * 1e-17
        todo, term, k = todo[open_], term[open_], k[open_]
    return total


def _fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the upper function (modified Lentz)."""
    tiny = 1e-300
    result = np.empty_like(x)
    todo = np.arange(a.size)
    b = x + 1 - a
    c = np.full_like(x, 1 / tiny)
    d = 1 / b
    h = d.copy()
    n = 0
    while todo.size:
        n += 1
        an = -n * (n - a[todo])
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        change = c * d
        h = h * change
        open_ = np.abs(change - 1) > 1e-15
        result[todo[~open_]] = h[~open_]
        todo, b, c, d, h = todo[open_], b[open_], c[open_], d[open_], h[open_]
    return result


def _ratio(num: list[float], den: list[float], r: np.ndarray) -> np.ndarray:
    return np.polyval(num[::-1], r) / np.polyval(den[::-1], r)


def probit(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile for probabilities within the clip limits.

    AS 241 without its far-tail branch, which starts at exp(-25).
    """
    p = np.asarray(p, dtype=float)
    q = p - 0.5
    centre = np.abs(q) <= 0.425
    out = np.full(p.shape, np.nan)
    qc = q[centre]
    out[centre] = qc * _ratio(AS241_CENTRE_NUM, AS241_CENTRE_DEN, 0.180625 - qc * qc)
    outer = ~centre & np.isfinite(p)
    r = np.sqrt(-np.log(np.minimum(p[outer], 1 - p[outer]))) - 1.6
    tail = _ratio(AS241_MIDDLE_NUM, AS241_MIDDLE_DEN, r)
    out[outer] = np.where(q[outer] < 0, -tail, tail)
    return out


def score(x: np.ndarray, q: np.ndarray, shape: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Index value: zero share plus gamma CDF, clipped, as a normal quantile."""
    mixed = q + (1 - q) * gamma_cdf(shape, x / scale)
    return probit(np.clip(mixed, PROBABILITY_LOW, PROBABILITY_HIGH))


@F.pandas_udf(T.DoubleType())
def gamma_shape(spread: pd.Series) -> pd.Series:
    return pd.Series(solve_shape(spread.to_numpy(dtype=float, na_value=np.nan)))


@F.pandas_udf(T.DoubleType())
def spi_score(x: pd.Series, q: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    columns = (s.to_numpy(dtype=float, na_value=np.nan) for s in (x, q, shape, scale))
    return pd.Series(score(*columns))
