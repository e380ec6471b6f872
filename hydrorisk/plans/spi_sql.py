"""SQL text of the precipitation index, written from its definition for the checks.

Newton steps of the shape equation run as a recursive CTE; the gamma CDF is a
power series over log-gamma terms.
"""

from __future__ import annotations

# Acklam's rational approximation of the normal quantile: fixed values, good to about 1e-9.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
      -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
      -1.328068155288572e01, 1.0]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
      -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
      3.754408661907416e00, 1.0]


def _horner(coefficients: list[float], x: str) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


def _probit(p: str) -> str:
    """A first guess, then one Newton step against the normal CDF's own power series."""
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    t = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    centre = f"({p} - 0.5) * {_horner(_A, r)} / {_horner(_B, r)}"
    tail = f"sign(0.5 - {p}) * {_horner(_C, t)} / {_horner(_D, t)}"
    guess = f"CASE WHEN abs({p} - 0.5) <= 0.47575 THEN {centre} ELSE {tail} END"
    density = "(exp(-x * x / 2) / sqrt(2 * pi()))"
    series = (
        "list_sum(list_transform(range(90), lambda k: exp((2 * k + 1) * ln(greatest(abs(x), 1e-300))"
        " - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"
    )
    cdf = f"(0.5 + sign(x) * {density} * {series})"
    return f"list_transform([{guess}], lambda x: x - ({cdf} - {p}) / {density})[1]"


def _digamma(x: str) -> str:
    y = f"({x} + 12)"
    return (
        f"(ln{y} - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4)"
        f" - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8)"
        f" - list_sum(list_transform(range(12), lambda i: 1 / ({x} + i))))"
    )


def _trigamma(x: str) -> str:
    y = f"({x} + 12)"
    return (
        f"(1 / {y} + 1 / (2 * {y} ** 2) + 1 / (6 * {y} ** 3) - 1 / (30 * {y} ** 5)"
        f" + 1 / (42 * {y} ** 7) - 1 / (30 * {y} ** 9)"
        f" + list_sum(list_transform(range(12), lambda i: 1 / (({x} + i) ** 2))))"
    )


def fit_sql(source: str, value: str, fit: str) -> str:
    """CTEs ending in ``fit``(division, n, q, alpha, beta) from ``source``(division, value)."""
    return f"""
{fit}_stats AS (
  SELECT division, COUNT({value}) AS n,
         AVG(CASE WHEN {value} = 0 THEN 1.0 WHEN {value} IS NOT NULL THEN 0.0 END) AS q,
         AVG(CASE WHEN {value} > 0 THEN {value} END) AS m,
         ln(AVG(CASE WHEN {value} > 0 THEN {value} END))
           - AVG(CASE WHEN {value} > 0 THEN ln({value}) END) AS s
  FROM {source} GROUP BY division),
{fit}_newton AS (
  SELECT division, s, (3 - s + sqrt((s - 3) ** 2 + 24 * s)) / (12 * s) AS a, 0 AS step
  FROM {fit}_stats WHERE s > 1e-12
  UNION ALL
  SELECT division, s, a - (ln(a) - {_digamma("a")} - s) / (1 / a - {_trigamma("a")}), step + 1
  FROM {fit}_newton WHERE step < 12),
{fit} AS MATERIALIZED (
  SELECT t.division, t.n, t.q, w.a AS alpha, t.m / w.a AS beta
  FROM {fit}_stats t LEFT JOIN {fit}_newton w ON w.division = t.division AND w.step = 12)"""


def score_sql(source: str, value: str, fit: str, scored: str, index: str) -> str:
    """CTEs ending in ``scored``: all of ``source`` plus the unrounded ``index``."""
    # The terms are Poisson weights at alpha + k; twelve deviations past z they vanish.
    z = f"({value} / beta)"
    terms = f"CAST(greatest(1, ceil({z} + 12 * sqrt({z}) + 60 - alpha)) AS BIGINT)"
    cdf = (
        f"CASE WHEN {value} IS NULL OR alpha IS NULL THEN NULL WHEN {value} <= 0 THEN 0.0"
        f" ELSE least(1.0, list_sum(list_transform(range({terms}), lambda k:"
        f" exp((alpha + k) * ln{z} - {z} - lgamma(alpha + k + 1))))) END"
    )
    return f"""
{scored}_mixed AS MATERIALIZED (
  SELECT s.*, greatest(0.0001, least(0.9999, q + (1 - q) * ({cdf}))) AS _p,
         alpha IS NULL OR {value} IS NULL AS _missing
  FROM {source} s LEFT JOIN {fit} f ON f.division = s.division),
{scored} AS MATERIALIZED (
  SELECT * EXCLUDE (_p, _missing),
         CASE WHEN NOT _missing THEN {_probit("_p")} END AS {index}
  FROM {scored}_mixed)"""


def spi_sql(source: str, value: str, scored: str, index: str) -> str:
    """Fit on ``source`` itself and score it."""
    fit = f"{scored}_fit"
    return f"{fit_sql(source, value, fit)},{score_sql(source, value, fit, scored, index)}"


def daily_sql(source: str = "panel", scored: str = "daily") -> str:
    """Daily index rounded to three digits, as column spi."""
    return f"""{spi_sql(source, "rain_sum", f"{scored}_raw", "spi_raw")},
{scored} AS (
  SELECT * EXCLUDE (spi_raw), round_even(spi_raw * 1000, 0) / 1000 AS spi FROM {scored}_raw)"""


def flood_case(spi: str) -> str:
    return (
        f"CASE WHEN {spi} >= 1.6 THEN 'Extreme' WHEN {spi} >= 1.3 THEN 'Severe'"
        f" WHEN {spi} >= 0.8 THEN 'Moderate' ELSE 'Normal' END"
    )


def drought_case(spi: str) -> str:
    return (
        f"CASE WHEN {spi} <= -2 THEN 'Extreme' WHEN {spi} <= -1.5 THEN 'Severe'"
        f" WHEN {spi} <= -1 THEN 'Moderate' ELSE 'Normal' END"
    )


def landslide_case(rain: str, spi: str) -> str:
    return (
        f"CASE WHEN {rain} >= 150 OR {spi} >= 2 THEN 'Extreme'"
        f" WHEN {rain} >= 100 OR {spi} >= 1.5 THEN 'Severe'"
        f" WHEN {rain} >= 75 OR {spi} >= 1 THEN 'Moderate' ELSE 'Normal' END"
    )


def ordinal_case(label: str) -> str:
    return (
        f"CASE {label} WHEN 'Normal' THEN 0 WHEN 'Moderate' THEN 1"
        f" WHEN 'Severe' THEN 2 WHEN 'Extreme' THEN 3 END"
    )
