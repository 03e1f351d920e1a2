"""Normal distribution as column expressions (Spark has no erf)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import col

# Coefficients of the published rational approximations.
# Upper tail: Abramowitz and Stegun 26.2.17. Quantile: P. J. Acklam's approximation.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
TAIL_P = 0.2316419
A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
     -3.066479806614716e+01, 2.506628277459239e+00)
B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
     -1.328068155288572e+01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
     4.374664141464968e+00, 2.938163982698783e+00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
LOW = 0.02425
EULER_GAMMA = 0.5772156649015329
E_CONST = 2.718281828459045


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(z) -> Column:
    """P(Z <= z), absolute error below 7.5e-8."""
    z = col(z)
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(TAIL_P) * F.abs(z))
    tail = F.exp(-z * z / 2.0) / F.lit(2.5066282746310002) * k * _poly(tuple(reversed(TAIL)), k)
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)


def normal_ppf(p) -> Column:
    """Quantile, relative error below 1.2e-9."""
    p = col(p)
    q = p - F.lit(0.5)
    r = q * q
    mid = _poly(A, r) * q / _poly(B + (1.0,), r)
    t_lo = F.sqrt(F.lit(-2.0) * F.ln(p))
    t_hi = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    lo = _poly(C, t_lo) / _poly(D + (1.0,), t_lo)
    hi = -_poly(C, t_hi) / _poly(D + (1.0,), t_hi)
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double")).when(p < LOW, lo)
            .when(p > 1 - LOW, hi).otherwise(mid))


def expected_best(n, var) -> Column:
    """Expected largest per-period Sharpe of n skill-less trials whose Sharpe ratios have variance `var`."""
    n, var = col(n).cast("double"), col(var)
    z1 = normal_ppf(F.lit(1.0) - F.lit(1.0) / n)
    z2 = normal_ppf(F.lit(1.0) - F.lit(1.0) / (n * F.lit(E_CONST)))
    best = F.sqrt(var) * (F.lit(1.0 - EULER_GAMMA) * z1 + F.lit(EULER_GAMMA) * z2)
    return F.when(n < 2, F.lit(0.0)).otherwise(best)
