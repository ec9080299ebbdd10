"""Statistical Column expressions: inverse normal CDF, normal CIs, R^2 from D."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal quantile (P. J. Acklam), published
# coefficients; relative error below 1.2e-9 over (0, 1).
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00)
_P_LOW = 0.02425

KAPPA = math.sqrt(8.0 / math.pi)          # rankit scale of Royston & Sauerbrei
LOGISTIC_VAR = math.pi ** 2 / 6.0         # variance of the standard logistic
Z975 = 1.96


def _horner(x: Column, coefs) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def inv_norm(p: Column) -> Column:
    """Normal quantile as a pure Column expression (stays inside codegen)."""
    q_lo = F.sqrt(-2.0 * F.log(p))
    q_hi = F.sqrt(-2.0 * F.log(1.0 - p))
    tail_lo = _horner(q_lo, _C) / (_horner(q_lo, _D) * q_lo + 1.0)
    tail_hi = -_horner(q_hi, _C) / (_horner(q_hi, _D) * q_hi + 1.0)
    q = p - 0.5
    r = q * q
    central = _horner(r, _A) * q / (_horner(r, _B) * r + 1.0)
    return (F.when(p < _P_LOW, tail_lo)
            .when(p > 1.0 - _P_LOW, tail_hi)
            .otherwise(central))


def inv_norm_py(p: float) -> float:
    """Same approximation in plain Python (tests, driver-side arithmetic)."""
    def horner(x, coefs):
        acc = coefs[0]
        for c in coefs[1:]:
            acc = acc * x + c
        return acc
    if p < _P_LOW:
        q = math.sqrt(-2 * math.log(p))
        return horner(q, _C) / (horner(q, _D) * q + 1)
    if p > 1 - _P_LOW:
        q = math.sqrt(-2 * math.log(1 - p))
        return -horner(q, _C) / (horner(q, _D) * q + 1)
    q = p - 0.5
    r = q * q
    return horner(r, _A) * q / (horner(r, _B) * r + 1)


def r2_from_d(d: Column) -> Column:
    """V5: Royston's R^2_D = (D^2/k^2) / (pi^2/6 + D^2/k^2)."""
    s = d * d / (KAPPA * KAPPA)
    return s / (F.lit(LOGISTIC_VAR) + s)


def ci(est: Column, se: Column, z: float = Z975) -> tuple[Column, Column]:
    """V7: normal-approximation limits."""
    return est - z * se, est + z * se
