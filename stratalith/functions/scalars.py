"""Scalar column functions: rescaling, penalties, cutoffs, distributions. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TINY = 1e-16


def d(x) -> Column:
    """A double column from a column, a column name or a number."""
    return (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)).cast("double")


def standardize(x, over: WindowSpec | None = None) -> Column:
    """(x - mean) / population std over a window; a zero std counts as 0.01."""
    over = over or Window.partitionBy()
    std = F.stddev_pop(d(x)).over(over)
    return (d(x) - F.avg(d(x)).over(over)) / F.when(std == 0, 0.01).otherwise(std)


def normalize(x, over: WindowSpec | None = None) -> Column:
    """(x - min) / (max - min) over a window; null where all are equal."""
    over = over or Window.partitionBy()
    lo = F.min(d(x)).over(over)
    return F.try_divide(d(x) - lo, F.max(d(x)).over(over) - lo)


def softmax(x, over: WindowSpec, temperature: float = 1.0) -> Column:
    z = F.exp((d(x) - F.max(d(x)).over(over)) / temperature)
    return z / (F.sum(z).over(over) + TINY)


def signed_log(x) -> Column:
    return F.signum(d(x)) * F.log1p(F.abs(d(x)))


def log_rescale_positive(x, cutoff: float = 0.0) -> Column:
    return F.when(d(x) > cutoff, cutoff + F.log1p(F.greatest(d(x) - cutoff, F.lit(0.0)))).otherwise(d(x))


def softplus_shift(x, floor: float = 0.01, beta: float = 10.0) -> Column:
    """Softplus above ``floor``; linear where it would overflow."""
    z = beta * (d(x) - floor)
    return F.when(z > 30, d(x)).otherwise(F.log1p(F.exp(F.least(z, F.lit(30.0)))) / beta + floor)


def invert_softplus_shift(y, floor: float = 0.01, beta: float = 10.0) -> Column:
    z = beta * (d(y) - floor)
    return F.when(z > 30, d(y)).otherwise(F.log(F.greatest(F.expm1(F.least(z, F.lit(30.0))), F.lit(1e-12))) / beta + floor)


def scale_repulsion(y, beta: float = 1.0) -> Column:
    """Positive energies grow as a logarithm."""
    return F.when(d(y) > 0, beta * F.log1p(F.greatest(d(y), F.lit(0.0)) / beta)).otherwise(d(y))


def smooth_constraint(x, bound: float, mode: str = "less than", hardness: float = 10.0) -> Column:
    """Square of a softplus of how far ``x`` is beyond ``bound``."""
    over = (d(x) - bound) if mode == "less than" else (bound - d(x))
    z = hardness * over
    soft = F.when(z > 30, over).otherwise(F.log1p(F.exp(F.least(z, F.lit(30.0)))) / hardness)
    return soft * soft


def logit(x) -> Column:
    return F.log(d(x) / (1 - d(x)))


def sigmoid_shift(x, low: float, high: float) -> Column:
    return low + (high - low) / (1 + F.exp(-d(x)))


def inverse_sigmoid_shift(y, low: float, high: float) -> Column:
    return logit((d(y) - low) / (high - low))


#: Abramowitz and Stegun 7.1.26, absolute error under 1.5e-7.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def erf(x) -> Column:
    t = 1 / (1 + ERF_P * F.abs(d(x)))
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return F.signum(d(x)) * (1 - poly * F.exp(-d(x) * d(x)))


def normal_to_uniform(x) -> Column:
    return 0.5 * (1 + erf(d(x) / math.sqrt(2)))


#: Abramowitz and Stegun 26.2.23, absolute error under 4.5e-4.
PROBIT_TAIL = 0.02425
PROBIT_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PROBIT_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def polynomial(x, coefficients: tuple[float, ...]) -> Column:
    """By Horner's rule, the highest power's coefficient first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def uniform_to_normal(u, eps: float = 1e-5) -> Column:
    """Inverse of the normal distribution function, clipped to [eps, 1 - eps]; relative error about 1e-9."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), d(u)))
    q = p - 0.5
    middle = q * polynomial(q * q, PROBIT_A) / polynomial(q * q, (*PROBIT_B, 1.0))
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = polynomial(t, PROBIT_C) / polynomial(t, (*PROBIT_D, 1.0))
    return F.when(F.abs(q) <= 0.5 - PROBIT_TAIL, middle).when(q < 0, tail).otherwise(-tail)


def enforce_bound(x, centre: float, span: float, mode: str = "soft") -> Column:
    """Within centre +- span, by tanh (soft) or by clipping (hard)."""
    z = (d(x) - centre) / span
    return (F.tanh(z) if mode == "soft" else F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))) * span + centre


def undo_bound(y, centre: float, span: float) -> Column:
    z = (d(y) - centre) / span
    return 0.5 * F.log((1 + z) / (1 - z)) * span + centre


def log_odds(p0, p1) -> Column:
    return F.log10(d(p1) / d(p0))


def smooth_cutoff(dist, cutoff: float, onset: float) -> Column:
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d(dist) - onset) / (cutoff - onset)))
    return F.when(d(dist) > cutoff, 0.0).otherwise(0.5 * (1 + F.cos(math.pi * x)))


def relu(x) -> Column:
    return F.greatest(d(x), F.lit(0.0))


def bounding_penalty(x, low: float, high: float, margin: float = 0.0) -> Column:
    above, below = relu(d(x) - (high - margin)), relu((low + margin) - d(x))
    return above * above + below * below


def finite(x) -> Column:
    """NaN to 0, infinity to 1e20, minus infinity to -1e-20 (the small constant is kept on purpose)."""
    return F.when(F.isnan(d(x)), 0.0).when(d(x) == float("inf"), 1e20).when(d(x) == float("-inf"), -1e-20).otherwise(d(x))


def triangular_right(u, low, high) -> Column:
    """Inverse distribution function of the triangle that rises to ``high``."""
    return d(low) + (d(high) - d(low)) * F.sqrt(d(u))


def silu(x) -> Column:
    return d(x) / (1 + F.exp(-d(x)))


def pair_index(i, j, n: int) -> Column:
    """Index of an unordered pair among n types; -1 if a type isn't listed (null or negative)."""
    a, b = F.least(i, j), F.greatest(i, j)
    bad = F.coalesce(a, F.lit(-1)) < 0
    bad = bad | (F.coalesce(i, F.lit(-1)) < 0) | (F.coalesce(j, F.lit(-1)) < 0)
    return F.when(bad, F.lit(-1).cast("long")).otherwise((a * n - F.floor(a * (a - 1) / 2) + (b - a)).cast("long"))


def family(identifier) -> Column:
    """An identifier without its last two characters if it ends in a digit."""
    c = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.when(c.rlike("[0-9]$"), F.substring(c, F.lit(1), F.greatest(F.length(c) - 2, F.lit(0)))).otherwise(c)


def first_target(identifier, targets: list[str]) -> Column:
    """The last of ``targets`` that the identifier contains, so a longer name listed later wins."""
    c, out = (F.col(identifier) if isinstance(identifier, str) else identifier), None
    for t in reversed(targets):
        out = F.when(c.contains(t), F.lit(t)) if out is None else out.when(c.contains(t), F.lit(t))
    return out if out is not None else F.lit(None).cast("string")


def channel(first, second) -> Column:
    return F.concat_ws("_to_", first, second)


def hashed_order(*parts) -> Column:
    """A reproducible stand-in for a random order."""
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def hashed_uniform(*parts) -> Column:
    """A value in [0, 1) by hash; the same in any engine and partitioning."""
    return F.conv(F.substring(hashed_order(*parts), 1, 13), 16, 10).cast("double") / float(16**13)
