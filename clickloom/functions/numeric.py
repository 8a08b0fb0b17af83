"""Scalar numeric functions."""

from __future__ import annotations

import numpy as np
from numpy.polynomial.polynomial import polyval
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 (PPND16) for the inverse normal
# distribution, constant term first: numerator and denominator per region.
CENTRAL = (
    (3.387132872796366608, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.1870074920579083, 5394.1960214247511077,
     21213.794301586595867, 39307.89580009271061, 28729.085735721942674, 5226.495278852545925),
)
MIDDLE = (
    (1.42343711074968357734, 4.6303378461565452959, 5.7694972214606914055, 3.64784832476320460504,
     1.27045825245236838258, 0.24178072517745061177, 0.0227238449892691845833, 7.7454501427834140764e-4),
    (1.0, 2.05319162663775882187, 1.6763848301838038494, 0.68976733498510000455,
     0.14810397642748007459, 0.0151986665636164571966, 5.475938084995344946e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.6579046435011037772, 5.4637849111641143699, 1.7848265399172913358, 0.29656057182850489123,
     0.026532189526576123093, 0.0012426609473880784386, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.59983220655588793769, 0.13692988092273580531, 0.0148753612908506148525,
     7.868691311456132591e-4, 1.8463183175100546818e-5, 1.4215117583164458887e-7, 2.04426310338993978564e-15),
)


def clip(x: Column, low: float, high: float) -> Column:
    """Into [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clip_probability(p: Column, eps: float = 1e-15) -> Column:
    return clip(p, eps, 1.0 - eps)


def log1p_twice(x: Column) -> Column:
    """`log1p(log1p(x))`, the squashing used for long-tailed gaps; null where undefined."""
    return F.log1p(F.log1p(x))


def _ratio(region, x: np.ndarray) -> np.ndarray:
    return polyval(x, region[0]) / polyval(x, region[1])


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution function for 0 < p < 1, on a batch of values."""
    q = p - 0.5
    r = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    outer = np.where(r <= 5.0, _ratio(MIDDLE, r - 1.6), _ratio(TAIL, r - 5.0))
    return np.where(np.abs(q) <= 0.425, q * _ratio(CENTRAL, 0.180625 - q * q), np.sign(q) * outer)


def bucket(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Histogram bin 0..bins-1 over [low, high]; the top edge belongs to the last bin."""
    width = (high - low) / bins
    return F.when(high > low, F.least(F.floor((x - low) / width), F.lit(bins - 1))).otherwise(0).cast("int")
