"""Scalar columns that Spark lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal tail, West (2005), after Hart (1968), double precision.
TAIL_NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_DENOMINATOR = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_SPLIT = 7.07106781186547


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def norm_cdf(x: Column) -> Column:
    """The standard normal distribution function, to about 1e-15."""
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    near = bell * _horner(TAIL_NUMERATOR, a) / _horner(TAIL_DENOMINATOR, a)
    far = bell / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) * 2.506628274631)
    tail = F.when(a > 37, 0.0).when(a < TAIL_SPLIT, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def no_nan(x: Column) -> Column:
    """NaN and infinities become null: Spark orders NaN above all numbers."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def norm_cdf_sql(x: str) -> str:
    """The same function as DuckDB SQL."""
    horner = lambda cs: "(" * (len(cs) - 1) + f"{cs[0]!r}::DOUBLE" + "".join(f"*abs({x})+{c!r}::DOUBLE)" for c in cs[1:])
    bell = f"exp(-({x})*({x})/2)"
    near = f"{bell}*{horner(TAIL_NUMERATOR)}/{horner(TAIL_DENOMINATOR)}"
    far = f"{bell}/((abs({x})+1/(abs({x})+2/(abs({x})+3/(abs({x})+4/(abs({x})+0.65::DOUBLE)))))*2.506628274631::DOUBLE)"
    tail = f"(CASE WHEN abs({x})>37 THEN 0.0::DOUBLE WHEN abs({x})<{TAIL_SPLIT!r}::DOUBLE THEN {near} ELSE {far} END)"
    return f"(CASE WHEN ({x})>0 THEN 1-{tail} ELSE {tail} END)"
