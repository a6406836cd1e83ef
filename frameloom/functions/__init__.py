"""Column functions over arrays of numbers and complex values (struct<re, im>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def power(z: Column) -> Column:
    return z["re"] * z["re"] + z["im"] * z["im"]


def multiply(a: Column, b: Column) -> Column:
    return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))


def conjugate(z: Column) -> Column:
    return F.struct(z["re"].alias("re"), (-z["im"]).alias("im"))


def log_add(a: Column, b: Column) -> Column:
    """-ln(exp(-a) + exp(-b))."""
    return F.least(a, b) - F.log1p(F.exp(-F.abs(a - b)))


def log_sub(a: Column, b: Column) -> Column:
    """-ln(exp(-a) - exp(-b)) for a < b; infinite where they are equal."""
    return F.when(a < b, a - F.log1p(-F.exp(a - b))).otherwise(F.lit(float("inf")))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series from 9 on, and by a table of the first values."""
    import math

    table = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(9)))
    x = (n + 1).cast("double")
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n < 9, F.get(table, n.cast("int"))).otherwise(series)


def polynomial(coefficients: list[float], x: Column, derivative: bool = False) -> Column:
    """A power series with the lowest coefficient first, or its derivative, by Horner's rule."""
    c = [k * v for k, v in enumerate(coefficients)][1:] if derivative else coefficients
    out = F.lit(0.0)
    for v in reversed(c):
        out = out * x + v
    return out
