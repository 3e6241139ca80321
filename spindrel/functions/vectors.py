"""Arithmetic on ``array<double>`` columns, inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scaled(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def dot(a: Column, b: Column) -> Column:
    return total(times(a, b))


def l1(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def cross(a: Column, b: Column) -> Column:
    g = lambda c, i: F.element_at(c, i)
    return F.array(g(a, 2) * g(b, 3) - g(a, 3) * g(b, 2), g(a, 3) * g(b, 1) - g(a, 1) * g(b, 3), g(a, 1) * g(b, 2) - g(a, 2) * g(b, 1))


def angle(a: Column, b: Column) -> Column:
    """The angle between two vectors of three, in 0..pi."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def matvec(rows: list[list[float]], a: Column, bias: list[float] | None = None) -> Column:
    """A matrix of literals times a vector column, plus a bias."""
    out = [total(F.transform(F.arrays_zip(F.array(*map(F.lit, map(float, r))).alias("w"), a.alias("x")), lambda z: z["w"] * z["x"])) for r in rows]
    return F.array(*[o + F.lit(float(b)) for o, b in zip(out, bias or [0.0] * len(rows))])


def rounded(a: Column, n: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x, n))
