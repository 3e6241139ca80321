"""Running sums over a whole table in one order, without one task that sees all rows.

Rows fall into ranges of the ordering value, cut at approximate quantiles (a fixed number of them); a value that stands at a cut has
a range of its own, parted further by the tie-breaking id, so that no number of ties makes a range large. Windows run within ranges,
and the totals of the ranges before (a fixed number of rows) are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the ordering value, and of the id within ties.
CUTS = 64


def _cuts(df: DataFrame, *cols: str) -> list[list[float]]:
    q = [i / CUTS for i in range(1, CUTS)]
    row = df.agg(*[F.percentile_approx(c, q, 10_000).alias(c) for c in cols]).first()
    return [sorted({x for x in (row[c] or []) if x is not None}) for c in cols]


def _range(c: Column, cuts: list[float]) -> Column:
    if not cuts:
        return F.lit(0)
    a = F.array(*[F.lit(x) for x in cuts])
    below = F.size(F.filter(a, lambda x: x < c))
    return below * 2 + F.array_contains(a, c).cast("int")


def running(df: DataFrame, order: str, tie: str, sums: dict[str, Column], descending: bool = False, count: str | None = None) -> DataFrame:
    """``df`` with running sums (this row included) in the order of ``order`` then ``tie`` ascending; ``count`` names the row number."""
    vo, vt = _cuts(df, order, tie)
    at_cut = F.array_contains(F.array(*[F.lit(x) for x in vo]), F.col(order)) if vo else F.lit(False)
    d = df.withColumn("_r", _range(F.col(order), vo)).withColumn("_t", F.when(at_cut, _range(F.col(tie), vt)).otherwise(0))
    for i, c in enumerate(sums.values()):
        d = d.withColumn(f"_v{i}", c)
    if count:
        d = d.withColumn(f"_v{len(sums)}", F.lit(1).cast("long"))
    names = [*sums, *([count] if count else [])]
    sign = F.col("_r").desc() if descending else F.col("_r").asc()
    totals = d.groupBy("_r", "_t").agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(names))])
    before = Window.orderBy(sign, "_t").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select("_r", "_t", *[zero(F.sum(f"_s{i}").over(before)).alias(f"_b{i}") for i in range(len(names))])
    inside = Window.partitionBy("_r", "_t").orderBy(F.col(order).desc() if descending else F.col(order).asc(), F.col(tie).asc()).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(F.broadcast(totals), ["_r", "_t"])
    for i, n in enumerate(names):
        out = out.withColumn(n, F.sum(f"_v{i}").over(inside) + F.col(f"_b{i}"))
    return out.select(*df.columns, *names)


def numbered(df: DataFrame, order: str, tie: str | None = None, name: str = "number") -> DataFrame:
    """``df`` with a number from 0 in the order of numeric columns, each (order, tie) once; no task sees all rows."""
    tie_col = tie or "_tie"
    d = df if tie else df.withColumn("_tie", F.lit(0).cast("long"))
    out = running(d, order, tie_col, {}, count=name)
    return out.withColumn(name, (F.col(name) - 1).cast("long")).select(*df.columns, name)
