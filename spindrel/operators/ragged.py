"""Operators on ragged sets: rows ``(set_id, pos, value)``, ``pos`` counting from 0 within a set. Ties go to the smaller ``pos``.

Aggregates combine before the shuffle on ``set_id``; rankings are windows within sets. Sets without rows can be declared with
``sizes (set_id, size)`` and then come out with the documented value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(desc: bool = False, by: str = "value"):
    return Window.partitionBy("set_id").orderBy(F.col(by).desc() if desc else F.col(by).asc(), F.col("pos").asc())


def declared(agg: DataFrame, sizes: DataFrame | None, **fill) -> DataFrame:
    if sizes is None:
        return agg
    return sizes.select("set_id").join(agg, "set_id", "left").fillna(fill)


def ragged_sum(sets: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Sum of each set; an empty set gives 0."""
    return declared(sets.groupBy("set_id").agg(F.sum("value").alias("total")), sizes, total=0.0)


def ragged_mean(sets: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Mean of each set; an empty set gives 0."""
    return declared(sets.groupBy("set_id").agg(F.avg("value").alias("mean")), sizes, mean=0.0)


def ragged_max(sets: DataFrame) -> DataFrame:
    """Largest value of each set and its first position."""
    best = F.max(F.struct("value", (-F.col("pos")).alias("at")))
    return sets.groupBy("set_id").agg(best.alias("b")).select("set_id", F.col("b.value").alias("top"), (-F.col("b.at")).alias("arg"))


def ragged_sort(sets: DataFrame, descending: bool = False) -> DataFrame:
    """Values in order, with their new place and the position they had."""
    return sets.select("set_id", (F.row_number().over(_w(descending)) - 1).cast("long").alias("place"), "value", "pos")


def ragged_softmax(sets: DataFrame, log: bool = False) -> DataFrame:
    """Softmax within each set, shifted by its maximum; with ``log`` its logarithm."""
    w = Window.partitionBy("set_id")
    x = sets.withColumn("x", F.col("value") - F.max("value").over(w))
    e = F.exp("x")
    s = F.sum(e).over(w)
    return x.select("set_id", "pos", (F.col("x") - F.log(s) if log else e / s).alias("p"))


def ragged_cross_entropy(sets: DataFrame, targets: DataFrame) -> DataFrame:
    """Minus log softmax at each set's target position; ``targets (set_id, target)``. A target outside its set is an error."""
    j = targets.join(ragged_softmax(sets, log=True), "set_id").groupBy("set_id").agg(F.max(F.when(F.col("pos") == F.col("target"), -F.col("p"))).alias("loss"))
    return j.withColumn("loss", F.coalesce("loss", F.raise_error(F.lit("a target lies outside its set")).cast("double")))


def ragged_arange(sizes: DataFrame) -> DataFrame:
    """0..size-1 of each set."""
    return sizes.where("size > 0").select("set_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size").cast("long") - 1)).alias("pos"))


def ragged_topk(sets: DataFrame, k: int | Column, largest: bool = True, padded: bool = False) -> DataFrame:
    """The k first of each set in order, with their positions. ``padded`` repeats the last one up to k places."""
    kc = F.lit(k) if isinstance(k, int) else k
    ranked = sets.withColumn("place", (F.row_number().over(_w(largest)) - 1).cast("long")).where(F.col("place") < kc)
    if not padded:
        return ranked.select("set_id", "place", "value", "pos")
    last = F.max("place").over(Window.partitionBy("set_id")) == F.col("place")
    again = F.when(last, F.sequence(F.col("place"), (kc - 1).cast("long"))).otherwise(F.array("place"))
    return ranked.withColumn("places", again).select("set_id", F.explode("places").alias("place"), "value", "pos")


def ragged_meshgrid(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of a row of ``a`` and one of ``b`` in the same set, the second counting fastest. Its size is that of the result."""
    return a.select("set_id", F.col("pos").alias("pos_a"), F.col("value").alias("a")).join(b.select("set_id", F.col("pos").alias("pos_b"), F.col("value").alias("b")), "set_id")


def to_padded(sets: DataFrame, width: int | None = None, value: float = 0.0) -> DataFrame:
    """One array of ``width`` a set, and which places are real. Without ``width`` that of the largest set, so that no row is lost."""
    if width is None:
        w = sets.agg((F.max("pos") + 1).alias("_w"))
        a = sets.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("z")).crossJoin(F.broadcast(w))
    else:
        a = sets.where(F.col("pos") < width).groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("z")).withColumn("_w", F.lit(width))
    n = F.size("z")
    rest = (F.col("_w") - n).cast("int")
    row = F.concat(F.transform("z", lambda x: x["value"]), F.array_repeat(F.lit(float(value)), rest))
    mask = F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), rest))
    return a.select("set_id", row.alias("padded"), mask.alias("mask"))


def from_padded(padded: DataFrame, sizes: DataFrame) -> DataFrame:
    """The first ``size`` places of each array, as rows."""
    j = padded.join(sizes, "set_id").select("set_id", F.posexplode(F.slice("padded", F.lit(1), F.col("size").cast("int"))).alias("pos", "value"))
    return j.withColumn("pos", F.col("pos").cast("long"))


def extended(sets: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of ``more`` behind those of ``sets``, set by set."""
    n = sets.groupBy("set_id").agg((F.max("pos") + 1).alias("n"))
    tail = more.join(n, "set_id", "left").withColumn("pos", F.col("pos") + F.coalesce("n", F.lit(0))).select("set_id", "pos", "value")
    return sets.select("set_id", "pos", "value").unionByName(tail)


def multi_slice(spans: DataFrame) -> DataFrame:
    """The positions that the ranges ``[start, end)`` cover, once each and in order, by ``set_id``."""
    return spans.where("end > start").select("set_id", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long") - 1)).alias("pos")).distinct()


def multi_slice_mask(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each position of each set whether a range covers it."""
    hit = multi_slice(spans).withColumn("covered", F.lit(True))
    return ragged_arange(sizes).join(hit, ["set_id", "pos"], "left").select("set_id", "pos", F.coalesce("covered", F.lit(False)).alias("covered"))


def as_mask(positions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Positions as a mask over their sets."""
    hit = positions.select("set_id", "pos").distinct().withColumn("covered", F.lit(True))
    return ragged_arange(sizes).join(hit, ["set_id", "pos"], "left").select("set_id", "pos", F.coalesce("covered", F.lit(False)).alias("covered"))


def masked_mean(value: Column, mask: Column) -> Column:
    """Mean of the values whose mask holds, 0 where none does; NaN counts as masked out."""
    ok = mask & ~F.isnan(value)
    return F.coalesce(F.sum(F.when(ok, value)), F.lit(0.0)) / F.greatest(F.count(F.when(ok, 1)), F.lit(1))


def mean_with_nan(value: Column) -> Column:
    """Mean of the values that are numbers; null where none is."""
    return F.avg(F.when(~F.isnan(value), value))


def key_of(*cols: Column) -> Column:
    """A pseudo-random but repeatable number of 32 bits for a row: the start of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def ragged_randperm(sets: DataFrame, seed: int = 0) -> DataFrame:
    """A repeatable random order of each set."""
    k = key_of(F.lit(seed), F.col("set_id"), F.col("pos"))
    return sets.select("set_id", "pos", (F.row_number().over(Window.partitionBy("set_id").orderBy(k, "pos")) - 1).cast("long").alias("place"))


def ragged_sample(sizes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement from each set."""
    draws = sizes.where("size > 0").select("set_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("draw"))
    return draws.select("set_id", "draw", F.pmod(key_of(F.lit(seed), F.col("set_id"), F.col("draw")), F.col("size")).alias("pos"))


def sizes_of(sets: DataFrame) -> DataFrame:
    return sets.groupBy("set_id").agg(F.count("*").alias("size"))
