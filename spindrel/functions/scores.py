"""Scores of triplets from vectors, and scalar functions of models. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrel.functions.vectors import added, dot, l1, minus, times, total


def _half(a: Column, d: int, second: bool) -> Column:
    return F.slice(a, d // 2 + 1 if second else 1, d // 2)


def transe(h: Column, r: Column, t: Column) -> Column:
    """City-block length of ``h + r - t``."""
    return l1(minus(added(h, r), t))


def distmult(h: Column, r: Column, t: Column) -> Column:
    return total(times(times(h, r), t))


def complex_(h: Column, r: Column, t: Column, d: int) -> Column:
    """Real part of the product of ``h``, ``r`` and the conjugate of ``t``; real parts first in each vector."""
    hr, hi, rr, ri, tr, ti = (_half(x, d, s) for x in (h, r, t) for s in (False, True))
    return total(times(minus(times(hr, rr), times(hi, ri)), tr)) + total(times(added(times(hr, ri), times(hi, rr)), ti))


def simple(h: Column, r: Column, t: Column, d: int) -> Column:
    """Product with the halves of ``t`` exchanged."""
    return distmult(h, r, F.concat(_half(t, d, True), _half(t, d, False)))


def rotate(h: Column, phase: Column, t: Column, d: int) -> Column:
    """Sum of the distances between ``h`` rotated by ``phase`` (d/2 angles) and ``t``."""
    hr, hi, tr, ti = (_half(x, d, s) for x in (h, t) for s in (False, True))
    c, s = F.transform(phase, F.cos), F.transform(phase, F.sin)
    re, im = minus(minus(times(hr, c), times(hi, s)), tr), minus(added(times(hr, s), times(hi, c)), ti)
    return total(F.zip_with(re, im, lambda x, y: F.sqrt(x * x + y * y)))


def with_vectors(triplets: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``triplets (h, r, t)`` with the vectors of entities ``(id, v)`` and of the few relations ``(id, v)``."""
    e = entities.select(F.col("id").alias("h"), F.col("v").alias("vh"))
    f = entities.select(F.col("id").alias("t"), F.col("v").alias("vt"))
    return triplets.join(e, "h").join(f, "t").join(maybe_broadcast(relations.select(F.col("id").alias("r"), F.col("v").alias("vr"))), "r")


def one_hot(i: Column, n: int, allow_unknown: bool = False) -> Column:
    """``n`` places, 1 at ``i``; with ``allow_unknown`` one more place for anything outside, else that is an error."""
    inside = i.between(0, n - 1)
    if allow_unknown:
        return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: (k == F.when(inside, i).otherwise(F.lit(n))).cast("int"))
    checked = F.when(inside, i).otherwise(F.raise_error(F.lit("outside the vocabulary")).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == checked).cast("int"))


def shifted_softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0)) - math.log(2.0)


def clipped_objective(policy: Column, agent: Column, reward: Column, eps: float = 0.2) -> Column:
    """The smaller of the reward times the ratio of two likelihoods, at most 10, and the same with the ratio clipped to 1 ± ``eps``."""
    ratio = F.least(F.exp(policy - agent), F.lit(10.0))
    return F.least(ratio * reward, F.least(F.greatest(ratio, F.lit(1 - eps)), F.lit(1 + eps)) * reward)


def policy_objective(policy: Column, reward: Column) -> Column:
    return policy * reward


def model_score(distance: Column, most: float = 12.0) -> Column:
    """The score of models whose raw score is a distance."""
    return F.lit(float(most)) - distance


def cubic_penalty(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Sum of the cubes of all vectors' sizes (``v``), and that over the number of vectors."""
    rows = entities.select("v").unionByName(relations.select("v"))
    cube = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x) * x * x)
    return rows.agg(F.sum(cube).alias("penalty"), F.count("*").alias("n")).select("penalty", (F.col("penalty") / F.col("n")).alias("per_vector"))


def gaussians(x: Column, start: float, stop: float, n: int) -> Column:
    """``n`` Gaussians with evenly spaced centres, as wide as they lie apart."""
    step = (stop - start) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.exp(-0.5 * F.pow((x - (F.lit(start) + k * step)) / step, 2)))


def positions(pos: Column, length: Column, dim: int) -> Column:
    """Sines then cosines of the position counted from the end."""
    p = (length - 1 - pos).cast("double")
    freq = F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), lambda k: p / F.pow(F.lit(10000.0), k * 2.0 / dim))
    return F.concat(F.transform(freq, F.sin), F.transform(freq, F.cos))


def gaussian_log_pdf(x: Column, mu: float, sigma2: float) -> Column:
    return -0.5 * (F.pow(x - mu, 2) / sigma2 + math.log(2 * math.pi * sigma2))


def coupling(x: Column, scale: Column, shift: Column, reverse: bool = False) -> tuple[Column, Column]:
    """An affine coupling (or its inverse) and its log determinant."""
    if reverse:
        return x * F.exp(-scale) - shift, -scale
    return (x + shift) * F.exp(scale), scale


def normalised(x: Column, mean: float, std: float) -> Column:
    return (x - mean) / std


__all__ = ["clipped_objective", "complex_", "coupling", "cubic_penalty", "distmult", "dot", "gaussian_log_pdf", "gaussians", "model_score", "normalised", "one_hot", "policy_objective", "positions", "rotate", "shifted_softplus", "simple", "transe", "with_vectors"]
