"""Neighbours in space and along chains, angles, contacts. Positions are ``array<double>`` of three."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.functions.vectors import angle, cross, distance, minus
from spindrel.session import written


def _cell(c: Column, i: int, size: float) -> Column:
    return F.floor(F.element_at(c, i) / size)


def radius_pairs(nodes: DataFrame, radius: float) -> DataFrame:
    """``(graph_id, a, b, distance)`` of all ordered pairs within ``radius``: nodes meet in cells of that size and the 26 around."""
    p = nodes.select("graph_id", "node_id", "position", *[_cell(F.col("position"), i + 1, radius).alias(f"c{i}") for i in range(3)])
    step = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    q = p.withColumnsRenamed({"node_id": "b", "position": "pb"})
    for i in range(3):
        q = q.withColumn(f"s{i}", F.explode(step)).withColumn(f"c{i}", F.col(f"c{i}") + F.col(f"s{i}")).drop(f"s{i}")
    j = p.withColumnsRenamed({"node_id": "a", "position": "pa"}).join(q, ["graph_id", "c0", "c1", "c2"]).where("a <> b")
    return j.withColumn("distance", distance(F.col("pa"), F.col("pb"))).where(F.col("distance") < radius).select("graph_id", "a", "b", "distance")


def knn_pairs(nodes: DataFrame, k: int) -> DataFrame:
    """``(graph_id, a, b, distance)``: the ``k`` nearest other nodes of each node of the same graph, ties by id; exact.

    Nodes meet in cells and the 26 around, the cell's size set by each graph's density. A node is done once ``k`` others lie within
    its cell size, which everything nearer must; the rest go on with cells twice the size, until a cell spans the graph. So no graph
    is paired with itself as a whole, unless it is that small.
    """
    g = nodes.groupBy("graph_id").agg(*[f(F.element_at("position", i)).alias(f"{n}{i}") for i in (1, 2, 3) for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n"))
    side = [F.greatest(F.col(f"hi{i}") - F.col(f"lo{i}"), F.lit(1e-9)) for i in (1, 2, 3)]
    g = g.select("graph_id", F.greatest(*side).alias("span"), F.pow(side[0] * side[1] * side[2] * (k + 1) / F.col("n"), 1 / 3).alias("size"))
    p = written(nodes.select("graph_id", "node_id", "position").join(g, "graph_id"), "placed")
    left, out, grow = p, None, 1.0
    step = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    while True:
        s = F.greatest(F.col("size"), F.col("span") / 1e6) * grow
        cells = lambda df: df.withColumn("s", s).select("*", *[F.floor(F.element_at("position", i) / F.col("s")).alias(f"c{i}") for i in (1, 2, 3)])
        a = cells(left).select("graph_id", F.col("node_id").alias("a"), F.col("position").alias("pa"), "s", (F.col("s") > F.col("span")).alias("all"), "c1", "c2", "c3")
        for i in (1, 2, 3):
            a = a.withColumn("_s", F.explode(step)).withColumn(f"c{i}", F.col(f"c{i}") + F.col("_s")).drop("_s")
        b = cells(p).select("graph_id", F.col("node_id").alias("b"), F.col("position").alias("pb"), "c1", "c2", "c3")
        j = a.join(b, ["graph_id", "c1", "c2", "c3"]).where("a <> b").select("graph_id", "a", "b", "s", "all", distance(F.col("pa"), F.col("pb")).alias("distance"))
        w = Window.partitionBy("graph_id", "a")
        best = j.withColumn("_k", F.row_number().over(w.orderBy("distance", "b"))).where(F.col("_k") <= k)
        best = best.withColumn("_n", F.count(F.when(F.col("distance") <= F.col("s"), 1)).over(w))
        done = written(best.where((F.col("_n") >= k) | F.col("all")).select("graph_id", "a", "b", "distance"), "nearest")
        out = done if out is None else out.unionByName(done)
        found = done.select("graph_id", F.col("a").alias("node_id")).distinct()
        left = written(left.where(s <= F.col("span")).join(found, ["graph_id", "node_id"], "left_anti"), "left")
        if left.isEmpty():
            return out
        grow *= 2


def gap_filter(pairs: DataFrame, residue: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Pairs whose residues (``residue (graph_id, node_id, residue_id)``) lie at least and at most so far apart in the chain."""
    r = lambda c: residue.select("graph_id", F.col("node_id").alias(c), F.col("residue_id").alias(f"r{c}"))
    j = pairs.join(r("a"), ["graph_id", "a"]).join(r("b"), ["graph_id", "b"])
    gap = F.abs(F.col("ra") - F.col("rb"))
    keep = (gap >= least if least is not None else F.lit(True)) & (gap <= most if most is not None else F.lit(True))
    return j.where(keep & (F.col("distance") >= 1e-10)).drop("ra", "rb")


def sequential_pairs(residues: DataFrame, reach: int, chain: str | None = None) -> DataFrame:
    """``(graph_id, a, b, relation)``: residues up to ``reach`` apart, loops included; the relation is the offset plus ``reach``."""
    keys = ["graph_id", *([chain] if chain else [])]
    a = residues.select(*keys, F.col("pos").alias("a")).withColumn("o", F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))))
    b = residues.select(*keys, F.col("pos").alias("b"))
    return a.withColumn("b", F.col("a") + F.col("o")).join(b, [*keys, "b"]).select("graph_id", "a", "b", (F.col("o") + reach).alias("relation"))


def angle_bin(theta: Column, bins: int) -> Column:
    """The bin of an angle in 0..pi; pi itself falls in the last one."""
    return F.least(F.floor(theta / math.pi * bins), F.lit(bins - 1)).cast("long")


def edge_angles(edges: DataFrame, positions: DataFrame, bins: int) -> DataFrame:
    """Bins of the angles between edges that follow each other: ``edges (graph_id, edge_id, node_in, node_out)``."""
    p = lambda c: positions.select("graph_id", F.col("node_id").alias(c), F.col("position").alias(f"p_{c}"))
    e = edges.join(p("node_in"), ["graph_id", "node_in"]).join(p("node_out"), ["graph_id", "node_out"]).withColumn("v", minus(F.col("p_node_out"), F.col("p_node_in")))
    a = e.select("graph_id", F.col("edge_id").alias("edge_a"), F.col("node_in").alias("start"), F.col("node_out").alias("mid"), F.col("v").alias("va"))
    b = e.select("graph_id", F.col("edge_id").alias("edge_b"), F.col("node_in").alias("mid"), F.col("node_out").alias("stop"), F.col("v").alias("vb"))
    j = a.join(b, ["graph_id", "mid"])
    return j.withColumn("theta", angle(F.transform("va", lambda x: -x), F.col("vb"))).select("graph_id", "edge_a", "edge_b", "start", "stop", "theta", angle_bin(F.col("theta"), bins).alias("bin"))


def dihedral(a: Column, b: Column, c: Column) -> Column:
    """The angle between the planes of three steps, in 0..pi."""
    return angle(cross(a, b), cross(b, c))


def contacts(residues: DataFrame, cutoff: float, gap: int) -> DataFrame:
    """Pairs of residues of a protein that lie at least ``gap`` apart in the chain, and whether nearer than ``cutoff`` in space."""
    a = residues.select("graph_id", F.col("pos").alias("a"), F.col("position").alias("pa"))
    b = residues.select("graph_id", F.col("pos").alias("b"), F.col("position").alias("pb"))
    j = a.join(b, "graph_id").where(F.abs(F.col("a") - F.col("b")) >= gap)
    return j.select("graph_id", "a", "b", (distance(F.col("pa"), F.col("pb")) < cutoff).alias("contact"))
