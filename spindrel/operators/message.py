"""Message passing, readouts, normalisation and pooling over tables of graphs.

Features are ``array<double>`` or plain columns of ``nodes (graph_id, node_id, x)``. All products are joins on ids followed by
aggregates that combine before the shuffle; vectors are aggregated element by element as (place, value) rows only where a sum over
rows is needed, so that no group is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.functions.vectors import dot, matvec, rounded, total
from spindrel.session import maybe_broadcast

AGGREGATES = {"add": F.sum, "min": F.min, "max": F.max, "mean": F.avg}
#: What an empty row of a semiring product holds.
EMPTY = {"add": 0.0, "mean": 0.0, "min": float("inf"), "max": float("-inf")}


def _pair(mul: str, a: Column, b: Column) -> Column:
    if mul not in ("mul", "add"):
        raise ValueError(f"unknown product: {mul}")
    return a * b if mul == "mul" else a + b


def spmm(edges: DataFrame, x: DataFrame, add: str = "add", mul: str = "mul", keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """``out[node] = add over edges node -> other of mul(weight, x[other])``; ``x (keys..., node_id, x)``. Nodes without edges get
    the sum's neutral element."""
    if add not in AGGREGATES:
        raise ValueError(f"unknown sum: {add}")
    m = edges.join(x.withColumnRenamed("node_id", "node_out"), [*keys, "node_out"])
    out = m.groupBy(*keys, F.col("node_in").alias("node_id")).agg(AGGREGATES[add](_pair(mul, F.col("weight"), F.col("x"))).alias("y"))
    return x.select(*keys, "node_id").join(out, [*keys, "node_id"], "left").fillna(EMPTY[add], ["y"])


def rspmm(edges: DataFrame, relation: DataFrame, x: DataFrame, add: str = "add", mul: str = "mul") -> DataFrame:
    """``out[node] = add of weight * mul(rel[relation], x[other])`` over ``edges (node_in, node_out, relation, weight)``;
    ``relation (relation, w)``."""
    m = edges.join(maybe_broadcast(relation), "relation").join(x.withColumnRenamed("node_id", "node_out"), "node_out")
    out = m.groupBy(F.col("node_in").alias("node_id")).agg(AGGREGATES[add](F.col("weight") * _pair(mul, F.col("w"), F.col("x"))).alias("y"))
    return x.select("node_id").join(out, "node_id", "left").fillna(EMPTY[add], ["y"])


def readout(nodes: DataFrame, how: str = "mean", by: str = "graph_id") -> DataFrame:
    """Sum, mean or largest ``x`` of each group."""
    return nodes.groupBy(by).agg(AGGREGATES["add" if how == "sum" else how]("x").alias("y"))


def readout_vectors(nodes: DataFrame, how: str = "mean", by: str = "graph_id") -> DataFrame:
    """The same of ``v array<double>``, element by element: ``(by, place, y)``."""
    rows = nodes.select(by, F.posexplode("v").alias("place", "x"))
    return rows.groupBy(by, "place").agg(AGGREGATES["add" if how == "sum" else how]("x").alias("y"))


def attention_readout(nodes: DataFrame, weights: list[float], bias: float = 0.0, by: str = "graph_id") -> DataFrame:
    """Sum of vectors weighted by the softmax of their product with ``weights``: ``(by, place, y)``."""
    s = nodes.withColumn("_s", dot(F.col("v"), F.array(*[F.lit(float(w)) for w in weights])) + bias)
    top = s.groupBy(by).agg(F.max("_s").alias("_m"))
    e = s.join(top, by).withColumn("_e", F.exp(F.col("_s") - F.col("_m")))
    rows = e.select(by, "_e", F.posexplode("v").alias("place", "x"))
    return rows.groupBy(by, "place").agg((F.sum(F.col("_e") * F.col("x")) / F.sum("_e")).alias("y"))


def softmax_readout(nodes: DataFrame, by: str = "graph_id", eps: float = 1e-10) -> DataFrame:
    w = Window.partitionBy(by)
    e = F.exp(F.col("x") - F.max("x").over(w))
    return nodes.withColumn("_e", e).withColumn("p", F.col("_e") / (F.sum("_e").over(w) + eps)).drop("_e")


def instance_norm(nodes: DataFrame, by: str = "graph_id", eps: float = 1e-5) -> DataFrame:
    """``x`` less the mean of its graph, over the root of its variance; statistics are aggregated, then joined (a row a graph)."""
    m = nodes.groupBy(by).agg(F.avg("x").alias("_m"), F.var_pop("x").alias("_v"))
    return nodes.join(m, by).withColumn("x", (F.col("x") - F.col("_m")) / F.sqrt(F.col("_v") + eps)).drop("_m", "_v")


def pair_norm(nodes: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Centred over all nodes and scaled to a mean square of 1; two numbers are aggregated."""
    s = nodes.agg(F.avg("x").alias("_m"), F.var_pop("x").alias("_v"))
    return nodes.crossJoin(F.broadcast(s)).withColumn("x", (F.col("x") - F.col("_m")) / F.sqrt(F.col("_v") + eps)).drop("_m", "_v")


def degrees(edges: DataFrame, end: str, name: str) -> DataFrame:
    return edges.groupBy("graph_id", F.col(end).alias("node_id")).agg(F.sum("weight").alias(name))


def gcn(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sum over incoming edges and a loop of weight 1, each divided by the root of both ends' degrees (with that loop)."""
    loops = nodes.select("graph_id", F.col("node_id").alias("node_in"), F.col("node_id").alias("node_out"), F.lit(1.0).alias("weight"))
    e = edges.select("graph_id", "node_in", "node_out", "weight").unionByName(loops)
    a, b = degrees(e, "node_in", "da").withColumnRenamed("node_id", "node_in"), degrees(e, "node_out", "db").withColumnRenamed("node_id", "node_out")
    x = nodes.select("graph_id", F.col("node_id").alias("node_in"), "x")
    m = e.join(a, ["graph_id", "node_in"]).join(b, ["graph_id", "node_out"]).join(x, ["graph_id", "node_in"])
    return m.groupBy("graph_id", F.col("node_out").alias("node_id")).agg(F.sum(F.col("weight") / F.sqrt(F.col("da") * F.col("db")) * F.col("x")).alias("y"))


def summed(edges: DataFrame, nodes: DataFrame, how: str = "add", feature: str | None = None) -> DataFrame:
    """Weighted sum (or mean) over incoming edges, of ``x`` or of ``x`` plus the edge's ``feature``; 0 without any."""
    x = nodes.select("graph_id", F.col("node_id").alias("node_in"), "x")
    m = edges.join(x, ["graph_id", "node_in"]).groupBy("graph_id", F.col("node_out").alias("node_id"))
    agg = F.sum(F.col("weight") * (F.col("x") + F.col(feature) if feature else F.col("x")))
    out = m.agg((agg if how == "add" else agg / F.sum("weight")).alias("y"))
    return nodes.select("graph_id", "node_id").join(out, ["graph_id", "node_id"], "left").fillna(0.0, ["y"])


def gin(edges: DataFrame, nodes: DataFrame, eps: float = 0.0) -> DataFrame:
    """``(1 + eps) x`` plus the weighted sum over incoming edges."""
    return summed(edges, nodes).join(nodes.select("graph_id", "node_id", "x"), ["graph_id", "node_id"]).select("graph_id", "node_id", ((1 + eps) * F.col("x") + F.col("y")).alias("y"))


def relational(edges: DataFrame, nodes: DataFrame, how: str = "mean") -> DataFrame:
    """Weighted mean (or sum) over incoming edges for each node and relation: ``(node_id, relation, y)``."""
    m = edges.join(nodes.select(F.col("node_id").alias("node_in"), "x"), "node_in").groupBy(F.col("node_out").alias("node_id"), "relation")
    agg = F.sum(F.col("weight") * F.col("x"))
    return m.agg((agg / F.sum("weight") if how == "mean" else agg).alias("y"))


def attention(edges: DataFrame, nodes: DataFrame, a: float, b: float, slope: float = 0.2) -> DataFrame:
    """Mean over incoming edges and a loop of weight 1, weighted by exp of the leaky score ``a * x[to] + b * x[from]``, shifted by each
    node's largest. Every node has a row, those without edges their own ``x``. For several heads, call it for each."""
    x = nodes.select("graph_id", "node_id", "x")
    loops = nodes.select("graph_id", F.col("node_id").alias("node_in"), F.col("node_id").alias("node_out"), F.lit(1.0).alias("weight"))
    m = edges.select("graph_id", "node_in", "node_out", "weight").unionByName(loops).join(x.toDF("graph_id", "node_in", "xi"), ["graph_id", "node_in"]).join(x.toDF("graph_id", "node_out", "xo"), ["graph_id", "node_out"])
    s = F.lit(a) * F.col("xo") + F.lit(b) * F.col("xi")
    m = m.withColumn("s", F.when(s > 0, s).otherwise(slope * s))
    top = m.groupBy("graph_id", "node_out").agg(F.max("s").alias("m"))
    e = F.exp(F.col("s") - F.col("m")) * F.col("weight")
    return m.join(top, ["graph_id", "node_out"]).groupBy("graph_id", F.col("node_out").alias("node_id")).agg((F.sum(e * F.col("xi")) / F.sum(e)).alias("y"))


def filtered(edges: DataFrame, nodes: DataFrame, centres: list[float], sigma: float, weights: list[float]) -> DataFrame:
    """Continuous filters: messages times a filter of the edge's ``distance``, expanded in Gaussians and weighted."""
    rbf = sum((F.lit(float(w)) * F.exp(-0.5 * F.pow((F.col("distance") - c) / sigma, 2)) for c, w in zip(centres, weights)), F.lit(0.0))
    return summed(edges.withColumn("weight", F.col("weight") * rbf), nodes)


def chebyshev(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Bases ``T_0 .. T_k`` of the negated normalised adjacency applied to ``x``: ``(graph_id, node_id, order, y)``. Each order is a
    product on the one before; an isolated node's bases beyond the first are 0."""
    a, b = degrees(edges, "node_in", "da").withColumnRenamed("node_id", "node_in"), degrees(edges, "node_out", "db").withColumnRenamed("node_id", "node_out")
    e = edges.join(a, ["graph_id", "node_in"]).join(b, ["graph_id", "node_out"]).withColumn("weight", -F.col("weight") / F.sqrt(F.col("da") * F.col("db"))).select("graph_id", "node_in", "node_out", "weight")
    bases = [nodes.select("graph_id", "node_id", "x")]
    for i in range(1, k + 1):
        y = summed(e, bases[-1]).withColumnRenamed("y", "x")
        if i > 1:
            before = bases[-2].select("graph_id", "node_id", F.col("x").alias("p"))
            y = y.join(before, ["graph_id", "node_id"]).select("graph_id", "node_id", (2 * F.col("x") - F.col("p")).alias("x"))
        bases.append(y)
    out = None
    for i, d in enumerate(bases):
        d = d.select("graph_id", "node_id", F.lit(i).cast("long").alias("order"), F.col("x").alias("y"))
        out = d if out is None else out.unionByName(d)
    return out


def pool_hard(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edges between clusters: ``assignment (graph_id, node_id, cluster)``, weights added up."""
    a = assignment.select("graph_id", F.col("node_id").alias("node_in"), F.col("cluster").alias("c_in"))
    b = assignment.select("graph_id", F.col("node_id").alias("node_out"), F.col("cluster").alias("c_out"))
    return edges.join(a, ["graph_id", "node_in"]).join(b, ["graph_id", "node_out"]).groupBy("graph_id", "c_in", "c_out").agg(F.sum("weight").alias("weight"))


def pool_dense(edges: DataFrame, soft: DataFrame) -> DataFrame:
    """``S' A S``: ``soft (graph_id, node_id, cluster, p)`` holds each node's share in clusters."""
    a = soft.select("graph_id", F.col("node_id").alias("node_in"), F.col("cluster").alias("c_in"), F.col("p").alias("pa"))
    b = soft.select("graph_id", F.col("node_id").alias("node_out"), F.col("cluster").alias("c_out"), F.col("p").alias("pb"))
    # Sorted joins by hint: a row a node and cluster is more than the planner takes it to be, and would be broadcast.
    m = edges.join(a.hint("merge"), ["graph_id", "node_in"]).join(b.hint("merge"), ["graph_id", "node_out"])
    return m.groupBy("graph_id", "c_in", "c_out").agg(F.sum(F.col("pa") * F.col("weight") * F.col("pb")).alias("weight"))


def assignment_entropy(soft: DataFrame, eps: float = 1e-10) -> DataFrame:
    return soft.groupBy("graph_id").agg((F.sum(-F.col("p") * F.log(F.col("p") + eps)) / F.countDistinct("node_id")).alias("entropy"))


def mincut(edges: DataFrame, soft: DataFrame, clusters: int, eps: float = 1e-10) -> DataFrame:
    """``(graph_id, cut, orthogonality)``: 1 less the weight within clusters over the weight of nodes' degrees in clusters; and how far
    the product of the assignment with itself, scaled to length 1, is from an even diagonal. ``soft``: as in :func:`pool_dense`."""
    inside = pool_dense(edges, soft).where("c_in = c_out").groupBy("graph_id").agg(F.sum("weight").alias("inside"))
    d = degrees(edges, "node_in", "deg")
    volume = soft.join(d.hint("merge"), ["graph_id", "node_id"]).groupBy("graph_id").agg(F.sum(F.col("p") * F.col("p") * F.col("deg")).alias("volume"))
    a, b = soft.toDF("graph_id", "node_id", "a", "pa"), soft.toDF("graph_id", "node_id", "b", "pb")
    x = a.join(b.hint("merge"), ["graph_id", "node_id"]).groupBy("graph_id", "a", "b").agg(F.sum(F.col("pa") * F.col("pb")).alias("x"))
    # |x/|x| - 1/sqrt(k) on the diagonal|: entries that don't occur are 0.
    n = x.groupBy("graph_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sum(F.when(F.col("a") == F.col("b"), F.col("x")).otherwise(0.0)).alias("trace"))
    orthogonal = F.sqrt(F.greatest(2 - 2 * F.col("trace") / (F.col("norm") * F.sqrt(F.lit(float(clusters)))), F.lit(0.0)))
    j = n.join(volume, "graph_id", "left").join(inside, "graph_id", "left").fillna(0.0, ["inside", "volume"])
    return j.select("graph_id", (1 - F.col("inside") / (F.col("volume") + eps)).alias("cut"), orthogonal.alias("orthogonality"))


def pair_norm_vectors(nodes: DataFrame, each: bool = False, eps: float = 1e-8) -> DataFrame:
    """Vectors ``v`` centred over all nodes, then scaled together to a mean square length of 1, or ``each`` to length 1."""
    d = nodes.select(F.size("v").alias("d")).first()
    if d is None:
        return nodes
    mean = nodes.agg(*[F.avg(F.col("v")[k]).alias(f"m{k}") for k in range(d["d"])], F.count("*").alias("_n"))
    x = nodes.crossJoin(F.broadcast(mean)).withColumn("v", F.zip_with("v", F.array(*[F.col(f"m{k}") for k in range(d["d"])]), lambda a, b: a - b))
    square = total(F.transform("v", lambda z: z * z))
    if each:
        return x.withColumn("_s", F.sqrt(square) + eps).withColumn("v", F.transform("v", lambda z: z / F.col("_s"))).select(nodes.columns)
    s = x.agg(F.sum(square).alias("_q"))
    return x.crossJoin(F.broadcast(s)).withColumn("v", F.transform("v", lambda z: z * F.sqrt(F.col("_n")) / (F.sqrt("_q") + eps))).select(nodes.columns)


def fingerprint_layer(edges: DataFrame, nodes: DataFrame, weight: float, bias: float) -> DataFrame:
    """A linear layer over each node with the weighted sum over its incoming edges, cut at 0."""
    y = summed(edges, nodes).join(nodes.select("graph_id", "node_id", "x"), ["graph_id", "node_id"])
    return y.select("graph_id", "node_id", F.greatest(F.lit(float(weight)) * (F.col("x") + F.col("y")) + bias, F.lit(0.0)).alias("y"))


def set2set(nodes: DataFrame, steps: int, w_in: list[list[float]], w_hidden: list[list[float]], bias: list[float], by: str = "graph_id") -> DataFrame:
    """``(by, y array<double>)`` of twice the vectors' length: in each of ``steps`` a recurrent cell asks, nodes ``v`` answer by the softmax
    of their product with the question, and both go into the next step. The weights stand for the cell's input, forget, new and
    output gates, one below the other. A step is one join by group and one aggregate; no group is gathered in one place."""
    d = len(w_hidden[0])
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    state = nodes.select(by).distinct().select(by, zeros(2 * d).alias("y"), zeros(d).alias("h"), zeros(d).alias("c"))
    sigmoid = lambda a: F.transform(a, lambda x: 1 / (1 + F.exp(-x)))
    for _ in range(steps):
        z = F.zip_with(matvec(w_in, F.col("y"), bias), matvec(w_hidden, F.col("h")), lambda a, b: a + b)
        gate = lambda k: F.slice("z", k * d + 1, d)
        s = state.withColumn("z", z).withColumn("c", F.zip_with(F.zip_with(sigmoid(gate(1)), "c", lambda a, b: a * b), F.zip_with(sigmoid(gate(0)), F.transform(gate(2), F.tanh), lambda a, b: a * b), lambda a, b: a + b))
        s = s.withColumn("h", F.zip_with(sigmoid(gate(3)), F.transform("c", F.tanh), lambda a, b: a * b)).select(by, "h", "c")
        e = nodes.select(by, "v").join(s.select(by, "h"), by).withColumn("s", dot(F.col("v"), F.col("h")))
        top = e.groupBy(by).agg(F.max("s").alias("m"))
        rows = e.join(top, by).withColumn("e", F.exp(F.col("s") - F.col("m"))).select(by, "e", F.posexplode("v").alias("place", "x"))
        part = rows.groupBy(by, "place").agg((F.sum(F.col("e") * F.col("x")) / F.sum("e")).alias("x"))
        answer = part.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda z: z["x"]).alias("r"))  # as many as the vector is long
        state = s.join(answer, by).select(by, F.concat("h", "r").alias("y"), "h", "c")
    return state.select(by, "y")


def dense_layer(nodes: DataFrame, weights: list[list[float]], bias: list[float] | None = None, activation: str | None = None) -> DataFrame:
    """``v`` through a layer of literal weights."""
    y = matvec(weights, F.col("v"), bias)
    if activation == "relu":
        y = F.transform(y, lambda z: F.greatest(z, F.lit(0.0)))
    return nodes.withColumn("v", y)


def mutual_information(scores: DataFrame) -> DataFrame:
    """``scores (score, positive)``: mean of ``ln 2 - softplus(-s)`` over positives less that of ``softplus(-s) + s - ln 2`` over others."""
    soft = F.log1p(F.exp(-F.abs("score"))) + F.greatest(-F.col("score"), F.lit(0.0))
    ln2 = F.log(F.lit(2.0))
    return scores.agg((F.avg(F.when(F.col("positive"), ln2 - soft)) - F.avg(F.when(~F.col("positive"), soft + F.col("score") - ln2))).alias("mi"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["rounded", "total"]
