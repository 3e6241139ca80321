"""Building graphs from layers of edges, features of edges, differences of two graphs, and prefixes of adjacency matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrel.operators.ragged import key_of


def edge_layers(layers: list[tuple[DataFrame, int]]) -> DataFrame:
    """Edges ``(graph_id, a, b, relation)`` of several builders, each with its number of relations; relations are shifted past those
    of the layers before."""
    out, base = None, 0
    for df, n in layers:
        d = df.select("graph_id", "a", "b", (F.col("relation") + base).alias("relation"))
        out = d if out is None else out.unionByName(d)
        base += n
    return out


def edge_features(edges: DataFrame, residues: DataFrame, gap: int) -> DataFrame:
    """Edges with the types of both residues and their distance along the chain, clipped at ``gap``."""
    r = lambda c: residues.select("graph_id", F.col("pos").alias(c), F.col("residue_type").alias(f"type_{c}"))
    j = edges.join(r("a"), ["graph_id", "a"]).join(r("b"), ["graph_id", "b"])
    return j.withColumn("gap", F.least(F.abs(F.col("a") - F.col("b")), F.lit(gap)))


def difference(new: DataFrame, old: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Entries of ``new`` that ``old`` lacks (``added``) or holds with another value (``modified``)."""
    o = old.select(*keys, F.col(value).alias("_old")).distinct()
    j = new.join(o, keys, "left")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_old") != F.col(value), "modified")
    return j.withColumn("change", kind).where("change is not null").select(*keys, "change")


def snake_prefixes(sizes: DataFrame, most: int) -> DataFrame:
    """``(set_id, length, unroll)``: lengths of adjacency matrices read shell by shell that end in the lower triangle, with at most
    ``most`` entries of their shell left. Only those are generated, at most ``most + 1`` a shell."""
    shells = sizes.where("size > 0").select("set_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("i"))
    k = shells.select("set_id", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("i"), F.lit(most).cast("long")))).alias("unroll"))
    return k.select("set_id", ((F.col("i") + 1) * (F.col("i") + 1) - 1 - F.col("unroll")).alias("length"), "unroll")


def matrix_messages(edges: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """``(graph_id, node_id, place, y)``: sum over incoming edges of each edge's matrix ``m`` (rows one behind the other) times ``v``."""
    x = nodes.select("graph_id", F.col("node_id").alias("node_in"), F.posexplode("v").alias("j", "x"))
    e = edges.select("graph_id", "node_in", "node_out", F.posexplode("m").alias("k", "m"))
    e = e.withColumn("place", F.floor(F.col("k") / dim)).withColumn("j", (F.col("k") % dim).cast("int")).drop("k")
    return e.join(x, ["graph_id", "node_in", "j"]).groupBy("graph_id", F.col("node_out").alias("node_id"), "place").agg(F.sum(F.col("m") * F.col("x")).alias("y"))


def held_out_edges(edges: DataFrame, share: float, seed: int, *ids: str) -> tuple[DataFrame, DataFrame]:
    """Edges parted repeatably: those drawn, about ``share`` of all, and the rest."""
    drawn = key_of(F.lit(seed), *[F.col(c) for c in ids]) < int(share * 4294967296)
    return edges.where(drawn), edges.where(~drawn)


def node_size(degree: Column) -> Column:
    """How large a node is drawn: the logarithm of its degree and one."""
    return F.log1p(degree)


def sample_weights(triplets: DataFrame) -> DataFrame:
    """Triplets with one over the root of how often their head and tail occur with their relation."""
    a = triplets.groupBy("h", "r").agg(F.count("*").alias("_a"))
    b = triplets.groupBy("r", "t").agg(F.count("*").alias("_b"))
    return triplets.join(a, ["h", "r"]).join(b, ["r", "t"]).withColumn("w", 1 / F.sqrt(F.col("_a") * F.col("_b"))).drop("_a", "_b")
