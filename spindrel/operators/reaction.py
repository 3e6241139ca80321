"""Reactions as tables of bonds between mapped atoms: centres, the parts a product falls into, and ranked predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrel.operators.iterative import components


def centres(product: DataFrame, reactant: DataFrame) -> DataFrame:
    """``(graph_id, a, b)``: the bond that a reaction makes, if it makes one only, else the one it changes, if it changes one only;
    reactions with neither have no row. ``product`` and ``reactant (graph_id, a, b, bond)``: bonds of mapped atoms, ``a < b``."""
    old = reactant.select("graph_id", "a", "b", F.col("bond").alias("_o"), F.lit(True).alias("_has"))
    d = product.join(old, ["graph_id", "a", "b"], "left").where("_has is null or _o <> bond").select("graph_id", "a", "b", F.col("_has").isNull().alias("made"))
    one = d.groupBy("graph_id", "made").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.min("b").alias("b"))
    any_made = F.max(F.col("made").cast("int")).over(Window.partitionBy("graph_id"))
    return one.withColumn("_m", any_made).where("n = 1 and (made or _m = 0)").select("graph_id", "a", "b")


def synthons(product: DataFrame, centre: DataFrame, stride: int = 1 << 20) -> DataFrame:
    """``(graph_id, node_id, synthon)``: the parts that products fall into without their centre, named by their greatest atom map.
    ``product (graph_id, a, b)``; products without a centre are left out. Atom maps are below ``stride``."""
    e = product.join(centre.select("graph_id").distinct(), "graph_id", "left_semi")
    kept = e.join(centre, ["graph_id", "a", "b"], "left_anti")
    key = lambda c: F.col("graph_id") * stride + F.col(c)
    nodes = e.select(key("a").alias("id")).unionByName(e.select(key("b").alias("id"))).distinct()
    c = components(kept.select(key("a").alias("a"), key("b").alias("b")), nodes)
    last = c.groupBy("component").agg(F.max("id").alias("last"))
    j = c.join(last, "component")
    return j.select(F.floor(F.col("id") / stride).alias("graph_id"), (F.col("id") % stride).alias("node_id"), (F.col("last") % stride).alias("synthon"))


def mapped_nodes(reactant: DataFrame, synthon: DataFrame) -> DataFrame:
    """Nodes of the reactant with the synthon's node of the same atom map: ``(graph_id, node_id, synthon_node, is_new, is_modified)``;
    map 0 is no map. Both: ``(graph_id, node_id, atom_map, kind)``."""
    s = synthon.where("atom_map > 0").select("graph_id", "atom_map", F.col("node_id").alias("synthon_node"), F.col("kind").alias("_k"))
    j = reactant.join(s, ["graph_id", "atom_map"], "left")
    return j.select("graph_id", "node_id", "synthon_node", F.col("synthon_node").isNull().alias("is_new"), F.coalesce(F.col("kind") != F.col("_k"), F.lit(False)).alias("is_modified"))


def best_products(splits: DataFrame, predictions: DataFrame, k: int) -> DataFrame:
    """The ``k`` best reactant sets of each product: ``splits (product, split, logp)`` with one or two synthons, whose ``predictions
    (split, synthon, reactant, logp)`` are combined, one of each synthon: ``(product, place, split, first, second, logp)``."""
    p = predictions.select("split", "synthon", "reactant", F.col("logp").alias("l"))
    n = p.groupBy("split").agg(F.countDistinct("synthon").alias("n"))
    a, b = p.toDF("split", "s1", "first", "l1"), p.toDF("split", "s2", "second", "l2")
    two = a.join(b, "split").where("s1 < s2").select("split", "first", "second", (F.col("l1") + F.col("l2")).alias("l"))
    one = p.join(n.where("n = 1"), "split").select("split", F.col("reactant").alias("first"), F.lit(None).cast(dict(p.dtypes)["reactant"]).alias("second"), "l")
    every = splits.join(two.unionByName(one), "split").withColumn("logp", F.col("logp") + F.col("l")).drop("l")
    w = Window.partitionBy("product").orderBy(F.desc("logp"), "split", "first", F.col("second").asc_nulls_first())
    return every.withColumn("place", (F.row_number().over(w) - 1).cast("long")).where(F.col("place") < k).select("product", "place", "split", "first", "second", "logp")


def first_hits(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """``(query, rank)``: the place, from 1, of the first of ``predictions (query, place, answer)`` that is the target's; null for none."""
    j = targets.select("query", F.col("answer").alias("_t")).join(predictions, "query", "left")
    return j.groupBy("query").agg((F.min(F.when(F.col("answer") == F.col("_t"), F.col("place"))) + 1).alias("rank"))


def top_accuracy(hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    return hits.agg(*[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"top_{k}") for k in ks])
