"""Proteins as two levels of tables: residues ``(graph_id, residue_id, ...)`` and atoms ``(graph_id, atom_id, residue_id, ...)``, and
choices of nodes for graphs of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.functions.vectors import distance
from spindrel.operators.ragged import key_of


def residue_atoms(query: DataFrame, atoms: DataFrame) -> DataFrame:
    """``(graph_id, pos, atom_id)``: the atoms of the residues of ``query (graph_id, pos, residue_id)``, in the order of the query; a
    residue asked for twice gives its atoms twice."""
    return query.join(atoms.select("graph_id", "residue_id", "atom_id"), ["graph_id", "residue_id"]).select("graph_id", "pos", "atom_id")


def residue_subset(residues: DataFrame, atoms: DataFrame, keep: Column | str) -> tuple[DataFrame, DataFrame]:
    """Residues that satisfy ``keep`` and their atoms, both numbered anew in the old order; atoms refer to the new residues."""
    w = lambda c: Window.partitionBy("graph_id").orderBy(c)
    r = residues.where(keep).withColumn("_r", (F.row_number().over(w("residue_id")) - 1).cast("long"))
    a = atoms.join(r.select("graph_id", "residue_id", "_r"), ["graph_id", "residue_id"])
    a = a.withColumn("_a", (F.row_number().over(w("atom_id")) - 1).cast("long"))
    a = a.drop("residue_id", "atom_id").withColumnsRenamed({"_r": "residue_id", "_a": "atom_id"})
    return r.drop("residue_id").withColumnRenamed("_r", "residue_id"), a


def residue_slice(residues: DataFrame, atoms: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> tuple[DataFrame, DataFrame]:
    """Every ``step``-th residue from ``start`` to before ``stop``, with their atoms; bounds below 0 count from the end."""
    n = residues.groupBy("graph_id").agg(F.count("*").alias("_n"))
    at = lambda x, none: F.lit(none) if x is None else F.lit(x) + (F.col("_n") if x < 0 else F.lit(0))
    lo, hi = F.greatest(at(start, 0), F.lit(0)), F.col("_n") if stop is None else at(stop, 0)
    keep = (F.col("residue_id") >= lo) & (F.col("residue_id") < hi) & (F.pmod(F.col("residue_id") - lo, F.lit(step)) == 0)
    r, a = residue_subset(residues.join(n, "graph_id"), atoms, keep)
    return r.drop("_n"), a


def view(residues: DataFrame, atoms: DataFrame, level: str) -> DataFrame:
    """``(graph_id, node_id, ...)``: the nodes of the level looked at, ``atom`` or ``residue``."""
    if level not in ("atom", "residue"):
        raise ValueError(f"unknown level: {level}")
    return atoms.withColumnRenamed("atom_id", "node_id") if level == "atom" else residues.withColumnRenamed("residue_id", "node_id")


def alpha_carbons(residues: DataFrame, atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Residues that have an alpha carbon, and one such atom of each (the first)."""
    ca = atoms.where((F.col("atom_name") == "CA") & F.col("residue_id").isNotNull()).groupBy("graph_id", "residue_id").agg(F.min("atom_id").alias("atom_id"))
    return residues.join(ca.select("graph_id", "residue_id"), ["graph_id", "residue_id"], "left_semi"), ca


def subspace(nodes: DataFrame, entity_level: int, least_radius: float, seed: int = 0) -> DataFrame:
    """Nodes near a random one of their graph: nearer than one and a half times the distance of its ``entity_level``-th nearest (itself
    the first), or than ``least_radius`` if that is more. Graphs of fewer nodes take their farthest. ``nodes (graph_id, node_id, position)``."""
    pick = nodes.groupBy("graph_id").agg(F.min_by(F.struct("position"), F.struct(key_of(F.lit(seed), F.col("graph_id"), F.col("node_id")), "node_id")).alias("c"))
    d = nodes.join(pick, "graph_id").withColumn("_d", distance(F.col("position"), F.col("c.position"))).drop("c")
    w = Window.partitionBy("graph_id").orderBy("_d", "node_id")
    near = d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= entity_level).groupBy("graph_id").agg(F.max("_d").alias("_r"))
    return d.join(near, "graph_id").where(F.col("_d") < F.greatest(1.5 * F.col("_r"), F.lit(least_radius))).drop("_d", "_r")


def without_ids(samples: DataFrame, name: str, ids: DataFrame, id_col: str = "id", mark: str = "_") -> DataFrame:
    """Samples whose name, up to the first ``mark``, isn't in ``ids``."""
    k = F.split(F.col(name), mark)[0]
    return samples.withColumn("_k", k).join(ids.select(F.col(id_col).alias("_k")), "_k", "left_anti").drop("_k")


def paired_residues(samples: DataFrame, symbols: str) -> DataFrame:
    """``(sample_id, side, pos, residue_type)`` of samples of two sequences ``(sample_id, sequence_1, sequence_2)``."""
    from spindrel.functions.sequence import residues_of

    both = samples.select("sample_id", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("sequence_1").alias("s")), F.struct(F.lit(2).alias("side"), F.col("sequence_2").alias("s")))).alias("x"))
    r = residues_of(both.select(F.struct("sample_id", "x.side").alias("graph_id"), F.col("x.s").alias("sequence")), symbols)
    return r.select("graph_id.sample_id", "graph_id.side", "pos", "residue_type")


def pair_head(pairs: DataFrame, weights: tuple[float, float], bias: float) -> DataFrame:
    """Logit of pairs ``(..., x, y)`` from their product and their difference's size."""
    return pairs.withColumn("logit", F.lit(float(weights[0])) * F.col("x") * F.col("y") + F.lit(float(weights[1])) * F.abs(F.col("x") - F.col("y")) + F.lit(float(bias)))
