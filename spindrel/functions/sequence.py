"""Descriptors of residue chains: dipeptide deviations and autocorrelations of properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.session import maybe_broadcast

# Residues by their id, and how many of the 61 sense codons stand for each.
RESIDUES = "GASPVTCILNDQKEMHFRYW"
CODONS = {"A": 4, "C": 2, "D": 2, "E": 2, "F": 2, "G": 4, "H": 2, "I": 3, "K": 2, "L": 6, "M": 1, "N": 2, "P": 4, "Q": 2, "R": 6, "S": 6, "T": 4, "V": 4, "W": 1, "Y": 2}


def dipeptide_deviation(chain: DataFrame, occurring: bool = False) -> DataFrame:
    """``(graph_id, a, b, dde)`` for all 400 pairs of residues of each chain of two or more: the share of a pair among its neighbours
    (0 for those that don't occur) less the one the code expects, over its deviation. With ``occurring`` only pairs that occur."""
    w = Window.partitionBy("graph_id").orderBy("pos")
    pairs = chain.select("graph_id", F.col("residue_type").alias("a"), F.lead("residue_type").over(w).alias("b")).where("b is not null")
    if occurring:
        n = pairs.groupBy("graph_id", "a", "b").agg(F.count("*").alias("k"))
        total = n.groupBy("graph_id").agg(F.sum("k").alias("n"))
        return n.join(total, "graph_id").select("graph_id", "a", "b", dde_of(F.col("k") / F.col("n"), F.col("n"), F.col("a"), F.col("b")).alias("dde"))
    cell = (F.col("a") * len(RESIDUES) + F.col("b")).cast("int")
    k = pairs.groupBy("graph_id", cell.alias("cell")).agg(F.count("*").alias("k")).groupBy("graph_id")
    found = k.agg(F.sum("k").alias("n"), F.map_from_entries(F.collect_list(F.struct("cell", "k"))).alias("ks"))  # 400 entries at most
    grid = found.select("graph_id", "n", "ks", F.explode(F.sequence(F.lit(0), F.lit(len(RESIDUES) ** 2 - 1))).alias("cell"))
    a, b = F.floor(F.col("cell") / len(RESIDUES)), (F.col("cell") % len(RESIDUES)).cast("long")
    share = F.coalesce(F.try_element_at("ks", F.col("cell")), F.lit(0)) / F.col("n")
    return grid.select("graph_id", a.alias("a"), b.alias("b"), dde_of(share, F.col("n"), a, b).alias("dde"))


def dde_of(share: Column, n: Column, a: Column, b: Column) -> Column:
    c = F.array(*[F.lit(CODONS[x]) for x in RESIDUES])
    mean = (F.element_at(c, a.cast("int") + 1) * F.element_at(c, b.cast("int") + 1)) / (61.0 * 61.0)
    return (share - mean) / F.sqrt(mean * (1 - mean) / n)


def _lagged(chain: DataFrame, lags: int) -> DataFrame:
    a = chain.select("graph_id", "pos", "x").withColumn("lag", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(lags).cast("long"))))
    b = chain.select("graph_id", F.col("pos").alias("_p"), F.col("x").alias("y"))
    return a.withColumn("_p", F.col("pos") + F.col("lag")).join(b, ["graph_id", "_p"]).select("graph_id", "lag", "x", "y")


def autocorrelation(chain: DataFrame, lags: int, kind: str) -> DataFrame:
    """``(graph_id, lag, value)`` of a property ``x`` along chains ``(graph_id, pos, x)``: ``moran``, ``geary`` or ``broto``.
    Lags that a chain is too short for, and chains without variance, give no row or null."""
    m = chain.groupBy("graph_id").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.var_samp("x").alias("vs"))
    j = _lagged(chain, lags).join(m, "graph_id")
    if kind == "broto":
        e = F.avg(F.col("x") * F.col("y"))
    elif kind == "moran":
        e = F.try_divide(F.avg((F.col("x") - F.col("m")) * (F.col("y") - F.col("m"))), F.first("v"))
    elif kind == "geary":
        e = F.try_divide(F.avg(F.pow(F.col("x") - F.col("y"), 2)) / 2, F.first("vs"))
    else:
        raise ValueError(f"unknown kind: {kind}")
    return j.groupBy("graph_id", "lag").agg(e.alias("value"))


def standardised(properties: DataFrame, eps: float = 1e-10) -> DataFrame:
    """``(residue_type, property, x)``: each property less its mean over residues, over its sample deviation; null values are 0 before.
    A row a residue and property."""
    v = properties.select("residue_type", "property", F.coalesce("value", F.lit(0.0)).alias("v"))
    s = v.groupBy("property").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return v.join(s, "property").select("residue_type", "property", ((F.col("v") - F.col("m")) / (F.col("s") + eps)).alias("x"))


def property_autocorrelation(chain: DataFrame, properties: DataFrame, lags: int, kind: str) -> DataFrame:
    """``(graph_id, property, lag, value)``: :func:`autocorrelation` of every property of :func:`standardised` along chains of residues."""
    p = standardised(properties)
    x = chain.select("graph_id", "pos", "residue_type").join(maybe_broadcast(p), "residue_type")
    out = autocorrelation(x.select(F.struct("graph_id", "property").alias("graph_id"), "pos", "x"), lags, kind)
    return out.select("graph_id.graph_id", "graph_id.property", "lag", "value")


def truncated(chain: DataFrame, length: int, start: Column | None = None) -> DataFrame:
    """The first ``length`` residues of each chain, or those from ``start`` on; positions count from 0 again."""
    s = start if start is not None else F.lit(0).cast("long")
    return chain.withColumn("_s", s).where((F.col("pos") >= F.col("_s")) & (F.col("pos") < F.col("_s") + length)).withColumn("pos", F.col("pos") - F.col("_s")).drop("_s")


def sequence_text(chain: DataFrame, symbols: str) -> DataFrame:
    """``(graph_id, sequence)`` of residue types by their symbols; unknown types are X."""
    a = F.array(*[F.lit(c) for c in symbols])
    letter = F.when(F.col("residue_type").between(0, len(symbols) - 1), F.element_at(a, F.col("residue_type").cast("int") + 1)).otherwise("X")
    z = chain.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("pos", letter.alias("c")))).alias("z"))
    return z.select("graph_id", F.concat_ws("", F.transform("z", lambda x: x["c"])).alias("sequence"))


def residues_of(sequences: DataFrame, symbols: str) -> DataFrame:
    """``(graph_id, pos, residue_type)`` of texts ``(graph_id, sequence)``; unknown symbols are type 0."""
    r = sequences.where(F.length("sequence") > 0).select("graph_id", F.posexplode(F.split("sequence", "")).alias("pos", "c")).where("c <> ''")
    return r.select("graph_id", F.col("pos").cast("long").alias("pos"), F.greatest(F.expr(f"instr('{symbols}', c) - 1"), F.lit(0)).cast("long").alias("residue_type"))
