"""Tags of columns: what level they belong to, and which hold references to rows of another level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("node", "edge", "graph", "residue", "atom", "bond")
KINDS = (*LEVELS, *(f"{x} reference" for x in LEVELS))


def tag(df: DataFrame, **columns: str | list[str]) -> DataFrame:
    """``df`` whose named columns carry the given kinds (such as ``node`` or ``node reference``) in their metadata."""
    for c, kinds in columns.items():
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if bad := [k for k in kinds if k not in KINDS]:
            raise ValueError(f"unknown kinds: {bad}")
        df = df.withMetadata(c, {"kinds": sorted(kinds)})
    return df


def kinds(df: DataFrame, column: str) -> set[str]:
    return set(df.schema[column].metadata.get("kinds", []))


def by_kind(df: DataFrame, include: list[str] | None = None, exclude: list[str] = ()) -> list[str]:
    """Tagged columns whose kinds all are in ``include`` (all kinds by default) and none in ``exclude``."""
    allowed = set(include or KINDS) - set(exclude)
    return [c for c in df.columns if kinds(df, c) and kinds(df, c) <= allowed]


def bad_references(df: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is neither -1, null nor a key of ``targets``."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != -1)).join(targets.select(F.col(key).alias(column)), column, "left_anti")


def wrong_lengths(df: DataFrame, sizes: DataFrame, by: list[str], size: str) -> DataFrame:
    """``(by..., rows, wanted)`` where ``df`` hasn't as many rows as ``sizes`` says."""
    n = df.groupBy(*by).agg(F.count("*").alias("rows"))
    j = sizes.select(*by, F.col(size).alias("wanted")).join(n, by, "full").fillna(0, ["rows", "wanted"])
    return j.where("rows <> wanted").select(*by, "rows", "wanted")


def remapped(df: DataFrame, column: str, mapping: DataFrame, on: list[str] = ()) -> DataFrame:
    """``df`` with a reference replaced by ``mapping (on..., old, new)``, -1 where its target is gone."""
    m = mapping.select(*on, F.col("old").alias(column), F.col("new").alias("_new"))
    return df.join(m, [*on, column], "left").withColumn(column, F.coalesce("_new", F.lit(-1).cast("long"))).select(df.columns)


def selection(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` by ``index (pos, key)``, in the order of ``pos``; a repeated index is an error when a mapping is asked for."""
    return index.join(df, key).orderBy("pos")


def mapping_of(index: DataFrame, key: str) -> DataFrame:
    """``(old, new)`` of a selection; an index that stands twice is an error."""
    n = F.count("*").over(Window.partitionBy(key))
    return index.select(F.col(key).alias("old"), F.when(n == 1, F.col("pos")).otherwise(F.raise_error(F.lit("repeated index")).cast("long")).alias("new"))


def counts_from_edges(edges: DataFrame) -> DataFrame:
    """Numbers of nodes and relations that the edges need: the largest id and one more."""
    r = F.max("relation") + 1 if "relation" in edges.columns else F.lit(None).cast("long")
    return edges.groupBy("graph_id").agg((F.max(F.greatest("node_in", "node_out")) + 1).alias("num_node"), r.alias("num_relation"))
