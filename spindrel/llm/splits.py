"""Splits that keep related records together.

Connected components by frontier breadth-first search: the adjacency lists are hash-partitioned, many seeds expand at once, and
the labels of seeds whose trees touch are merged in a graph of labels only, which is far smaller; that graph goes through the
same steps until it fits one task. Components are then dealt to the splits in the order of their hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrel.session import dropped, written

#: Edges up to which a graph of labels is solved in one task (two longs each, so some 32 MB).
ONE_TASK_EDGES = 1_000_000
#: Components larger than this part of the smallest split are placed before all others.
LARGE = 1 / 10


def star_links(keyed: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` that join all records with the same key. ``keyed``: ``id`` long, ``kind`` and ``key``; null ids and
    keys don't link.

    Every record is linked to the smallest record in its slice of the key, and that one to the smallest of the key: a record gives
    one link at most. There are as many slices as the root of the number of rows, so neither a slice of a key that all rows have
    nor the slices of it are more. All joins are on the sliced key.
    """
    k = written(keyed.where("id is not null and key is not null"), "keys")
    k = k.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, math.isqrt(k.count())))))
    hubs = k.groupBy("kind", "key", "part").agg(F.min("id").alias("hub"))
    roots = hubs.groupBy("kind", "key").agg(F.min("hub").alias("root"), F.count("*").alias("n"))
    up = hubs.join(roots.where("n > 1"), ["kind", "key"]).where("hub <> root").select(F.col("hub").alias("src"), F.col("root").alias("dst"))
    down = k.join(hubs, ["kind", "key", "part"]).where("id <> hub").select(F.col("id").alias("src"), F.col("hub").alias("dst"))
    return up.unionByName(down)


def _one_task(edges: DataFrame) -> DataFrame:
    """Union-find over a graph of bounded size, in one task: ``(id, component)`` with the smallest id as component."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while top.setdefault(root, root) != root:
                root = top[root]
            while top[x] != root:
                top[x], x = root, top[x]
            return root

        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                top[max(a, b)] = min(a, b)
        ids = list(top)
        return pd.DataFrame({"id": ids, "component": [find(x) for x in ids]}, dtype="int64")

    return edges.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: solve(pdf), "id long, component long")


def connected_components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``(id, component)`` for every id in ``edges (src, dst)``; the component is named by its smallest id. Self-links and repeated
    links are allowed, links with a null end are ignored; an empty table gives an empty one."""
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = edges.where("src is not null and dst is not null").select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    adj = written(both.repartition(n, "src"), "adjacency")
    # Seeds: nodes of which no neighbour has more links (ties by hash, then id). Every component has one, so every node is reached.
    rank = F.struct(F.col("deg"), F.xxhash64("src").alias("h"), F.col("src").alias("at"))
    deg = written(adj.groupBy("src").agg(F.count("*").alias("deg")).select("src", rank.alias("rank")), "degrees")
    best = adj.join(deg.withColumnRenamed("src", "dst"), "dst").groupBy("src").agg(F.max("rank").alias("best"))
    seeds = deg.join(best, "src").where("rank >= best").select(F.col("src").alias("id"), F.col("src").alias("label"))
    # Links to nodes that have a label are dropped as the search goes on, so a round reads only what is left.
    frontier = written(seeds, "frontier")
    reached, left = [frontier], adj
    while True:
        after = written(left.join(frontier.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "left")
        if left is not adj:
            dropped(left)
        left = after
        fresh = written(frontier.join(left, frontier["id"] == left["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("label")), "frontier")
        if fresh.isEmpty():
            break
        reached.append(fresh)
        frontier = fresh
    labels = reached[0]
    for x in reached[1:]:
        labels = labels.unionByName(x)
    labels = written(labels, "labels")
    for x in [*reached, deg, left]:
        dropped(x)
    # Trees that touch: links whose ends have different labels.
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    touching = adj.where("src < dst").join(a, "src").join(b, "dst").where("la <> lb").select(F.least("la", "lb").alias("src"), F.greatest("la", "lb").alias("dst")).distinct()
    touching = written(touching, "touching")
    merged = _one_task(touching) if touching.count() <= one_task_edges else connected_components(touching, one_task_edges)
    merged = merged.withColumnRenamed("id", "label")
    whole = labels.join(merged, "label", "left").withColumn("c", F.coalesce("component", "label")).select("id", "c")
    smallest = whole.groupBy("c").agg(F.min("id").alias("component"))
    return whole.join(smallest, "c").select("id", "component")


def linked_groups(records: DataFrame, id_col: str, keys: Iterable[tuple[str, DataFrame]], one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``(id, component)`` for every id of ``records``; ``keys`` names frames ``(id, key)`` whose equal keys link. Records without
    links are components of their own; null ids are left out."""
    keyed = None
    for kind, df in keys:
        k = df.select(F.col("id").cast("long").alias("id"), F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"))
        keyed = k if keyed is None else keyed.unionByName(k)
    comps = connected_components(star_links(keyed), one_task_edges)
    ids = records.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    return ids.join(comps, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def grouped_split(groups: DataFrame, proportions: Sequence[tuple[str, float]] = (("train", 0.8), ("valid", 0.1), ("test", 0.1)), bins: int = 4096, seed: int = 0) -> DataFrame:
    """``(id, component, split)``: whole components dealt to the splits in the order of their hashes, so that the splits' sizes are
    near the given proportions.

    All components are dealt in the order of their hashes but for those over a tenth of the smallest split (``LARGE``; fewer
    than 100 with 80/10/10): wherever their hash fell, they would move a boundary by as much, so they are placed first,
    largest first, each where most is missing. The others fill what is left: hashes fall into ``bins`` ranges, the totals of which (a fixed number
    of rows) give the ranges' starts; within its range a component starts after those with smaller hashes. No sort of all
    components in one task. An empty table gives an empty one.
    """
    names = [p for p, _ in proportions]
    weight = sum(w for _, w in proportions)
    share = [w / weight for _, w in proportions]
    sizes = written(groups.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(1.0, total * min(s for s in share if s > 0) * LARGE)
    left = [total * s for s in share]
    placed = []
    for r in sizes.where(F.col("n") > limit).orderBy(F.desc("n"), "component").collect():  # fewer than total / limit rows
        i = max(range(len(left)), key=lambda j: (left[j], -j))
        left[i] -= r["n"]
        placed.append((r["component"], names[i]))
    spark = groups.sparkSession
    big = spark.createDataFrame(placed, "component long, split string")
    left = [max(x, 0.0) for x in left]
    rest = sum(left) or 1.0
    small_total = total - sum(r for r in [sizes.where(F.col("n") > limit).agg(F.sum("n")).first()[0] or 0])
    bounds, acc = [], 0.0
    for x in left:
        acc += x / rest * small_total
        bounds.append(acc)
    h = F.xxhash64(F.lit(seed), F.col("component"))
    small = sizes.where(F.col("n") <= limit).withColumn("h", h).withColumn("bin", F.pmod(F.shiftright(h, 40), F.lit(bins)).cast("int"))
    totals = small.groupBy("bin").agg(F.sum("n").alias("bin_n"))
    starts = totals.withColumn("start", F.sum("bin_n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)))  # over `bins` rows
    inside = Window.partitionBy("bin").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce("start", F.lit(0)) + F.coalesce(F.sum("n").over(inside), F.lit(0))
    placed_small = small.join(F.broadcast(starts.select("bin", "start")), "bin").withColumn("at", at)
    pick = F.lit(names[-1])
    for name, bound in reversed(list(zip(names[:-1], bounds[:-1]))):
        pick = F.when(F.col("at") < bound, F.lit(name)).otherwise(pick)
    where = placed_small.select("component", pick.alias("split")).unionByName(big)
    return groups.join(where, "component").select("id", "component", "split")


def registry_keys(smiles: DataFrame, nodes: DataFrame) -> list[tuple[str, DataFrame]]:
    """The keys that link records of ``smiles``: depositor (letter case, spaces and hyphens ignored), source_ref, and the atom types
    of the molecule in the order of its nodes (repeated node rows once). Nulls, empty keys and absent nodes give no key."""
    blank = lambda c: F.when(c != "", c)
    s = smiles.withColumn("id", F.col("sample_id").cast("long"))
    dep = s.select("id", blank(F.regexp_replace(F.lower("depositor"), r"[\s\-\u00a0\u2010-\u2015]", "")).alias("key")).distinct()
    ref = s.select("id", blank(F.trim("source_ref")).alias("key")).distinct()
    listed = nodes.where("graph_id is not null and node_id is not null").groupBy(F.col("graph_id").cast("long").alias("id")).agg(F.sort_array(F.collect_set(F.struct("node_id", F.coalesce("atom_type", F.lit(-1)).alias("t")))).alias("a"))
    mol = listed.join(s.select("id").distinct(), "id", "left_semi").select("id", F.md5(F.concat_ws(",", F.transform("a", lambda x: x["t"].cast("string")))).alias("key"))
    return [("depositor", dep), ("source_ref", ref), ("molecule", mol)]


def read_split(c):
    """``split`` without letter case and surrounding white space; anything but train, valid and test is null."""
    v = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    return F.when(v.isin("train", "valid", "test"), v)
