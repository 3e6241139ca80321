"""Algorithms that go in rounds. Each round is one or two joins; its result is written to the shared folder, so plans don't grow
and a lost executor costs one round's tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrel.operators.ragged import key_of
from spindrel.session import dropped, maybe_broadcast, written


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, component)`` by alternating large and small stars over ``edges (a, b)``: each round links every node to the smallest
    of its neighbours, so the number of rounds grows with the logarithm of the diameter and stars, not hubs, carry the links.
    With ``nodes (id)`` isolated ones are components of their own."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "stars")
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small_low.select("a", F.col("m").alias("b"))).distinct()
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        old, e = e, written(small, "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(old)
        dropped(large)
        if now == mark:
            break
        mark = now
    out = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    roots = out.select(F.col("component").alias("id"), "component").distinct()
    out = out.unionByName(roots)
    if nodes is None:
        return out
    return nodes.select("id").distinct().join(out, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def hops(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """``(graph_id, node_id, hops)`` from ``roots (graph_id, node_id)`` along edges, up to ``most`` of them, or as far as they lead."""
    seen = frontier = roots.select("graph_id", "node_id").distinct().withColumn("hops", F.lit(0).cast("long"))
    e = edges.select("graph_id", F.col("node_in").alias("node_id"), "node_out")
    i = 0
    while most is None or i < most:
        i += 1
        nxt = frontier.join(e, ["graph_id", "node_id"]).select("graph_id", F.col("node_out").alias("node_id")).distinct()
        frontier = written(nxt.join(seen.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti").withColumn("hops", F.lit(i).cast("long")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def context(edges: DataFrame, roots: DataFrame, k: int, r1: int, r2: int) -> DataFrame:
    """``(graph_id, node_id, part)``: nodes within ``k`` hops of the root, those more than ``r1`` and up to ``r2`` hops away, and
    where both meet; graphs whose context is empty are left out."""
    h = hops(edges, roots, r2)
    sub = h.where(F.col("hops") <= k).select("graph_id", "node_id", F.lit("substructure").alias("part"))
    con = h.where((F.col("hops") > r1) & (F.col("hops") <= r2)).select("graph_id", "node_id", F.lit("context").alias("part"))
    anchor = h.where((F.col("hops") > r1) & (F.col("hops") <= k)).select("graph_id", "node_id", F.lit("anchor").alias("part"))
    live = con.select("graph_id").distinct()
    return sub.unionByName(con).unionByName(anchor).join(live, "graph_id", "left_semi")


def bfs_order(edges: DataFrame, roots: DataFrame, seed: int | None = None) -> DataFrame:
    """``(graph_id, node_id, place)``: nodes by hops from the root, then id, or with a ``seed`` in a repeatable random order within
    a hop; those not reached are left out, however far the others are."""
    h = hops(edges, roots)
    tie = [key_of(F.lit(seed), F.col("graph_id"), F.col("node_id"))] if seed is not None else []
    return h.select("graph_id", "node_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("hops", *tie, "node_id")) - 1).cast("long").alias("place"))


#: Edges that a cell of a walk's step holds on average, at most, and contributions that it adds up at a time.
CELL, ADDED = 1_000_000, 500_000


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``p * w`` by query and end, from rows ``(cell, side, a, b, w)`` by cell and side: edges (``a`` to ``b``), then states (``b`` of
    query ``a``) by query. Only a cell's edges and some queries' states are held."""
    cell, parts, ends, held = None, [], None, []

    def added(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        nonlocal ends
        if ends is None:
            a, b, w = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            order = np.argsort(a, kind="stable")
            ends = (a[order], b[order], w[order])
        a, b, w = ends
        query, node, p = (np.concatenate(x) for x in zip(*rows))
        lo, hi = np.searchsorted(a, node), np.searchsorted(a, node, side="right")
        upto = np.concatenate([[0], np.cumsum(hi - lo)])
        # Whole queries at a time, some ADDED contributions each.
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        stop = np.append(first[1:], len(query))
        k = 0
        while k < len(first):
            z = max(k + 1, int(np.searchsorted(upto[stop], upto[first[k]] + ADDED, side="right")))
            f, t = first[k], stop[z - 1]
            n = (hi - lo)[f:t]
            own = np.repeat(np.arange(f, t), n)
            at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + lo[own]
            q, e, x = query[own], b[at], p[own] * w[at]
            order = np.lexsort((e, q))
            q, e, x = q[order], e[order], x[order]
            new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (e[1:] != e[:-1])])) if len(q) else np.zeros(0, np.int64)
            if len(new):
                yield pa.RecordBatch.from_pydict({"query": pa.array(q[new]), "node_id": pa.array(e[new]), "p": pa.array(np.add.reduceat(x, new))})
            k = z

    for batch in batches:
        c, side, *row = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        cuts = [0, *(np.flatnonzero((np.diff(c) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(c)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if c[lo] != cell:
                if held:
                    yield from added(held)
                cell, parts, ends, held = c[lo], [], None, []
            mine = [x[lo:hi] for x in row]
            if side[lo] == 0:
                parts.append(mine)
                continue
            held.append(mine)
            # The last query may go on in the next batch.
            q = mine[0]
            done = int(np.searchsorted(q, q[-1]))
            if done or held[0][0][0] != q[-1]:
                rest = [x[done:] for x in mine]
                held[-1] = [x[:done] for x in mine]
                yield from added([r for r in held if len(r[0])])
                held = [rest]
    if held:
        yield from added(held)


def relational_walk(edges: DataFrame, heads: DataFrame, weights: list[list[float]]) -> DataFrame:
    """``(query, node_id, p)``: a walk from each of ``heads (query, node_id)``, one step a row of ``weights`` (a number for each
    relation), normed to 1 after each step.

    A step is a product of two tables far larger than both, so neither its terms nor their sums are moved: queries and ends are dealt to
    a grid of cells, states go to the cells of their query and edges to those of their end, and a cell has all terms of its sums.
    What a query's states add up to is known before, from the weights that leave a node."""
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = heads.select("query", "node_id", F.lit(1.0).alias("p"))
    for step in weights:
        state = written(state, "walk")
        w = F.element_at(F.array(*[F.lit(float(x)) for x in step]), F.col("relation").cast("int") + 1)
        near = maybe_broadcast(state.select("node_id").distinct())
        e = edges.select(F.col("node_in").alias("node_id"), "node_out", (w * F.col("weight")).alias("w")).join(near, "node_id", "left_semi")
        leaving = e.groupBy("node_id").agg(F.sum("w").alias("leaving"), F.count("*").alias("links"))
        leaving = written(leaving, "leaving")
        sums = state.join(leaving, "node_id").groupBy("query").agg(F.sum(F.col("p") * F.col("leaving")).alias("s")).where("s > 0")
        scaled = written(state.join(sums, "query").select("query", "node_id", (F.col("p") / F.col("s")).alias("p")), "walk")
        states, links = scaled.count(), leaving.agg(F.sum("links")).first()[0] or 0
        cells = max(n, -(-links // CELL))
        rows = min(cells, max(1, round((cells * states / max(1, links)) ** 0.5)))  # with as few copies of both as may be
        columns = -(-cells // rows)
        place = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        a = e.withColumn("k", every(rows)).select((F.col("k") * columns + place("node_out", columns)).cast("int").alias("cell"), F.lit(0).alias("side"), F.col("node_id").alias("a"), F.col("node_out").alias("b"), "w")
        b = scaled.withColumn("k", every(columns)).select((place("query", rows) * columns + F.col("k")).cast("int").alias("cell"), F.lit(1).alias("side"), F.col("query").alias("a"), F.col("node_id").alias("b"), F.col("p").alias("w"))
        dealt = a.unionByName(b).repartitionById(n, F.pmod("cell", F.lit(n)).cast("int")).sortWithinPartitions("cell", "side", "a")
        state = dealt.mapInArrow(_cells, "query long, node_id long, p double")
    return state


def pruned(edges: DataFrame) -> DataFrame:
    """Edges ``(graph_id, a, b)`` left after nodes with one neighbour have been taken away until none is left: rings and what
    links them."""
    e = written(edges.select("graph_id", "a", "b").distinct(), "core")
    while True:
        ends = e.select("graph_id", F.col("a").alias("n")).unionByName(e.select("graph_id", F.col("b").alias("n")))
        leaf = ends.groupBy("graph_id", "n").count().where("count = 1").select("graph_id", "n")
        nxt = e.join(leaf.withColumnRenamed("n", "a"), ["graph_id", "a"], "left_anti").join(leaf.withColumnRenamed("n", "b"), ["graph_id", "b"], "left_anti")
        old, e = e, written(nxt.select("graph_id", "a", "b"), "core")
        same = old.count() == e.count()
        dropped(old)
        if same:
            return e


def circular_fingerprint(nodes: DataFrame, edges: DataFrame, radius: int = 2, length: int = 1024) -> DataFrame:
    """``(graph_id, bit)``: hashes of each node's surroundings up to ``radius`` links, folded. ``nodes (graph_id, node_id, key)``,
    ``edges (graph_id, node_in, node_out, bond)`` in both directions. Not the bits of any other fingerprint."""
    state = written(nodes.select("graph_id", "node_id", F.xxhash64("key").alias("h")), "prints")
    bits = state.select("graph_id", "h")
    for i in range(1, radius + 1):
        # Sorted joins by hint: where atoms come from texts the planner takes them to be as few as those, and would broadcast them.
        m = edges.join(state.withColumnRenamed("node_id", "node_in").hint("merge"), ["graph_id", "node_in"]).groupBy("graph_id", F.col("node_out").alias("node_id"))
        around = m.agg(F.sort_array(F.collect_list(F.struct("bond", "h"))).alias("around"))
        state = written(state.join(around.hint("merge"), ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.xxhash64(F.lit(i), "h", F.to_json("around")).alias("h")), "prints")
        bits = bits.unionByName(state.select("graph_id", "h"))
    return bits.select("graph_id", F.pmod("h", F.lit(length)).alias("bit")).distinct()


def beam(start: DataFrame, expand, width: int, steps: int) -> DataFrame:
    """Beam search: ``start (query, state, score)``; ``expand(frontier)`` gives ``(query, state, score, stop)``. The best ``width`` go on
    in each step, what stops is kept; a state counts once a query, with its best score."""
    frontier, done = start, None
    for _ in range(steps):
        nxt = written(expand(frontier).select("query", "state", "score", "stop"), "beam")
        stopped = nxt.where("stop").select("query", "state", "score")
        done = stopped if done is None else done.unionByName(stopped)
        best = nxt.where("not stop").groupBy("query", "state").agg(F.max("score").alias("score"))
        w = Window.partitionBy("query").orderBy(F.desc("score"), "state")
        frontier = best.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= width).drop("_k")
    return done.groupBy("query", "state").agg(F.max("score").alias("score"))


def prefixes(sizes: DataFrame, step: int = 1) -> DataFrame:
    """``(set_id, prefix, n)``: every beginning of each set, ``step`` items longer each time, the empty one included."""
    return sizes.select("set_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size"), F.lit(step).cast("long"))).alias("prefix", "n")).select("set_id", F.col("prefix").cast("long").alias("prefix"), "n")
