"""Batches of graphs as tables.

``graphs (graph_id, ...)``, ``nodes (graph_id, node_id, ...)`` and ``edges (graph_id, node_in, node_out[, relation], weight, ...)``;
ids are local to their graph and offsets are never stored. An edge leads from ``node_in`` to ``node_out``. Every column is carried
through a selection; columns tagged as references (see :mod:`spindrel.operators.schema`) are remapped, and -1 where their target is gone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.operators.ordered import numbered, running


def _renumber(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


@dataclass(frozen=True)
class Graphs:
    """A batch of graphs; all members are lazy."""

    nodes: DataFrame
    edges: DataFrame

    # -- counts and degrees

    def sizes(self) -> DataFrame:
        """``(graph_id, num_node, num_edge)``; graphs without edges included."""
        n = self.nodes.groupBy("graph_id").agg(F.count("*").alias("num_node"))
        e = self.edges.groupBy("graph_id").agg(F.count("*").alias("num_edge"))
        return n.join(e, "graph_id", "left").fillna(0, ["num_edge"])

    def offsets(self) -> DataFrame:
        """Cumulative counts over the batch in the order of ``graph_id``."""
        r = running(self.sizes().withColumn("_t", F.lit(0).cast("long")), "graph_id", "_t", {"node_offset": F.col("num_node"), "edge_offset": F.col("num_edge")})
        return r.withColumn("node_offset", F.col("node_offset") - F.col("num_node")).withColumn("edge_offset", F.col("edge_offset") - F.col("num_edge")).drop("_t")

    def degree_in(self) -> DataFrame:
        """Weighted number of edges that leave a node (grouped by ``node_in``); 0 for nodes without any."""
        return self._degree("node_in")

    def degree_out(self) -> DataFrame:
        """Weighted number of edges that reach a node (grouped by ``node_out``)."""
        return self._degree("node_out")

    def _degree(self, end: str) -> DataFrame:
        d = self.edges.groupBy("graph_id", F.col(end).alias("node_id")).agg(F.sum("weight").alias("degree"))
        return self.nodes.select("graph_id", "node_id").join(d, ["graph_id", "node_id"], "left").fillna(0.0, ["degree"])

    # -- selections

    def _kept_edges(self, ids: DataFrame) -> DataFrame:
        k = ids.select("graph_id", "node_id")
        return self.edges.join(k.withColumnRenamed("node_id", "node_in"), ["graph_id", "node_in"], "left_semi").join(k.withColumnRenamed("node_id", "node_out"), ["graph_id", "node_out"], "left_semi")

    def node_mask(self, keep: Column | str) -> Graphs:
        """Edges whose ends both satisfy ``keep`` (a condition on ``nodes``); nodes and ids stay."""
        return replace(self, edges=self._kept_edges(self.nodes.where(keep)))

    def subgraph(self, keep: Column | str, order: list | None = None) -> Graphs:
        """The nodes that satisfy ``keep`` and the edges between them, nodes numbered anew from 0 in ``order``."""
        kept = _renumber(self.nodes.where(keep), ["graph_id"], order or ["node_id"], "new_id")
        return Graphs(kept.drop("node_id").withColumnRenamed("new_id", "node_id"), self._relabelled(self._kept_edges(kept), kept))

    @staticmethod
    def _relabelled(edges: DataFrame, mapping: DataFrame) -> DataFrame:
        """``edges`` with both ends replaced by ``mapping (graph_id, node_id, new_id)``; edges with an end that has no new id go."""
        m = mapping.select("graph_id", "node_id", "new_id")
        for end in ("node_in", "node_out"):
            edges = edges.join(m.withColumnRenamed("node_id", end), ["graph_id", end]).drop(end).withColumnRenamed("new_id", end)
        return edges

    def edge_mask(self, keep: Column | str) -> Graphs:
        return replace(self, edges=self.edges.where(keep))

    def compact(self) -> Graphs:
        """Without nodes whose edges weigh nothing; numbered anew."""
        e = self.edges
        d = e.select("graph_id", F.col("node_in").alias("node_id"), "weight").unionByName(e.select("graph_id", F.col("node_out").alias("node_id"), "weight"))
        live = d.groupBy("graph_id", "node_id").agg(F.sum("weight").alias("_w")).where("_w > 0").select("graph_id", "node_id")
        return Graphs(self.nodes.join(live, ["graph_id", "node_id"], "left_semi"), self.edges).subgraph(F.lit(True))

    def graph_mask(self, keep: DataFrame, compact: bool = False) -> Graphs:
        """The graphs in ``keep (graph_id)``; with ``compact`` numbered anew in the order of their ids."""
        if not compact:
            return Graphs(self.nodes.join(keep, "graph_id", "left_semi"), self.edges.join(keep, "graph_id", "left_semi"))
        return self._regraphed(numbered(keep.select("graph_id").distinct(), "graph_id", name="new_graph"))

    def select_graphs(self, index: DataFrame) -> Graphs:
        """Graphs by ``index (pos, graph_id)``, in any order and as often as they stand there; ``pos`` becomes the graph id."""
        return self._regraphed(index.select("graph_id", F.col("pos").cast("long").alias("new_graph")))

    def _regraphed(self, m: DataFrame) -> Graphs:
        swap = lambda df: df.join(m, "graph_id").drop("graph_id").withColumnRenamed("new_graph", "graph_id")
        return Graphs(swap(self.nodes), swap(self.edges))

    def bipartite(self, heads: Column | str, tails: Column | str) -> DataFrame:
        """Edges from a node that satisfies ``heads`` to one that satisfies ``tails``."""
        h = self.nodes.where(heads).select("graph_id", F.col("node_id").alias("node_in"))
        t = self.nodes.where(tails).select("graph_id", F.col("node_id").alias("node_out"))
        return self.edges.join(h, ["graph_id", "node_in"], "left_semi").join(t, ["graph_id", "node_out"], "left_semi")

    def directed(self, strict: bool = False) -> Graphs:
        """Edges that lead upwards; loops stay unless ``strict``."""
        return self.edge_mask(F.col("node_in") < F.col("node_out") if strict else F.col("node_in") <= F.col("node_out"))

    def undirected(self, relations: int | None = None) -> Graphs:
        """With each edge's reverse (loops too); with ``relations`` the reverse has its relation shifted by that number."""
        back = self.edges.withColumnsRenamed({"node_in": "_o", "node_out": "node_in"}).withColumnRenamed("_o", "node_out")
        if relations is not None:
            back = back.withColumn("relation", F.col("relation") + relations)
        return replace(self, edges=self.edges.unionByName(back))

    def adjacency(self) -> DataFrame:
        """Coalesced entries: repeated edges added up."""
        keys = [c for c in ("graph_id", "node_in", "node_out", "relation") if c in self.edges.columns]
        return self.edges.groupBy(*keys).agg(F.sum("weight").alias("weight"))

    def get_edges(self, pairs: DataFrame) -> DataFrame:
        """Summed weight for each of ``pairs (graph_id, node_in, node_out)``, 0 where there is no edge."""
        return pairs.join(self.adjacency() if "relation" not in self.edges.columns else self.edges.groupBy("graph_id", "node_in", "node_out").agg(F.sum("weight").alias("weight")), ["graph_id", "node_in", "node_out"], "left").fillna(0.0, ["weight"])

    # -- batches

    def repeat(self, count: int) -> Graphs:
        """The batch ``count`` times, copy by copy."""
        m = self.nodes.select("graph_id").distinct()
        m = numbered(m, "graph_id", name="g").crossJoin(F.broadcast(m.agg(F.count("*").alias("b"))))
        m = m.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count > 0 else m.limit(0).withColumn("copy", F.lit(0))
        return self._regraphed(m.select("graph_id", (F.col("copy") * F.col("b") + F.col("g")).cast("long").alias("new_graph")))

    def repeat_interleave(self, repeats: DataFrame) -> Graphs:
        """Each graph as often as ``repeats (graph_id, r)`` says, graph by graph; 0 drops it."""
        m = repeats.where("r > 0").select("graph_id", F.explode(F.sequence(F.lit(1), F.col("r").cast("int"))).alias("k"))
        return self._regraphed(numbered(m, "graph_id", "k", "new_graph").drop("k"))

    def split(self, label: Column | str) -> Graphs:
        """Nodes of each graph parted by a numeric label; edges between parts go, parts are numbered by graph and label."""
        lab = F.col(label) if isinstance(label, str) else label
        n = self.nodes.withColumn("_l", lab)
        parts = numbered(n.select("graph_id", "_l").distinct(), "graph_id", "_l", "part")
        n = _renumber(n.join(parts, ["graph_id", "_l"]), ["part"], ["node_id"], "new_id")
        m = n.select("graph_id", "node_id", "new_id", "part")
        e = self.edges.join(m.toDF("graph_id", "node_in", "a", "part"), ["graph_id", "node_in"]).join(m.toDF("graph_id", "node_out", "b", "part"), ["graph_id", "node_out", "part"])
        e = e.drop("graph_id", "node_in", "node_out").withColumnsRenamed({"a": "node_in", "b": "node_out", "part": "graph_id"})
        return Graphs(n.drop("graph_id", "node_id", "_l").withColumnsRenamed({"part": "graph_id", "new_id": "node_id"}), e)

    def merge(self, groups: DataFrame) -> Graphs:
        """Graphs with the same ``groups (graph_id, new_graph)`` become one; nodes are numbered by old graph and node."""
        n = _renumber(self.nodes.join(groups, "graph_id"), ["new_graph"], ["graph_id", "node_id"], "new_id")
        e = self._relabelled(self.edges, n).join(groups, "graph_id").drop("graph_id").withColumnRenamed("new_graph", "graph_id")
        return Graphs(n.drop("graph_id", "node_id").withColumnsRenamed({"new_graph": "graph_id", "new_id": "node_id"}), e)

    def full(self, relations: int | None = None) -> DataFrame:
        """All pairs of nodes of each graph, loops included, for each relation. Its size is that of the result."""
        n = self.nodes.select("graph_id", "node_id")
        e = n.withColumnRenamed("node_id", "node_in").join(n.withColumnRenamed("node_id", "node_out"), "graph_id")
        return e if relations is None else e.withColumn("relation", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(relations - 1).cast("long"))))

    def line_graph(self) -> DataFrame:
        """Edges become nodes: ``(graph_id, edge_a, edge_b)`` where one ends at the node the other starts from. ``edges`` needs
        ``edge_id``; loops and reverse edges count."""
        a = self.edges.select("graph_id", F.col("edge_id").alias("edge_a"), F.col("node_out").alias("mid"))
        b = self.edges.select("graph_id", F.col("edge_id").alias("edge_b"), F.col("node_in").alias("mid"))
        return a.join(b, ["graph_id", "mid"]).select("graph_id", "edge_a", "edge_b")

    def virtual_node(self) -> Graphs:
        """With one more node in each graph, linked both ways with every other, under a relation of its own."""
        top = self.nodes.groupBy("graph_id").agg((F.max("node_id") + 1).alias("node_id"))
        rel = self.edges.groupBy("graph_id").agg((F.max("relation") + 1).alias("relation")) if "relation" in self.edges.columns else None
        spokes = self.nodes.select("graph_id", F.col("node_id").alias("node_in")).join(top.withColumnRenamed("node_id", "node_out"), "graph_id")
        both = spokes.unionByName(spokes.select("graph_id", F.col("node_out").alias("node_in"), F.col("node_in").alias("node_out"))).withColumn("weight", F.lit(1.0))
        if rel is not None:
            both = both.join(rel, "graph_id", "left").fillna(0, ["relation"])
        return Graphs(self.nodes.unionByName(top, allowMissingColumns=True), self.edges.unionByName(both, allowMissingColumns=True))


def pack(parts: list[Graphs]) -> Graphs:
    """Batches one behind the other; their graph ids are shifted past each other. Columns that all have survive."""
    from functools import reduce

    out, base = [], 0
    for p in parts:
        shift = lambda df, b=base: df.withColumn("graph_id", F.col("graph_id") + b)
        out.append(Graphs(shift(p.nodes), shift(p.edges)))
        base += (p.nodes.agg(F.max("graph_id")).first()[0] or 0) + 1
    common = lambda dfs: [c for c in dfs[0].columns if all(c in x.columns for x in dfs)]
    cn, ce = common([p.nodes for p in out]), common([p.edges for p in out])
    return Graphs(reduce(lambda a, b: a.unionByName(b), [p.nodes.select(cn) for p in out]), reduce(lambda a, b: a.unionByName(b), [p.edges.select(ce) for p in out]))


def from_dense(rows: DataFrame) -> DataFrame:
    """``(graph_id, node_in, row array<double>)`` as edges of the entries that aren't 0."""
    return rows.select("graph_id", "node_in", F.posexplode("row").alias("node_out", "weight")).where("weight <> 0").withColumn("node_out", F.col("node_out").cast("long"))


def absolute_ids(g: Graphs) -> DataFrame:
    """``(graph_id, node_id, absolute)``: node numbers over the whole batch, for output only."""
    n = _renumber(g.nodes.select("graph_id", "node_id"), ["graph_id"], ["node_id"], "k")
    return n.join(g.offsets().select("graph_id", "node_offset"), "graph_id").select("graph_id", "node_id", (F.col("k") + F.col("node_offset")).alias("absolute"))


def unpacked(packed: DataFrame, offsets: DataFrame, block: int = 4096) -> DataFrame:
    """Rows of a packed batch ``(absolute, ...)`` with their graph and their id within it: ``offsets (graph_id, node_offset, num_node)``
    says where graphs begin. Both sides meet in blocks of the numbering, so no range join is needed; empty graphs hold no row."""
    o = offsets.where("num_node > 0").select("graph_id", F.col("node_offset").alias("_a"), (F.col("node_offset") + F.col("num_node")).alias("_z"))
    o = o.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor((F.col("_z") - 1) / block))))
    j = packed.withColumn("_b", F.floor(F.col("absolute") / block)).join(o, "_b").where("absolute >= _a and absolute < _z")
    return j.withColumn("node_id", F.col("absolute") - F.col("_a")).drop("_a", "_z", "_b", "absolute")


def batches(df: DataFrame, order: str, size: int, shuffle_seed: int | None = None) -> DataFrame:
    """``df`` with ``batch_id`` and ``place``: batches of ``size`` rows in the order of a unique numeric column, or in a repeatable random
    one; numbered in ranges, never in one task."""
    from spindrel.operators.ragged import key_of

    if shuffle_seed is None:
        d = numbered(df, order, name="_n")
    else:
        d = numbered(df.withColumn("_k", key_of(F.lit(shuffle_seed), F.col(order))), "_k", order, "_n").drop("_k")
    return d.withColumn("batch_id", F.floor(F.col("_n") / size)).withColumn("place", F.col("_n") % size).drop("_n")


def at_positions(df: DataFrame, order: str, index: DataFrame) -> DataFrame:
    """Rows of ``df``, counted from 0 in the order of a unique numeric column, that ``index (pos, at)`` asks for, as often as it does."""
    return numbered(df, order, name="at").join(index, "at").drop("at")


def pooled(parts: list[DataFrame], by: list[str], value: str, how: str = "sum") -> DataFrame:
    """One aggregate of ``value`` over several tables: ``sum``, ``mean``, ``min``, ``max`` or ``product``."""
    from functools import reduce

    f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "product": F.product}[how]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*by, value) for p in parts]).groupBy(*by).agg(f(value).alias(value))


def as_map(table: DataFrame, key: str, value: str, by: list[str]) -> DataFrame:
    """A dictionary as one map for each of ``by``; for groups that fit a row."""
    return table.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("map"))


def match(edges: DataFrame, patterns: DataFrame, cols: tuple[str, ...] = ("h", "r", "t"), kinds: list[str] | None = None) -> DataFrame:
    """``(pattern_id, edge columns)`` of the edges that agree with a pattern, -1 standing for anything. One equi-join for each kind
    of pattern (which columns are fixed); a pattern of wildcards only is refused. ``kinds`` names the kinds where they are known, such
    as ``["hr", "t"]``; patterns of other kinds are an error then."""
    from functools import reduce
    from itertools import product

    fixed = {c: F.col(f"p_{c}") >= 0 for c in cols}
    p = patterns.select("pattern_id", *[F.col(c).alias(f"p_{c}") for c in cols])
    out = []
    for kind in product((True, False), repeat=len(cols)):
        mine = reduce(lambda a, b: a & b, [fixed[c] if on else ~fixed[c] for c, on in zip(cols, kind)])
        keys = [c for c, on in zip(cols, kind) if on]
        if kinds is not None and keys and "".join(keys) not in kinds:
            continue
        if kinds is not None and not keys:
            mine = ~F.concat(*[F.when(fixed[c], c).otherwise("") for c in cols]).isin(kinds)
        if not keys:
            bad = F.raise_error(F.lit("a pattern needs a fixed part")).cast(dict(p.dtypes)["pattern_id"])
            out.append(p.where(mine).select(bad.alias("pattern_id"), *[F.lit(None).cast(k).alias(c) for c, k in edges.dtypes]))
            continue
        mine_p = p.where(mine).select("pattern_id", *[F.col(f"p_{c}").alias(c) for c in keys])
        out.append(edges.join(mine_p, keys).select("pattern_id", *edges.columns))
    return reduce(lambda a, b: a.unionByName(b), out)


def match_counts(edges: DataFrame, patterns: DataFrame, kinds: list[str], cols: tuple[str, ...] = ("h", "r", "t")) -> DataFrame:
    """``(pattern_id, n)``: how many edges agree with each pattern, patterns without any left out. Edges are read once and counted a
    kind and key before they meet the patterns, in one join for all kinds; ``kinds`` as in :func:`match`."""
    wild = {c: F.lit(-1).cast(dict(edges.dtypes)[c]) for c in cols}
    each = F.explode(F.array(*[F.struct(*[F.col(c) if c in k else wild[c].alias(c) for c in cols]) for k in kinds])).alias("k")
    n = edges.select(each).groupBy(*[F.col(f"k.{c}").alias(c) for c in cols]).agg(F.count("*").alias("n"))
    return patterns.select("pattern_id", *cols).join(n, list(cols)).select("pattern_id", "n")


def lookup(keys: DataFrame, table: DataFrame, on: list[str], value: str, default=None) -> DataFrame:
    """``keys`` with the value of ``table`` under each; without ``default`` a missing key is an error."""
    found = table.select(*on, F.col(value).alias("_v"), F.lit(True).alias("_has"))
    v = F.when(F.col("_has"), F.col("_v")).otherwise(F.lit(default) if default is not None else F.raise_error(F.lit("missing key")).cast(dict(table.dtypes)[value]))
    return keys.join(found, on, "left").withColumn(value, v).drop("_v", "_has")


def has_key(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    return keys.join(table.select(*on).distinct().withColumn("found", F.lit(True)), on, "left").fillna(False, ["found"])
