"""Queries over batches of graphs, lookups and patterns."""

from pyspark.sql import functions as F

from spindrel.operators import graph as G
from spindrel.operators import schema as M
from spindrel.plans.registry import query
from spindrel.plans.views import chain, kg, pg_edges, pg_nodes, sql
from spindrel.session import table


def pg(s, d):
    return G.Graphs(pg_nodes(s, d), pg_edges(s, d))


E = ["graph_id", "node_in", "node_out", "weight"]


@query("graph_sizes", sql("WITH $pn, $pe, n AS (SELECT graph_id, count(*) AS num_node FROM pn GROUP BY 1), e AS (SELECT graph_id, count(*) AS num_edge FROM pe GROUP BY 1) SELECT graph_id, num_node, coalesce(num_edge, 0) AS num_edge FROM n LEFT JOIN e USING (graph_id)"))
def _(s, d):
    return pg(s, d).sizes()


@query("graph_offsets", sql("WITH $pn, $pe, n AS (SELECT graph_id, count(*) AS num_node FROM pn GROUP BY 1), e AS (SELECT graph_id, count(*) AS num_edge FROM pe GROUP BY 1), z AS (SELECT graph_id, num_node, coalesce(num_edge, 0) AS num_edge FROM n LEFT JOIN e USING (graph_id)) SELECT *, (coalesce(sum(num_node) OVER w, 0))::bigint AS node_offset, (coalesce(sum(num_edge) OVER w, 0))::bigint AS edge_offset FROM z WINDOW w AS (ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def _(s, d):
    return pg(s, d).offsets()


for side, end in (("in", "node_in"), ("out", "node_out")):

    @query(f"degree_{side}", sql(f"WITH $pn, $pe SELECT pn.graph_id, node_id, coalesce(sum(weight), 0) AS degree FROM pn LEFT JOIN pe ON pn.graph_id = pe.graph_id AND node_id = {end} GROUP BY 1, 2"))
    def _(s, d, side=side):
        return getattr(pg(s, d), f"degree_{side}")()


@query("node_mask", sql("WITH $pn, $pe SELECT pe.* FROM pe JOIN pn a ON a.graph_id = pe.graph_id AND a.node_id = node_in JOIN pn b ON b.graph_id = pe.graph_id AND b.node_id = node_out WHERE a.flag AND b.flag"))
def _(s, d):
    return pg(s, d).node_mask("flag").edges.select(E)


_SUB = "m AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS k FROM pn WHERE flag)"


@query("subgraph_edges", sql(f"WITH $pn, $pe, {_SUB} SELECT pe.graph_id, a.k AS node_in, b.k AS node_out, weight FROM pe JOIN m a ON a.graph_id = pe.graph_id AND a.node_id = node_in JOIN m b ON b.graph_id = pe.graph_id AND b.node_id = node_out"))
def _(s, d):
    return pg(s, d).subgraph("flag").edges.select(E)


@query("subgraph_nodes", sql(f"WITH $pn, {_SUB} SELECT graph_id, k AS node_id, value FROM m"))
def _(s, d):
    return pg(s, d).subgraph("flag").nodes.select("graph_id", "node_id", "value")


@query("edge_mask", sql("WITH $pe SELECT * FROM pe WHERE weight > 20"))
def _(s, d):
    return pg(s, d).edge_mask("weight > 20").edges.select(E)


_LIVE = "m AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS k FROM pn WHERE EXISTS (SELECT 1 FROM pe WHERE pe.graph_id = pn.graph_id AND node_id IN (node_in, node_out) AND weight > 0))"


@query("compact", sql(f"WITH $pn, $pe, {_LIVE} SELECT pe.graph_id, a.k AS node_in, b.k AS node_out, weight FROM pe JOIN m a ON a.graph_id = pe.graph_id AND a.node_id = node_in JOIN m b ON b.graph_id = pe.graph_id AND b.node_id = node_out"))
def _(s, d):
    return pg(s, d).compact().edges.select(E)


@query("graph_mask", sql("WITH $pe SELECT * FROM pe WHERE graph_id % 3 = 1"))
def _(s, d):
    g = pg(s, d)
    return g.graph_mask(g.nodes.where("graph_id % 3 = 1").select("graph_id").distinct()).edges.select(E)


@query("graph_mask_compact", sql("WITH $pn, $pe, m AS (SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 AS k FROM (SELECT DISTINCT graph_id FROM pn WHERE graph_id % 3 = 1)) SELECT k AS graph_id, node_in, node_out, weight FROM pe JOIN m USING (graph_id)"))
def _(s, d):
    g = pg(s, d)
    return g.graph_mask(g.nodes.where("graph_id % 3 = 1").select("graph_id"), compact=True).edges.select(E)


@query("repeated_index", sql("WITH $pe SELECT p AS graph_id, node_in, node_out, weight FROM pe JOIN (VALUES (0, 1), (1, 0), (2, 2), (3, 1), (4, 0)) x(p, g) ON g = graph_id"))
def _(s, d):
    i = s.createDataFrame([(0, 1), (1, 0), (2, 2), (3, 1), (4, 0)], "pos int, graph_id long")
    return pg(s, d).select_graphs(i).edges.select(F.col("graph_id").cast("int").alias("graph_id"), *E[1:])


@query("bipartite_slice", sql("WITH $pn, $pe SELECT pe.* FROM pe JOIN pn a ON a.graph_id = pe.graph_id AND a.node_id = node_in JOIN pn b ON b.graph_id = pe.graph_id AND b.node_id = node_out WHERE a.flag AND NOT b.flag"))
def _(s, d):
    return pg(s, d).bipartite("flag", "not flag").select(E)


@query("directed", sql("WITH $pe SELECT * FROM pe WHERE node_in <= node_out"))
def _(s, d):
    return pg(s, d).directed().edges.select(E)


@query("directed_strict", sql("WITH $pe SELECT graph_id, node_out AS node_in, node_in AS node_out, weight FROM pe WHERE node_out < node_in UNION ALL SELECT * FROM pe WHERE node_in < node_out"))
def _(s, d):
    return pg(s, d).undirected().directed(strict=True).edges.select(E)


@query("undirected", sql("WITH $pe SELECT * FROM pe UNION ALL SELECT graph_id, node_out, node_in, weight FROM pe"))
def _(s, d):
    return pg(s, d).undirected().edges.select(E)


def _kg_graph(s, d):
    k = kg(s, d).select(F.lit(0).cast("long").alias("graph_id"), F.col("h").alias("node_in"), F.col("t").alias("node_out"), F.col("r").alias("relation"), "weight")
    return G.Graphs(k.select("graph_id", F.col("node_in").alias("node_id")).unionByName(k.select("graph_id", F.col("node_out").alias("node_id"))).distinct(), k)


@query("undirected_inverse", sql("WITH $kg SELECT h AS node_in, r AS relation, t AS node_out, weight FROM kg UNION ALL SELECT t, r + 5, h, weight FROM kg"))
def _(s, d):
    return _kg_graph(s, d).undirected(relations=5).edges.select("node_in", "relation", "node_out", "weight")


@query("adjacency_coalesce", sql("WITH $kg SELECT h AS node_in, t AS node_out, sum(weight) AS weight FROM kg GROUP BY 1, 2"))
def _(s, d):
    g = _kg_graph(s, d)
    return G.Graphs(g.nodes, g.edges.drop("relation")).adjacency().select("node_in", "node_out", "weight")


@query("get_edge", sql("WITH $pe, q AS (SELECT graph_id, node_in, node_out FROM pe UNION ALL SELECT graph_id, node_out, node_in FROM pe) SELECT q.*, coalesce(weight, 0) AS weight FROM q LEFT JOIN pe USING (graph_id, node_in, node_out)"))
def _(s, d):
    # Every edge, and as many absent ones: no edge leads from a supplier to a customer.
    g = pg(s, d)
    q = g.edges.select("graph_id", "node_in", "node_out")
    return g.get_edges(q.unionByName(q.select("graph_id", F.col("node_out").alias("node_in"), F.col("node_in").alias("node_out")))).select(E)


@query("repeat_tile", sql("WITH $pn, $pe, m AS (SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 AS k, count(*) OVER () AS b FROM (SELECT DISTINCT graph_id FROM pn)) SELECT c.range * b + k AS graph_id, node_in, node_out, weight FROM pe JOIN m USING (graph_id), range(3) c"))
def _(s, d):
    return pg(s, d).repeat(3).edges.select(E)


@query("repeat_interleave", sql("WITH $pn, $pe, m AS (SELECT graph_id, row_number() OVER (ORDER BY graph_id, c.range) - 1 AS k FROM (SELECT DISTINCT graph_id FROM pn), range(4) c WHERE c.range < graph_id % 4) SELECT k AS graph_id, node_in, node_out, weight FROM pe JOIN m USING (graph_id)"))
def _(s, d):
    g = pg(s, d)
    return g.repeat_interleave(g.nodes.select("graph_id", (F.col("graph_id") % 4).alias("r")).distinct()).edges.select(E)


@query("split_by_label", sql("WITH $pn, $pe, l AS (SELECT *, node_id % 3 AS l FROM pn), p AS (SELECT graph_id, l, row_number() OVER (ORDER BY graph_id, l) - 1 AS part FROM (SELECT DISTINCT graph_id, l FROM l)), m AS (SELECT l.*, part, row_number() OVER (PARTITION BY part ORDER BY node_id) - 1 AS k FROM l JOIN p USING (graph_id, l)) SELECT a.part AS graph_id, a.k AS node_in, b.k AS node_out, weight FROM pe JOIN m a ON a.graph_id = pe.graph_id AND a.node_id = node_in JOIN m b ON b.graph_id = pe.graph_id AND b.node_id = node_out WHERE a.part = b.part"))
def _(s, d):
    return pg(s, d).split(F.col("node_id") % 3).edges.select(E)


@query("merge_graphs", sql("WITH $pn, $pe, m AS (SELECT *, row_number() OVER (PARTITION BY graph_id % 4 ORDER BY graph_id, node_id) - 1 AS k FROM pn) SELECT pe.graph_id % 4 AS graph_id, a.k AS node_in, b.k AS node_out, weight FROM pe JOIN m a ON a.graph_id = pe.graph_id AND a.node_id = node_in JOIN m b ON b.graph_id = pe.graph_id AND b.node_id = node_out"))
def _(s, d):
    g = pg(s, d)
    return g.merge(g.nodes.select("graph_id", (F.col("graph_id") % 4).alias("new_graph")).distinct()).edges.select(E)


@query("pack_batches", sql("WITH $pe, $pn SELECT * FROM pe UNION ALL SELECT graph_id + (SELECT max(graph_id) + 1 FROM pn), node_in, node_out, weight FROM pe WHERE weight > 30"))
def _(s, d):
    g = pg(s, d)
    return G.pack([g, g.edge_mask("weight > 30")]).edges.select(E)


@query("cat_common_attributes", sql("WITH $pn SELECT graph_id, node_id, value FROM pn UNION ALL SELECT graph_id + (SELECT max(graph_id) + 1 FROM pn), node_id, value FROM pn"))
def _(s, d):
    g = pg(s, d)
    return G.pack([g, G.Graphs(g.nodes.drop("flag"), g.edges)]).nodes


@query("pack_absolute_ids", sql("WITH $pn SELECT graph_id, node_id, row_number() OVER (ORDER BY graph_id, node_id) - 1 AS absolute FROM pn"))
def _(s, d):
    return G.absolute_ids(pg(s, d))


@query("full_graph", sql("WITH $chain SELECT a.graph_id, a.pos AS node_in, b.pos AS node_out, r AS relation FROM chain a JOIN chain b USING (graph_id), range(2) g(r)"))
def _(s, d):
    n = chain(s, d).withColumnRenamed("pos", "node_id")
    return G.Graphs(n, n.select("graph_id")).full(2)


@query("line_graph", sql("WITH $chain, e AS (SELECT graph_id, pos AS edge_id, residue_type % 5 AS node_in, q::bigint % 5 AS node_out FROM chain) SELECT a.graph_id, a.edge_id AS edge_a, b.edge_id AS edge_b FROM e a JOIN e b ON a.graph_id = b.graph_id AND a.node_out = b.node_in"))
def _(s, d):
    e = chain(s, d).select("graph_id", F.col("pos").alias("edge_id"), (F.col("residue_type") % 5).alias("node_in"), (F.col("q").cast("long") % 5).alias("node_out"))
    return G.Graphs(e.select("graph_id").distinct(), e).line_graph()


@query("virtual_node", sql("WITH $pn, $pe, v AS (SELECT graph_id, max(node_id) + 1 AS v FROM pn GROUP BY 1) SELECT * FROM pe UNION ALL SELECT graph_id, node_id, v, 1.0::double FROM pn JOIN v USING (graph_id) UNION ALL SELECT graph_id, v, node_id, 1.0::double FROM pn JOIN v USING (graph_id)"))
def _(s, d):
    return pg(s, d).virtual_node().edges.select(E)


@query("from_dense", "SELECT vec_id AS node_in, i AS node_out, round(x::double, 6) AS weight FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) WHERE x::double > 0.1 ")
def _(s, d):
    e = table(s, d, "embeddings").select(F.lit(0).cast("long").alias("graph_id"), F.col("vec_id").alias("node_in"), F.transform("embedding", lambda x: F.when(x.cast("double") > 0.1, x.cast("double")).otherwise(0.0)).alias("row"))
    return G.from_dense(e).select("node_in", "node_out", F.round("weight", 6).alias("weight"))


# -- patterns and lookups over the knowledge graph


# The distinct patterns of all triplets. A triplet agrees with one pattern of each kind, so the rows stay linear.


def _patterns(k, *kinds):
    x = lambda c: F.lit(-1).cast("long").alias(c)
    out = None
    for kind in kinds:
        p = k.select(*[F.col(c) if c in kind else x(c) for c in "hrt"]).distinct().withColumn("pattern_id", F.concat_ws(":", F.lit(kind), "h", "r", "t"))
        out = p if out is None else out.unionByName(p)
    return out


_ON = {c: f"kg.{c} = p.{c}" for c in "hrt"}


def _match_sql(kind):
    cols = ", ".join(c if c in kind else f"-1::bigint AS {c}" for c in "hrt")
    on = " AND ".join(_ON[c] for c in kind)
    return f"SELECT concat_ws(':', '{kind}', p.h, p.r, p.t) AS pattern_id, kg.h, kg.r, kg.t, kg.weight FROM kg JOIN (SELECT DISTINCT {cols} FROM kg) p ON {on}"


for kind in ("hr", "rt", "h", "t", "hrt", "ht"):

    @query(f"match_{kind}", sql(f"WITH $kg {_match_sql(kind)}"))
    def _(s, d, kind=kind):
        k = kg(s, d)
        return G.match(k, _patterns(k, kind), kinds=[kind])


@query("match_counts", sql(f"WITH $kg, m AS ({_match_sql('hr')} UNION ALL {_match_sql('rt')} UNION ALL {_match_sql('t')}) SELECT pattern_id, count(*) AS n FROM m GROUP BY 1"))
def _(s, d):
    k = kg(s, d)
    return G.match_counts(k, _patterns(k, "hr", "rt", "t"), kinds=["hr", "rt", "t"])


def _pairs(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("h"), (F.col("o_orderkey") % 5).alias("r")).distinct()


@query("dictionary_get_default", sql("WITH $kg, v AS (SELECT h, r, count(*) AS n FROM kg GROUP BY 1, 2), q AS (SELECT DISTINCT o_custkey AS h, o_orderkey % 5 AS r FROM orders) SELECT h, r, coalesce(n, 0) AS n FROM q LEFT JOIN v USING (h, r)"))
def _(s, d):
    return G.lookup(_pairs(s, d), kg(s, d).groupBy("h", "r").agg(F.count("*").alias("n")), ["h", "r"], "n", default=0)


@query("dictionary_get", sql("WITH $kg SELECT h, r, t, n FROM kg JOIN (SELECT h, r, count(*) AS n FROM kg GROUP BY 1, 2) USING (h, r)"))
def _(s, d):
    k = kg(s, d)
    return G.lookup(k.select("h", "r", "t"), k.groupBy("h", "r").agg(F.count("*").alias("n")), ["h", "r"], "n")


@query("dictionary_has_key", sql("WITH $kg, q AS (SELECT DISTINCT o_custkey AS h, o_orderkey % 5 AS r FROM orders) SELECT h, r, EXISTS (SELECT 1 FROM kg WHERE kg.h = q.h AND kg.r = q.r) AS found FROM q"))
def _(s, d):
    return G.has_key(_pairs(s, d), kg(s, d), ["h", "r"])


@query("known_truth_counts", sql("WITH $kg SELECT h, r, t, count(*) OVER (PARTITION BY h, r) AS known_tails, count(*) OVER (PARTITION BY r, t) AS known_heads FROM kg"))
def _(s, d):
    k = kg(s, d)
    n = k.groupBy("h", "r").agg(F.count("*").alias("known_tails"))
    m = k.groupBy("r", "t").agg(F.count("*").alias("known_heads"))
    return k.select("h", "r", "t").join(n, ["h", "r"]).join(m, ["r", "t"])


# -- tags and references


@query("reference_remap", "WITH m AS (SELECT n_nationkey AS old, row_number() OVER (ORDER BY n_nationkey) - 1 AS new FROM nation WHERE n_nationkey % 3 <> 0) SELECT c_custkey, coalesce(new, -1) AS ref FROM customer LEFT JOIN m ON c_nationkey = old")
def _(s, d):
    n = table(s, d, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    from pyspark.sql import Window

    index = n.withColumn("pos", (F.row_number().over(Window.orderBy("n_nationkey")) - 1).cast("long"))
    c = M.tag(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("ref")), ref="node reference")
    return M.remapped(c, "ref", M.mapping_of(index, "n_nationkey"))


@query("reference_check", "SELECT s_suppkey, s_nationkey::bigint AS ref FROM supplier WHERE s_nationkey % 3 = 0")
def _(s, d):
    n = table(s, d, "nation").where("n_nationkey % 3 <> 0")
    return M.bad_references(table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("ref")), "ref", n.select(F.col("n_nationkey").cast("long").alias("k")), "k").select("s_suppkey", "ref")


@query("meta_select", "SELECT c_custkey, c_acctbal FROM customer")
def _(s, d):
    c = M.tag(table(s, d, "customer"), c_custkey="node", c_acctbal="node", c_nationkey=["graph", "node reference"])
    return c.select(M.by_kind(c, include=["node"]))


@query("counts_from_edges", sql("WITH $pe SELECT graph_id, max(greatest(node_in, node_out)) + 1 AS num_node FROM pe GROUP BY 1"))
def _(s, d):
    return M.counts_from_edges(pg_edges(s, d)).select("graph_id", "num_node")


@query("residue_cascade_mask", sql("WITH $chain SELECT a.graph_id, a.pos AS node_in, b.pos AS node_out FROM chain a JOIN chain b ON a.graph_id = b.graph_id AND b.pos = a.pos + 1 WHERE a.residue_type < 10 AND b.residue_type < 10"))
def _(s, d):
    c = chain(s, d).withColumnRenamed("pos", "node_id")
    e = c.select("graph_id", F.col("node_id").alias("node_in"), (F.col("node_id") + 1).alias("node_out"))
    return G.Graphs(c, e).node_mask("residue_type < 10").edges.select("graph_id", "node_in", "node_out")
