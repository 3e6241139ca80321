"""Queries of graph construction, differences and statistics."""

from pyspark.sql import functions as F

from spindrel.functions.vectors import distance
from spindrel.operators import construct as K
from spindrel.operators import geometry as G
from spindrel.operators import message as P
from spindrel.operators import ragged as R
from spindrel.plans.registry import query
from spindrel.plans.views import chain, emb, kg, pg_edges, pg_nodes, sets, sql
from spindrel.session import table

_KEY = "('0x' || substr(md5(concat_ws('-', {})), 1, 8))::bigint"
_LAYERS = "SELECT a.graph_id, a.pos AS a, b.pos AS b, b.pos - a.pos + 1 AS relation FROM chain a JOIN chain b ON a.graph_id = b.graph_id AND abs(a.pos - b.pos) <= 1 UNION ALL SELECT a.graph_id, a.pos, b.pos, 3 FROM chain a JOIN chain b ON a.graph_id = b.graph_id AND a.residue_type = b.residue_type AND a.pos <> b.pos"


def _layers(s, d):
    c = chain(s, d)
    same = c.select("graph_id", "residue_type", F.col("pos").alias("a")).join(c.select("graph_id", "residue_type", F.col("pos").alias("b")), ["graph_id", "residue_type"]).where("a <> b").withColumn("relation", F.lit(0).cast("long"))
    return K.edge_layers([(G.sequential_pairs(c, 1), 3), (same, 1)])


@query("edge_layers", sql(f"WITH $chain {_LAYERS}"))
def _(s, d):
    return _layers(s, d)


@query("residue_edge_features", sql(f"WITH $chain, e AS ({_LAYERS}) SELECT e.*, x.residue_type AS type_a, y.residue_type AS type_b, least(abs(e.a - e.b), 4) AS gap FROM e JOIN chain x ON x.graph_id = e.graph_id AND x.pos = a JOIN chain y ON y.graph_id = e.graph_id AND y.pos = b"))
def _(s, d):
    return K.edge_features(_layers(s, d), chain(s, d), 4)


@query("reaction_difference", sql("WITH $kg, n AS (SELECT h, t, max(r) AS r FROM kg WHERE weight > 20 GROUP BY 1, 2), o AS (SELECT h, t, min(r) AS r FROM kg WHERE (h + t) % 3 <> 0 GROUP BY 1, 2) SELECT n.h, n.t, CASE WHEN o.r IS NULL THEN 'added' ELSE 'modified' END AS change FROM n LEFT JOIN o ON o.h = n.h AND o.t = n.t WHERE o.r IS NULL OR o.r <> n.r"))
def _(s, d):
    k = kg(s, d)
    return K.difference(k.where("weight > 20").groupBy("h", "t").agg(F.max("r").alias("r")), k.where("(h + t) % 3 <> 0").groupBy("h", "t").agg(F.min("r").alias("r")), ["h", "t"], "r")


@query("snake_prefixes", sql("WITH $sets, n AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1), k AS (SELECT set_id, unnest(range(n * n)) AS length FROM n), i AS (SELECT *, floor(sqrt(length))::bigint AS i FROM k) SELECT set_id, length, (i + 1) * (i + 1) - 1 - length AS unroll FROM i WHERE length >= i * i + i AND (i + 1) * (i + 1) - 1 - length <= 2"))
def _(s, d):
    return K.snake_prefixes(R.sizes_of(sets(s, d)), 2)


@query("mpnn_messages", sql("WITH $pn, $pe, x AS (SELECT graph_id, node_id, value / 1000 AS a, value / 2000 + 1 AS b FROM pn), m AS (SELECT pe.graph_id, node_out AS node_id, sum(weight * a + b) AS y0, sum(-a + 2 * weight * b) AS y1 FROM pe JOIN x ON x.graph_id = pe.graph_id AND x.node_id = node_in GROUP BY 1, 2) SELECT graph_id, node_id, 0::bigint AS place, round(y0, 7) AS y FROM m UNION ALL SELECT graph_id, node_id, 1::bigint, round(y1, 7) FROM m"))
def _(s, d):
    n = pg_nodes(s, d).select("graph_id", "node_id", F.array(F.col("value") / 1000, F.col("value") / 2000 + 1).alias("v"))
    e = pg_edges(s, d).withColumn("m", F.array(F.col("weight"), F.lit(1.0), F.lit(-1.0), 2 * F.col("weight")))
    return K.matrix_messages(e, n, 2).withColumn("y", F.round("y", 7))


@query("diffpool_features", sql("WITH $pn SELECT graph_id, node_id % 3 AS cluster, round(sum(value), 2) AS y FROM pn GROUP BY 1, 2"))
def _(s, d):
    return pg_nodes(s, d).groupBy("graph_id", (F.col("node_id") % 3).alias("cluster")).agg(F.round(F.sum("value"), 2).alias("y"))


@query("distance_targets", sql(f"WITH $emb SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(pow(a.v[1] - b.v[1], 2) + pow(a.v[2] - b.v[2], 2) + pow(a.v[3] - b.v[3], 2)), 6) AS distance FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1 WHERE {_KEY.format('5, a.vec_id, b.vec_id')} < 1288490188"))
def _(s, d):
    e = emb(s, d).select("vec_id", F.slice("v", 1, 3).alias("p"))
    pairs = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    drawn, _ = K.held_out_edges(pairs, 0.3, 5, "a", "b")
    j = drawn.join(e.toDF("a", "pa"), "a").join(e.toDF("b", "pb"), "b")
    return j.select("a", "b", F.round(distance(F.col("pa"), F.col("pb")), 6).alias("distance"))


@query("remaining_edges", sql(f"WITH $pe SELECT graph_id, node_in, node_out, weight FROM pe WHERE {_KEY.format('6, graph_id, node_in, node_out')} >= 858993459"))
def _(s, d):
    return K.held_out_edges(pg_edges(s, d), 0.2, 6, "graph_id", "node_in", "node_out")[1].select("graph_id", "node_in", "node_out", "weight")


@query("node_sizes", sql("WITH $pn, $pe, g AS (SELECT graph_id, node_in AS node_id, sum(weight) AS w FROM pe GROUP BY 1, 2) SELECT pn.graph_id, node_id, round(ln(1 + coalesce(w, 0)), 6) AS size FROM pn LEFT JOIN g USING (graph_id, node_id)"))
def _(s, d):
    from spindrel.operators.graph import Graphs

    return Graphs(pg_nodes(s, d), pg_edges(s, d)).degree_in().select("graph_id", "node_id", F.round(K.node_size(F.col("degree")), 6).alias("size"))


@query("kg_sample_weights", sql("WITH $kg SELECT h, r, t, round(1 / sqrt(count(*) OVER (PARTITION BY h, r) * count(*) OVER (PARTITION BY r, t)), 8) AS w FROM kg"))
def _(s, d):
    return K.sample_weights(kg(s, d).select("h", "r", "t")).select("h", "r", "t", F.round("w", 8).alias("w"))


@query("kg_statistics", sql("WITH $kg SELECT count(*) AS num_triplet, count(DISTINCT r) AS num_relation, (SELECT count(*) FROM (SELECT h FROM kg UNION SELECT t FROM kg)) AS num_entity FROM kg"))
def _(s, d):
    k = kg(s, d)
    e = k.select("h").union(k.select("t")).distinct().agg(F.count("*").alias("num_entity"))
    return k.agg(F.count("*").alias("num_triplet"), F.countDistinct("r").alias("num_relation")).crossJoin(F.broadcast(e))


@query("splits_by_column", "SELECT lower(trim(split)) AS part, count(DISTINCT sample_id) AS n FROM smiles WHERE split IS NOT NULL GROUP BY 1")
def _(s, d):
    return table(s, d, "smiles").where("split is not null").groupBy(F.lower(F.trim("split")).alias("part")).agg(F.countDistinct("sample_id").alias("n"))


@query("max_nodes_and_unroll", sql("WITH $pe SELECT max(n) AS max_node, max(u) AS max_unroll FROM (SELECT graph_id, count(*) AS n, max(abs(node_in - node_out)) AS u FROM pe GROUP BY 1)"))
def _(s, d):
    g = pg_edges(s, d).groupBy("graph_id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("node_in") - F.col("node_out"))).alias("u"))
    return g.agg(F.max("n").alias("max_node"), F.max("u").alias("max_unroll"))


@query("message_max", sql("WITH $pn, $pe, y AS (SELECT pe.graph_id, node_in AS node_id, max(value) AS y FROM pe JOIN pn ON pn.graph_id = pe.graph_id AND pn.node_id = node_out GROUP BY 1, 2) SELECT pn.graph_id, pn.node_id, coalesce(y, '-inf'::double) AS y FROM pn LEFT JOIN y USING (graph_id, node_id)"))
def _(s, d):
    n = pg_nodes(s, d).select("graph_id", "node_id", F.col("value").alias("x"))
    return P.spmm(pg_edges(s, d).withColumn("weight", F.lit(1.0)), n, "max")
