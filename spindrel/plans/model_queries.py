"""Queries of layers, losses and results of models."""

from pyspark.sql import functions as F

from spindrel.functions import scores as C
from spindrel.operators import message as P
from spindrel.operators import sampling as S
from spindrel.operators import schema as M
from spindrel.plans.registry import query
from spindrel.plans.views import chain, emb, kg, pg_edges, pg_nodes, pred, sql

_KEY = "('0x' || substr(md5(concat_ws('-', {})), 1, 8))::bigint"
_X = "x AS (SELECT graph_id, node_id, value / 1000 AS x FROM pn)"


def _nodes(s, d):
    return pg_nodes(s, d).select("graph_id", "node_id", (F.col("value") / 1000).alias("x"))


_MEAN = "m AS (SELECT avg(v[1]) AS a, avg(v[2]) AS b, avg(v[3]) AS c, count(*) AS n FROM emb), x AS (SELECT vec_id, v[1] - a AS a, v[2] - b AS b, v[3] - c AS c, n FROM emb, m)"


def _cols(df):
    return df.select("vec_id", *[F.round(F.col("v")[k], 6).alias(f"y{k}") for k in range(3)])


@query("pair_norm_vectors", sql(f"WITH $emb, {_MEAN}, q AS (SELECT sqrt(sum(a * a + b * b + c * c)) AS q FROM x) SELECT vec_id, round(a * sqrt(n) / (q + 1e-8), 6) AS y0, round(b * sqrt(n) / (q + 1e-8), 6) AS y1, round(c * sqrt(n) / (q + 1e-8), 6) AS y2 FROM x, q"))
def _(s, d):
    return _cols(P.pair_norm_vectors(emb(s, d).select("vec_id", F.slice("v", 1, 3).alias("v"))))


@query("pair_norm_each", sql(f"WITH $emb, {_MEAN}, q AS (SELECT *, sqrt(a * a + b * b + c * c) + 1e-8 AS q FROM x) SELECT vec_id, round(a / q, 6) AS y0, round(b / q, 6) AS y1, round(c / q, 6) AS y2 FROM q"))
def _(s, d):
    return _cols(P.pair_norm_vectors(emb(s, d).select("vec_id", F.slice("v", 1, 3).alias("v")), each=True))


@query("fingerprint_layer", sql(f"WITH $pn, $pe, {_X}, y AS (SELECT pe.graph_id, node_out AS node_id, sum(weight * x) AS y FROM pe JOIN x ON x.graph_id = pe.graph_id AND x.node_id = node_in GROUP BY 1, 2) SELECT x.graph_id, x.node_id, round(greatest(0.5 * (x + coalesce(y, 0)) - 1, 0), 6) AS y FROM x LEFT JOIN y USING (graph_id, node_id)"))
def _(s, d):
    return P.fingerprint_layer(pg_edges(s, d), _nodes(s, d), 0.5, -1.0).withColumn("y", F.round("y", 6))


@query("message_edge_features", sql(f"WITH $pn, $pe, {_X}, y AS (SELECT pe.graph_id, node_out AS node_id, sum(weight * (x + weight / 10)) AS y FROM pe JOIN x ON x.graph_id = pe.graph_id AND x.node_id = node_in GROUP BY 1, 2) SELECT x.graph_id, x.node_id, round(coalesce(y, 0), 5) AS y FROM x LEFT JOIN y USING (graph_id, node_id)"))
def _(s, d):
    return P.summed(pg_edges(s, d).withColumn("f", F.col("weight") / 10), _nodes(s, d), feature="f").withColumn("y", F.round("y", 5))


@query("gat_heads", sql(f"WITH $pn, $pe, {_X}, lp AS (SELECT graph_id, node_in, node_out, weight FROM pe UNION ALL SELECT graph_id, node_id, node_id, 1 FROM x), m AS (SELECT lp.*, head, i.x AS xi, a * o.x + b * i.x AS s FROM lp JOIN x i ON i.graph_id = lp.graph_id AND i.node_id = node_in JOIN x o ON o.graph_id = lp.graph_id AND o.node_id = node_out, (VALUES (0, 0.3, 0.7), (1, -0.2, 0.1)) h(head, a, b)), l AS (SELECT *, CASE WHEN s > 0 THEN s ELSE 0.2 * s END AS z FROM m), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY head, graph_id, node_out)) * weight AS e FROM l) SELECT head, graph_id, node_out AS node_id, round(sum(e * xi) / sum(e), 6) AS y FROM e GROUP BY ALL"))
def _(s, d):
    e, n = pg_edges(s, d), _nodes(s, d)
    heads = [P.attention(e, n, a, b).withColumn("head", F.lit(k)) for k, (a, b) in enumerate(((0.3, 0.7), (-0.2, 0.1)))]
    return heads[0].unionByName(heads[1]).withColumn("y", F.round("y", 6))


@query("policy_objective", sql("WITH $emb SELECT vec_id, round(v[1] * v[2], 8) AS y FROM emb"))
def _(s, d):
    return emb(s, d).select("vec_id", F.round(C.policy_objective(F.col("v")[0], F.col("v")[1]), 8).alias("y"))


@query("distance_model_score", sql("WITH $emb SELECT a.vec_id, round(12 - (abs(a.v[1] + 0.1 - b.v[1]) + abs(a.v[2] - 0.1 - b.v[2])), 6) AS score FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1"))
def _(s, d):
    e = emb(s, d).select("vec_id", F.slice("v", 1, 2).alias("v"))
    j = e.select("vec_id", F.col("v").alias("h")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("t")), "vec_id")
    score = C.model_score(C.transe(F.col("h"), F.array(F.lit(0.1), F.lit(-0.1)), F.col("t")))
    return j.select("vec_id", F.round(score, 6).alias("score"))


@query("cubic_penalty", sql("WITH $emb, r AS (SELECT unnest(v) AS x, vec_id FROM emb UNION ALL SELECT unnest(v), -vec_id - 1 FROM emb WHERE vec_id < 5) SELECT round(sum(pow(abs(x), 3)), 5) AS penalty, round(sum(pow(abs(x), 3)) / count(DISTINCT vec_id), 8) AS per_vector FROM r"))
def _(s, d):
    e = emb(s, d)
    return C.cubic_penalty(e, e.where("vec_id < 5")).select(F.round("penalty", 5).alias("penalty"), F.round("per_vector", 8).alias("per_vector"))


@query("strict_negative_heads", sql(f"WITH $kg, ent AS (SELECT unnest(range((SELECT max(h) + 1 FROM kg))) AS e), free AS (SELECT tr.t, tr.r, e, row_number() OVER (PARTITION BY tr.t, tr.r ORDER BY e) - 1 AS place, count(*) OVER (PARTITION BY tr.t, tr.r) AS n FROM (SELECT DISTINCT t, r FROM kg) tr, ent WHERE NOT EXISTS (SELECT 1 FROM kg k WHERE k.t = tr.t AND k.r = tr.r AND k.h = e)) SELECT kg.h, kg.r, kg.t, g.range AS draw, free.e AS negative FROM kg, range(1) g, free WHERE free.t = kg.t AND free.r = kg.r AND free.place = {_KEY.format('9, kg.t, kg.r, kg.h, g.range')} % free.n"))
def _(s, d):
    k = kg(s, d).select(F.col("t").alias("h"), "r", F.col("h").alias("t"))
    x = S.strict_negatives(k, k, k.agg(F.max("t")).first()[0] + 1, 1, 9)
    return x.select(F.col("t").alias("h"), "r", F.col("h").alias("t"), "draw", "negative")


@query("edge_negatives", sql(f"WITH $chain, n AS (SELECT graph_id, count(*) AS n FROM chain GROUP BY 1), d AS (SELECT graph_id, k AS draw, {_KEY.format(chr(39).join(['4, ', 'a', ', graph_id, k']))} % n AS a, {_KEY.format(chr(39).join(['4, ', 'b', ', graph_id, k']))} % n AS b FROM (SELECT *, unnest(range(3)) AS k FROM n)) SELECT graph_id, draw, a, b FROM d WHERE b <> a + 1"))
def _(s, d):
    c = chain(s, d)
    e = c.select("graph_id", F.col("pos").alias("node_in"), (F.col("pos") + 1).alias("node_out"))
    return S.edge_negatives(e, c.groupBy("graph_id").agg(F.count("*").alias("size")), 3, 4)


@query("merged_best", sql("WITH $pred, u AS (SELECT id, score FROM pred WHERE set_id < 2 UNION ALL SELECT id, score / 2 FROM pred WHERE set_id > 0) SELECT id, max(score) AS score FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"))
def _(s, d):
    p = pred(s, d)
    return S.merged_best(p.where("set_id < 2").select("id", "score"), p.where("set_id > 0").select("id", (F.col("score") / 2).alias("score")), "id", "score", 50)


@query("wrong_lengths", sql("WITH $chain, n AS (SELECT graph_id, count(*) AS n FROM chain GROUP BY 1), k AS (SELECT graph_id, count(*) AS k FROM chain WHERE q > 5 GROUP BY 1) SELECT graph_id, coalesce(k, 0) AS rows, n AS wanted FROM n LEFT JOIN k USING (graph_id) WHERE coalesce(k, 0) <> n"))
def _(s, d):
    c = chain(s, d)
    return M.wrong_lengths(c.where("q > 5"), c.groupBy("graph_id").agg(F.count("*").alias("n")), ["graph_id"], "n")
