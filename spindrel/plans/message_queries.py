"""Queries of message passing, readouts, pooling and triplet scores."""

import math

from pyspark.sql import functions as F

from spindrel.functions import scores as C
from spindrel.functions.vectors import rounded
from spindrel.operators import message as P
from spindrel.plans.registry import query
from spindrel.plans.views import emb, kg, pg_edges, pg_nodes, sql
from spindrel.session import table


def nodes(s, d):
    return pg_nodes(s, d).select("graph_id", "node_id", (F.col("value") / 1000).alias("x"))


def r6(df, c="y", n=6):
    return df.withColumn(c, F.round(c, n))


_X = "x AS (SELECT graph_id, node_id, value / 1000 AS x FROM pn)"
_SQL_AGG = {"add": ("sum", "0"), "min": ("min", "'inf'::double"), "max": ("max", "'-inf'::double"), "mean": ("avg", "0")}

for add, (agg, empty) in _SQL_AGG.items():
    for mul, op in (("mul", "*"), ("add", "+")):

        @query(f"spmm_{add}_{mul}", sql(f"WITH $pn, $pe, {_X}, y AS (SELECT pe.graph_id, node_in AS node_id, {agg}(weight {op} x) AS y FROM pe JOIN x ON x.graph_id = pe.graph_id AND x.node_id = node_out GROUP BY 1, 2) SELECT x.graph_id, x.node_id, round(coalesce(y, {empty}), 9) AS y FROM x LEFT JOIN y USING (graph_id, node_id)"))
        def _(s, d, add=add, mul=mul):
            return r6(P.spmm(pg_edges(s, d), nodes(s, d), add, mul), n=9)

        @query(f"rspmm_{add}_{mul}", sql(f"WITH $kg, n AS (SELECT DISTINCT h AS i FROM kg UNION SELECT t FROM kg), x AS (SELECT i, i % 17 - 8.0::double AS x FROM n), y AS (SELECT h AS i, {agg}(weight * ((r - 2.0::double) {op} x)) AS y FROM kg JOIN x ON i = t GROUP BY 1) SELECT i AS node_id, round(coalesce(y, {empty}), 4) AS y FROM n LEFT JOIN y USING (i)"))
        def _(s, d, add=add, mul=mul):
            k = kg(s, d).withColumnsRenamed({"h": "node_in", "t": "node_out", "r": "relation"})
            n = k.select(F.col("node_in").alias("node_id")).union(k.select("node_out")).distinct()
            rel = s.range(5).select(F.col("id").alias("relation"), (F.col("id") - 2.0).alias("w"))
            return r6(P.rspmm(k, rel, n.withColumn("x", F.col("node_id") % 17 - 8.0), add, mul), n=4)


for how, agg in (("sum", "sum"), ("mean", "avg"), ("max", "max")):

    @query(f"readout_{how}", sql(f"WITH $pn, {_X} SELECT graph_id, round({agg}(x), 6) AS y FROM x GROUP BY 1"))
    def _(s, d, how=how):
        return r6(P.readout(nodes(s, d), how))

    @query(f"readout_vectors_{how}", sql(f"WITH $emb, e AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS place FROM emb) SELECT label, place::int AS place, round({agg}(x), 6) AS y FROM e GROUP BY 1, 2"))
    def _(s, d, how=how):
        return r6(P.readout_vectors(emb(s, d), how, "label"))


_ATT = "e AS (SELECT label, vec_id, v, 3 * v[1] - 2 * v[2] + 0.5 AS s FROM emb), w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label)) AS w FROM e), u AS (SELECT label, w, unnest(v) AS x, unnest(range(64)) AS place FROM w)"


@query("attention_readout", sql(f"WITH $emb, {_ATT} SELECT label, place::int AS place, round(sum(w * x) / sum(w), 6) AS y FROM u GROUP BY 1, 2"))
def _(s, d):
    return r6(P.attention_readout(emb(s, d), [3.0, -2.0] + [0.0] * 62, 0.5, "label"))


@query("readout_softmax", sql(f"WITH $pn, {_X}, e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY graph_id)) AS e FROM x) SELECT graph_id, node_id, round(e / (sum(e) OVER (PARTITION BY graph_id) + 1e-10), 8) AS p FROM e"))
def _(s, d):
    return r6(P.softmax_readout(nodes(s, d)).drop("x"), "p", 8)


@query("instance_norm", sql(f"WITH $pn, {_X} SELECT graph_id, node_id, round((x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5), 6) AS x FROM x WINDOW w AS (PARTITION BY graph_id)"))
def _(s, d):
    return r6(P.instance_norm(nodes(s, d)), "x").select("graph_id", "node_id", "x")


@query("pair_norm", sql(f"WITH $pn, {_X} SELECT graph_id, node_id, round((x - avg(x) OVER ()) / sqrt(var_pop(x) OVER () + 1e-8), 6) AS x FROM x"))
def _(s, d):
    return r6(P.pair_norm(nodes(s, d)), "x").select("graph_id", "node_id", "x")


_IN = "SELECT pe.graph_id, node_out AS node_id, sum(weight * x) AS y FROM pe JOIN x ON x.graph_id = pe.graph_id AND x.node_id = node_in GROUP BY 1, 2"


@query("message_sum", sql(f"WITH $pn, $pe, {_X}, y AS ({_IN}) SELECT x.graph_id, x.node_id, round(coalesce(y, 0), 5) AS y FROM x LEFT JOIN y USING (graph_id, node_id)"))
def _(s, d):
    return r6(P.summed(pg_edges(s, d), nodes(s, d)), n=5)


@query("message_mean", sql(f"WITH $pn, $pe, {_X}, y AS (SELECT pe.graph_id, node_out AS node_id, sum(weight * x) / sum(weight) AS y FROM pe JOIN x ON x.graph_id = pe.graph_id AND x.node_id = node_in GROUP BY 1, 2) SELECT x.graph_id, x.node_id, round(coalesce(y, 0), 6) AS y FROM x LEFT JOIN y USING (graph_id, node_id)"))
def _(s, d):
    return r6(P.summed(pg_edges(s, d), nodes(s, d), "mean"))


@query("gin_aggregate", sql(f"WITH $pn, $pe, {_X}, y AS ({_IN}) SELECT x.graph_id, x.node_id, round(1.1 * x + coalesce(y, 0), 8) AS y FROM x LEFT JOIN y USING (graph_id, node_id)"))
def _(s, d):
    return r6(P.gin(pg_edges(s, d), nodes(s, d), 0.1), n=8)


_LOOPED = "e AS (SELECT * FROM pe UNION ALL SELECT graph_id, node_id, node_id, 1.0::double FROM pn), a AS (SELECT graph_id, node_in, sum(weight) AS da FROM e GROUP BY 1, 2), b AS (SELECT graph_id, node_out, sum(weight) AS db FROM e GROUP BY 1, 2)"


@query("gcn_aggregate", sql(f"WITH $pn, $pe, {_X}, {_LOOPED} SELECT e.graph_id, e.node_out AS node_id, round(sum(weight / sqrt(da * db) * x), 6) AS y FROM e JOIN a USING (graph_id, node_in) JOIN b USING (graph_id, node_out) JOIN x ON x.graph_id = e.graph_id AND x.node_id = e.node_in GROUP BY 1, 2"))
def _(s, d):
    return r6(P.gcn(pg_edges(s, d), nodes(s, d)))


def _related(s, d):
    k = kg(s, d).withColumnsRenamed({"h": "node_in", "t": "node_out", "r": "relation"})
    return k, k.select("node_in").distinct().select(F.col("node_in").alias("node_id"), (F.col("node_in") % 17 - 8.0).alias("x"))


for how, expr in (("mean", "sum(weight * (h % 17 - 8.0)) / sum(weight)"), ("sum", "sum(weight * (h % 17 - 8.0::double))")):

    @query(f"relational_{how}", sql(f"WITH $kg SELECT t AS node_id, r AS relation, round({expr}, 6) AS y FROM kg GROUP BY 1, 2"))
    def _(s, d, how=how):
        return r6(P.relational(*_related(s, d), how))


@query("gat_attention", sql(f"WITH $pn, $pe, {_X}, lp AS (SELECT graph_id, node_in, node_out, weight FROM pe UNION ALL SELECT graph_id, node_id, node_id, 1 FROM x), m AS (SELECT lp.*, i.x AS xi, 0.3 * o.x + 0.7 * i.x AS s FROM lp JOIN x i ON i.graph_id = lp.graph_id AND i.node_id = node_in JOIN x o ON o.graph_id = lp.graph_id AND o.node_id = node_out), l AS (SELECT *, CASE WHEN s > 0 THEN s ELSE 0.2 * s END AS z FROM m), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY graph_id, node_out)) * weight AS e FROM l) SELECT graph_id, node_out AS node_id, round(sum(e * xi) / sum(e), 6) AS y FROM e GROUP BY 1, 2"))
def _(s, d):
    return r6(P.attention(pg_edges(s, d), nodes(s, d), 0.3, 0.7))


@query("continuous_filter", sql(f"WITH $pn, $pe, {_X}, y AS (SELECT pe.graph_id, node_out AS node_id, sum(weight * (0.5 * exp(-0.5 * pow(weight / 50 / 2, 2)) + 0.25 * exp(-0.5 * pow((weight / 50 - 1) / 2, 2))) * x) AS y FROM pe JOIN x ON x.graph_id = pe.graph_id AND x.node_id = node_in GROUP BY 1, 2) SELECT x.graph_id, x.node_id, round(coalesce(y, 0), 5) AS y FROM x LEFT JOIN y USING (graph_id, node_id)"))
def _(s, d):
    return r6(P.filtered(pg_edges(s, d).withColumn("distance", F.col("weight") / 50), nodes(s, d), [0.0, 1.0], 2.0, [0.5, 0.25]), n=5)


@query("chebyshev", sql(f"WITH $pn, $pe, {_X}, u AS (SELECT * FROM pe UNION ALL SELECT graph_id, node_out, node_in, weight FROM pe), a AS (SELECT graph_id, node_in AS n, sum(weight) AS dg FROM u GROUP BY 1, 2), e AS (SELECT u.graph_id, node_in, node_out, -weight / sqrt(a.dg * b.dg) AS w FROM u JOIN a ON a.graph_id = u.graph_id AND a.n = node_in JOIN a b ON b.graph_id = u.graph_id AND b.n = node_out), t1 AS (SELECT x.graph_id, x.node_id, coalesce(sum(w * z.x), 0) AS y FROM x LEFT JOIN e ON e.graph_id = x.graph_id AND e.node_out = x.node_id LEFT JOIN x z ON z.graph_id = e.graph_id AND z.node_id = e.node_in GROUP BY 1, 2), t2 AS (SELECT x.graph_id, x.node_id, 2 * coalesce(sum(w * z.y), 0) - any_value(x.x) AS y FROM x LEFT JOIN e ON e.graph_id = x.graph_id AND e.node_out = x.node_id LEFT JOIN t1 z ON z.graph_id = e.graph_id AND z.node_id = e.node_in GROUP BY 1, 2) SELECT graph_id, node_id, 0::bigint AS \"order\", round(x, 6) AS y FROM x UNION ALL SELECT graph_id, node_id, 1::bigint, round(y, 6) FROM t1 UNION ALL SELECT graph_id, node_id, 2::bigint, round(y, 6) FROM t2"))
def _(s, d):
    e = pg_edges(s, d)
    both = e.unionByName(e.select("graph_id", F.col("node_out").alias("node_in"), F.col("node_in").alias("node_out"), "weight"))
    return r6(P.chebyshev(both, nodes(s, d), 2))


_SOFT = "s AS (SELECT graph_id, node_id, c AS cluster, CASE WHEN c = node_id % 3 THEN 0.5 ELSE 0.25 END::double AS p FROM pn, range(3) g(c))"


def _soft(s, d):
    return pg_nodes(s, d).select("graph_id", "node_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("cluster")).withColumn("p", F.when(F.col("cluster") == F.col("node_id") % 3, 0.5).otherwise(0.25))


@query("diffpool_sparse", sql("WITH $pe SELECT graph_id, node_in % 3 AS c_in, node_out % 3 AS c_out, sum(weight) AS weight FROM pe GROUP BY ALL"))
def _(s, d):
    return P.pool_hard(pg_edges(s, d), pg_nodes(s, d).select("graph_id", "node_id", (F.col("node_id") % 3).alias("cluster")))


_DENSE = "dense AS (SELECT pe.graph_id, a.cluster AS c_in, b.cluster AS c_out, sum(a.p * weight * b.p) AS weight FROM pe JOIN s a ON a.graph_id = pe.graph_id AND a.node_id = node_in JOIN s b ON b.graph_id = pe.graph_id AND b.node_id = node_out GROUP BY ALL)"


@query("diffpool_dense", sql(f"WITH $pn, $pe, {_SOFT}, {_DENSE} SELECT graph_id, c_in, c_out, round(weight, 4) AS weight FROM dense"))
def _(s, d):
    return r6(P.pool_dense(pg_edges(s, d), _soft(s, d)), "weight", 4)


@query("assignment_entropy", sql(f"WITH $pn, {_SOFT} SELECT graph_id, round(sum(-p * ln(p + 1e-10)) / count(DISTINCT node_id), 8) AS entropy FROM s GROUP BY 1"))
def _(s, d):
    return r6(P.assignment_entropy(_soft(s, d)), "entropy", 8)


@query("mincut_metrics", sql(f"WITH $pn, $pe, {_SOFT}, {_DENSE}, i AS (SELECT graph_id, sum(weight) AS i FROM dense WHERE c_in = c_out GROUP BY 1), dg AS (SELECT graph_id, node_in AS node_id, sum(weight) AS dg FROM pe GROUP BY 1, 2), v AS (SELECT graph_id, sum(p * p * dg) AS v FROM s JOIN dg USING (graph_id, node_id) GROUP BY 1), ss AS (SELECT x.graph_id, x.cluster AS a, y.cluster AS b, sum(x.p * y.p) AS x FROM s x JOIN s y ON x.graph_id = y.graph_id AND x.node_id = y.node_id GROUP BY ALL), nn AS (SELECT graph_id, sqrt(sum(x * x)) AS n FROM ss GROUP BY 1), o AS (SELECT graph_id, sqrt(sum(pow(x / n - CASE WHEN a = b THEN 1 / sqrt(3) ELSE 0 END, 2))) AS o FROM ss JOIN nn USING (graph_id) GROUP BY 1) SELECT graph_id, round(1 - coalesce(i, 0) / (coalesce(v, 0) + 1e-10), 6) AS cut, round(o, 6) AS orthogonality FROM o LEFT JOIN i USING (graph_id) LEFT JOIN v USING (graph_id)"))
def _(s, d):
    return r6(r6(P.mincut(pg_edges(s, d), _soft(s, d), 3), "cut"), "orthogonality")


@query("mlp_forward", sql("WITH $emb SELECT vec_id, label, round(greatest(v[1] + 2 * v[2] - v[3] + 0.1, 0), 6) AS a, round(greatest(-v[1] + 0.5 * v[3] - 0.2, 0), 6) AS b FROM emb"))
def _(s, d):
    z = [0.0] * 61
    y = P.dense_layer(emb(s, d), [[1.0, 2.0, -1.0] + z, [-1.0, 0.0, 0.5] + z], [0.1, -0.2], "relu")
    return y.select("vec_id", "label", F.round(F.col("v")[0], 6).alias("a"), F.round(F.col("v")[1], 6).alias("b"))


@query("mutual_information", sql("WITH $emb, s AS (SELECT 4 * v[1] AS score, label = 1 AS p FROM emb) SELECT round(avg(ln(2) - (ln(1 + exp(-abs(score))) + greatest(-score, 0))) FILTER (p) - avg(ln(1 + exp(-abs(score))) + greatest(-score, 0) + score - ln(2)) FILTER (NOT p), 8) AS mi FROM s"))
def _(s, d):
    return r6(P.mutual_information(emb(s, d).select((4 * F.col("v")[0]).alias("score"), (F.col("label") == 1).alias("positive"))), "mi", 8)


# -- scores of triplets; entities take vectors of the embeddings table by their id

_VEC = """n AS (SELECT count(*) AS n FROM emb), z AS (SELECT kg.h, kg.r, kg.t, a.v[1:8] AS vh, b.v[9:16] AS vr, c.v[17:24] AS vt FROM kg, n JOIN emb a ON a.vec_id = kg.h % n JOIN emb b ON b.vec_id = kg.r JOIN emb c ON c.vec_id = kg.t % n)"""


def _scored(s, d):
    e = emb(s, d)
    n = e.count()
    k = kg(s, d).select("h", "r", "t")
    a = e.select(F.col("vec_id").alias("eh"), F.slice("v", 1, 8).alias("vh"))
    c = e.select(F.col("vec_id").alias("et"), F.slice("v", 17, 8).alias("vt"))
    b = e.where("vec_id < 5").select(F.col("vec_id").alias("r"), F.slice("v", 9, 8).alias("vr"))
    return k.join(a, F.col("h") % n == F.col("eh")).join(c, F.col("t") % n == F.col("et")).join(F.broadcast(b), "r")


def _sum(expr, n=8):
    return "(" + " + ".join(expr.replace("{i}", str(i)).replace("{j}", str(i + 4)).replace("{f}", str((i + 3) % 8 + 1)) for i in range(1, n + 1)) + ")"


_SCORES = {
    "transe": (C.transe, _sum("abs(vh[{i}] + vr[{i}] - vt[{i}])")),
    "distmult": (C.distmult, _sum("vh[{i}] * vr[{i}] * vt[{i}]")),
    "complex": (lambda h, r, t: C.complex_(h, r, t, 8), _sum("(vh[{i}] * vr[{i}] - vh[{j}] * vr[{j}]) * vt[{i}] + (vh[{i}] * vr[{j}] + vh[{j}] * vr[{i}]) * vt[{j}]", 4)),
    "simple": (lambda h, r, t: C.simple(h, r, t, 8), _sum("vh[{i}] * vr[{i}] * vt[{f}]")),
    "rotate": (lambda h, r, t: C.rotate(h, F.slice(r, 1, 4), t, 8), _sum("sqrt(pow(vh[{i}] * cos(vr[{i}]) - vh[{j}] * sin(vr[{i}]) - vt[{i}], 2) + pow(vh[{i}] * sin(vr[{i}]) + vh[{j}] * cos(vr[{i}]) - vt[{j}], 2))", 4)),
}
for name, (score, text) in _SCORES.items():

    @query(f"{name}_score", sql(f"WITH $kg, $emb, {_VEC} SELECT h, r, t, round({text}, 6) AS score FROM z"))
    def _(s, d, score=score):
        return _scored(s, d).select("h", "r", "t", F.round(score(F.col("vh"), F.col("vr"), F.col("vt")), 6).alias("score"))


def _cols(df, c, n, keys):
    return df.select(*keys, *[F.round(F.col(c)[i].cast("double"), 6).alias(f"y{i}") for i in range(n)])


@query("one_hot", "SELECT c_custkey, " + ", ".join(f"(c_nationkey % 6 = {i})::int::double AS y{i}" for i in range(4)) + ", (c_nationkey % 6 > 3)::int::double AS y4 FROM customer")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", C.one_hot(F.col("c_nationkey") % 6, 4, allow_unknown=True).alias("y"))
    return _cols(c, "y", 5, ["c_custkey"])


@query("shifted_softplus", sql("WITH $pn SELECT node_id, graph_id, round(ln(1 + exp(-abs(value / 1000))) + greatest(value / 1000, 0) - ln(2), 6) AS y FROM pn"))
def _(s, d):
    return nodes(s, d).select("node_id", "graph_id", F.round(C.shifted_softplus(F.col("x")), 6).alias("y"))


@query("clipped_policy_objective", sql("WITH $emb SELECT vec_id, round(least(least(exp(20 * (v[1] - v[2])), 10) * v[3], least(greatest(exp(20 * (v[1] - v[2])), 0.8), 1.2) * v[3]), 6) AS y FROM emb"))
def _(s, d):
    v = F.col("v")
    return emb(s, d).select("vec_id", F.round(C.clipped_objective(20 * v[0], 20 * v[1], v[2]), 6).alias("y"))


@query("gaussian_smearing", sql("WITH $emb SELECT vec_id, " + ", ".join(f"round(exp(-0.5 * pow((v[1] - {-0.3 + 0.15 * i}) / 0.15, 2)), 6) AS y{i}" for i in range(5)) + " FROM emb"))
def _(s, d):
    return _cols(emb(s, d).select("vec_id", C.gaussians(F.col("v")[0], -0.3, 0.3, 5).alias("y")), "y", 5, ["vec_id"])


@query("position_embedding", sql("WITH $sets, n AS (SELECT *, count(*) OVER (PARTITION BY set_id) - 1 - pos AS p FROM sets) SELECT set_id, pos, round(sin(p), 6) AS y0, round(sin(p / 100.0), 6) AS y1, round(cos(p), 6) AS y2, round(cos(p / 100.0), 6) AS y3 FROM n"))
def _(s, d):
    from pyspark.sql import Window

    from spindrel.plans.views import sets

    x = sets(s, d).withColumn("n", F.count("*").over(Window.partitionBy("set_id")))
    return _cols(x.select("set_id", "pos", C.positions(F.col("pos"), F.col("n"), 4).alias("y")), "y", 4, ["set_id", "pos"])


@query("gaussian_log_pdf", sql(f"WITH $emb SELECT vec_id, round(-0.5 * (pow(v[1] - 0.1, 2) / 0.5 + ln(2 * {math.pi} * 0.5)), 6) AS y FROM emb"))
def _(s, d):
    return emb(s, d).select("vec_id", F.round(C.gaussian_log_pdf(F.col("v")[0], 0.1, 0.5), 6).alias("y"))


@query("affine_coupling", sql("WITH $emb SELECT vec_id, round((v[1] + v[3]) * exp(v[2]), 6) AS y, round(v[2], 6) AS log_det, round(v[1], 6) AS back FROM emb"))
def _(s, d):
    v = F.col("v")
    y, det = C.coupling(v[0], v[1], v[2])
    e = emb(s, d).withColumn("y", y).withColumn("det", det)
    return e.select("vec_id", F.round("y", 6).alias("y"), F.round("det", 6).alias("log_det"), F.round(C.coupling(F.col("y"), v[1], v[2], reverse=True)[0], 6).alias("back"))


@query("normalize_target", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::bigint AS line, l_extendedprice, round((l_extendedprice - 38000.0) / 23000.0, 6) AS y FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("line"), "l_extendedprice", F.round(C.normalised(F.col("l_extendedprice"), 38000.0, 23000.0), 6).alias("y"))


@query("remap_vocab", "SELECT p_partkey, coalesce(CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 END, -1)::bigint AS y FROM part")
def _(s, d):
    from spindrel.operators.graph import lookup

    v = s.createDataFrame([("ECONOMY", 0), ("STANDARD", 1), ("PROMO", 2)], "p_type string, y long")
    return lookup(table(s, d, "part").select("p_partkey", "p_type"), v, ["p_type"], "y", default=-1).select("p_partkey", "y")


__all__ = ["rounded"]
