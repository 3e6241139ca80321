"""Queries of geometry and chains."""

import math

from pyspark.sql import functions as F

from spindrel.functions import sequence as Q
from spindrel.functions.vectors import minus
from spindrel.operators import geometry as G
from spindrel.plans.registry import query
from spindrel.plans.views import chain, emb, sql
from spindrel.session import table


def nodes(s, d):
    return emb(s, d).select(F.col("label").alias("graph_id"), F.col("vec_id").alias("node_id"), F.slice("v", 1, 3).alias("position"))


_N = "n AS (SELECT label AS graph_id, vec_id AS node_id, v[1] AS x, v[2] AS y, v[3] AS z FROM emb)"
_D = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
_P = f"p AS (SELECT a.graph_id, a.node_id AS a, b.node_id AS b, {_D} AS distance FROM n a JOIN n b ON a.graph_id = b.graph_id AND a.node_id <> b.node_id)"


@query("radius_edges", sql(f"WITH $emb, {_N}, {_P} SELECT graph_id, a, b, round(distance, 6) AS distance FROM p WHERE distance < 0.1"))
def _(s, d):
    return G.radius_pairs(nodes(s, d), 0.1).withColumn("distance", F.round("distance", 6))


@query("knn_edges", sql(f"WITH $emb, {_N}, {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY graph_id, a ORDER BY distance, b) AS k FROM p) SELECT graph_id, a, b, round(distance, 6) AS distance FROM k WHERE k <= 5"))
def _(s, d):
    return G.knn_pairs(nodes(s, d), 5).withColumn("distance", F.round("distance", 6))


@query("knn_gap_filter", sql(f"WITH $emb, {_N}, {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY graph_id, a ORDER BY distance, b) AS k FROM p) SELECT graph_id, a, b FROM k WHERE k <= 5 AND abs(a - b) >= 40 AND abs(a - b) <= 300 AND distance >= 1e-10"))
def _(s, d):
    n = nodes(s, d)
    return G.gap_filter(G.knn_pairs(n, 5), n.select("graph_id", "node_id", F.col("node_id").alias("residue_id")), 40, 300).select("graph_id", "a", "b")


@query("sequential_edges", sql("WITH $chain SELECT a.graph_id, a.pos AS a, b.pos AS b, b.pos - a.pos + 2 AS relation FROM chain a JOIN chain b ON a.graph_id = b.graph_id AND abs(a.pos - b.pos) <= 2"))
def _(s, d):
    return G.sequential_pairs(chain(s, d), 2)


_STEP = "st AS (SELECT graph_id, node_id, lead(node_id) OVER w AS nxt, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM n WINDOW w AS (PARTITION BY graph_id ORDER BY node_id))"
_ANGLE = "atan2(sqrt(pow({a}y * {b}z - {a}z * {b}y, 2) + pow({a}z * {b}x - {a}x * {b}z, 2) + pow({a}x * {b}y - {a}y * {b}x, 2)), {a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"


def _steps(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("graph_id").orderBy("node_id")
    return nodes(s, d).withColumn("nxt", F.lead("node_id").over(w)).where("nxt is not null")


@query("angle_bin", sql(f"WITH $emb, {_N}, {_STEP}, j AS (SELECT a.graph_id, a.node_id AS edge_a, b.node_id AS edge_b, -a.dx AS ax, -a.dy AS ay, -a.dz AS az, b.dx AS bx, b.dy AS by_, b.dz AS bz FROM st a JOIN st b ON a.graph_id = b.graph_id AND a.nxt = b.node_id WHERE b.nxt IS NOT NULL) SELECT graph_id, edge_a, edge_b, least(floor({_ANGLE.format(a='a', b='b').replace('by ', 'by_ ').replace('by,', 'by_,').replace('by)', 'by_)')} / {math.pi} * 8), 7)::bigint AS bin FROM j"))
def _(s, d):
    e = _steps(s, d).select("graph_id", F.col("node_id").alias("edge_id"), F.col("node_id").alias("node_in"), F.col("nxt").alias("node_out"))
    return G.edge_angles(e, nodes(s, d), 8).select("graph_id", "edge_a", "edge_b", "bin")


# Differences of neighbours, their cross products, and the angle between those.
_DIH = "q AS (SELECT *, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey, lead(dz) OVER w AS ez, lead(dx, 2) OVER w AS fx, lead(dy, 2) OVER w AS fy, lead(dz, 2) OVER w AS fz FROM st WINDOW w AS (PARTITION BY graph_id ORDER BY node_id)), u AS (SELECT graph_id, node_id, dy * ez - dz * ey AS ax, dz * ex - dx * ez AS ay, dx * ey - dy * ex AS az, ey * fz - ez * fy AS bx, ez * fx - ex * fz AS cy, ex * fy - ey * fx AS bz FROM q WHERE fx IS NOT NULL)"


@query("dihedral_bin", sql(f"WITH $emb, {_N}, {_STEP}, {_DIH} SELECT graph_id, node_id, least(floor(atan2(sqrt(pow(ay * bz - az * cy, 2) + pow(az * bx - ax * bz, 2) + pow(ax * cy - ay * bx, 2)), ax * bx + ay * cy + az * bz) / {math.pi} * 8), 7)::bigint AS bin FROM u"))
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("graph_id").orderBy("node_id")
    n = nodes(s, d).withColumn("v", minus(F.lead("position").over(w), F.col("position")))
    n = n.withColumn("v2", F.lead("v").over(w)).withColumn("v3", F.lead("v", 2).over(w)).where("v3 is not null")
    return n.select("graph_id", "node_id", G.angle_bin(G.dihedral(F.col("v"), F.col("v2"), F.col("v3")), 8).alias("bin"))


@query("contact_label", sql("WITH $chain, r AS (SELECT graph_id, pos, residue_type::double AS x, q AS y, pos * 3.8 AS z FROM chain) SELECT a.graph_id, a.pos AS a, b.pos AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) < 25 AS contact FROM r a JOIN r b ON a.graph_id = b.graph_id AND abs(a.pos - b.pos) >= 3"))
def _(s, d):
    c = chain(s, d).select("graph_id", "pos", F.array(F.col("residue_type").cast("double"), "q", F.col("pos") * 3.8).alias("position"))
    return G.contacts(c, 25.0, 3)


# The codons of residue ids, joined from a table of residues in SQL.
_CODON = "c AS (SELECT i - 1 AS i, [{}][i] AS n FROM range(1, 21) t(i))".format(", ".join(str(Q.CODONS[x]) for x in Q.RESIDUES))
_DDE = f"p AS (SELECT graph_id, residue_type AS a, lead(residue_type) OVER (PARTITION BY graph_id ORDER BY pos) AS b FROM chain), k AS (SELECT graph_id, a, b, count(*) AS k FROM p WHERE b IS NOT NULL GROUP BY 1, 2, 3), n AS (SELECT graph_id, sum(k) AS n FROM k GROUP BY 1), {_CODON}, g AS (SELECT x.i AS a, y.i AS b, x.n * y.n / (61.0 * 61.0)::double AS m FROM c x, c y)"


@query("dde", sql(f"WITH $chain, {_DDE} SELECT graph_id, a, b, round((k / n - m) / sqrt(m * (1 - m) / n), 5) AS dde FROM k JOIN n USING (graph_id) JOIN g USING (a, b)"))
def _(s, d):
    x = Q.dipeptide_deviation(chain(s, d), occurring=True)
    return x.withColumn("dde", F.round("dde", 5))


@query("dde_grid", sql(f"WITH $chain, {_DDE} SELECT a, b, round(avg((coalesce(k, 0) / n - m) / sqrt(m * (1 - m) / n)), 5) AS dde, count(*) AS n FROM n CROSS JOIN g LEFT JOIN k USING (graph_id, a, b) GROUP BY 1, 2"))
def _(s, d):
    return Q.dipeptide_deviation(chain(s, d)).groupBy("a", "b").agg(F.round(F.avg("dde"), 5).alias("dde"), F.count("*").alias("n"))


_LAG = "m AS (SELECT graph_id, pos, value / 10000 AS x, avg(value / 10000) OVER w AS m, var_pop(value / 10000) OVER w AS v, var_samp(value / 10000) OVER w AS vs FROM chain WINDOW w AS (PARTITION BY graph_id)), j AS (SELECT a.*, b.x AS y, b.pos - a.pos AS lag FROM m a JOIN m b ON a.graph_id = b.graph_id AND b.pos - a.pos BETWEEN 1 AND 3)"
for kind, text in (("broto", "avg(x * y)"), ("moran", "avg((x - m) * (y - m)) / nullif(any_value(v), 0)"), ("geary", "avg(pow(x - y, 2)) / 2 / nullif(any_value(vs), 0)")):

    @query(f"autocorrelation_{kind}", sql(f"WITH $chain, {_LAG} SELECT graph_id, lag, round({text}, 5) AS value FROM j GROUP BY 1, 2"))
    def _(s, d, kind=kind):
        c = chain(s, d).select("graph_id", "pos", (F.col("value") / 10000).alias("x"))
        return Q.autocorrelation(c, 3, kind).withColumn("value", F.round("value", 5))


@query("truncate", sql("WITH $chain SELECT graph_id, pos, residue_type FROM chain WHERE pos < 4"))
def _(s, d):
    return Q.truncated(chain(s, d), 4).select("graph_id", "pos", "residue_type")


_SYM = "GASPVTCILNDQKEMHFRYW"


@query("to_sequence", sql(f"WITH $chain SELECT graph_id, string_agg('{_SYM}'[residue_type + 1], '' ORDER BY pos) AS sequence FROM chain GROUP BY 1"))
def _(s, d):
    return Q.sequence_text(chain(s, d), _SYM)


@query("residue_from_sequence", sql("WITH $chain SELECT graph_id, pos, residue_type FROM chain"))
def _(s, d):
    return Q.residues_of(Q.sequence_text(chain(s, d), _SYM), _SYM)


@query("protein_residue_counts", "SELECT chain_id, residue_type::bigint AS residue_type, count(*) AS n FROM (SELECT DISTINCT graph_id, residue_id, residue_type, chain_id FROM residues) GROUP BY 1, 2")
def _(s, d):
    r = table(s, d, "residues").select("graph_id", "residue_id", "residue_type", "chain_id").distinct()
    return r.groupBy("chain_id", F.col("residue_type").cast("long").alias("residue_type")).agg(F.count("*").alias("n"))
