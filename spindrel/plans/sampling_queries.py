"""Queries of sampling, splits, iterative algorithms, molecules and loading."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrel.functions.smiles import canonical
from spindrel.operators import iterative as I
from spindrel.operators import ragged as R
from spindrel.operators import sampling as S
from spindrel.plans.registry import query
from spindrel.plans.views import chain, ev, kg, pg_edges, pg_nodes, pred, sets, sql
from spindrel.session import table, written
from spindrel.sources import files as L
from spindrel.sources import molecules as C

_KEY = "('0x' || substr(md5(concat_ws('-', {})), 1, 8))::bigint"
_U = "((" + _KEY + " + 0.5) / 4294967296.0)"


@query("multinomial", sql(f"WITH $pn SELECT node_id, graph_id FROM pn WHERE value > 0 ORDER BY ln({_U.format('3, graph_id, node_id')}) / value DESC, graph_id, node_id LIMIT 40"))
def _(s, d):
    n = pg_nodes(s, d).where("value > 0")
    return S.weighted_sample(n, F.col("value"), 40, 3, F.col("graph_id"), F.col("node_id")).select("node_id", "graph_id")


_P = "p AS (SELECT t AS node_id, sum(weight * weight) / (SELECT sum(weight * weight) FROM k) AS p FROM k GROUP BY 1), n AS (SELECT h AS node_id FROM k UNION SELECT t FROM k)"


def _plain(s, d):
    k = kg(s, d).groupBy(F.col("h").alias("node_in"), F.col("t").alias("node_out")).agg(F.sum("weight").alias("weight"))
    both = k.unionByName(k.select(F.col("node_out").alias("node_in"), F.col("node_in").alias("node_out"), "weight"))
    return both, both.select(F.col("node_in").alias("node_id")).distinct()


_K = "k0 AS (SELECT h, t, sum(weight) AS weight FROM kg GROUP BY 1, 2), k AS (SELECT * FROM k0 UNION ALL SELECT t, h, weight FROM k0)"


@query("node_sampler", sql(f"WITH $kg, {_K}, {_P}, c AS (SELECT node_id, p FROM n JOIN p USING (node_id) ORDER BY ln({_U.format('5, node_id')}) / p DESC, node_id LIMIT 60) SELECT h AS node_in, t AS node_out, round(weight / (60 * b.p), 6) AS weight FROM k JOIN c a ON a.node_id = h JOIN c b ON b.node_id = t"))
def _(s, d):
    e, n = _plain(s, d)
    return S.node_sample(e, n, 60, 5)[1].withColumn("weight", F.round("weight", 6))


@query("edge_sampler", sql(f"WITH $kg, {_K}, a AS (SELECT h, sum(weight) AS da FROM k GROUP BY 1), b AS (SELECT t, sum(weight) AS db FROM k GROUP BY 1), q AS (SELECT *, 1 / da + 1 / db AS q FROM k JOIN a USING (h) JOIN b USING (t)), p AS (SELECT h, t, weight, q / sum(q) OVER () AS p FROM q) SELECT h AS node_in, t AS node_out, round(weight / (80 * p), 4) AS weight FROM p ORDER BY ln({_U.format('6, h, t')}) / p DESC, h, t LIMIT 80"))
def _(s, d):
    return S.edge_sample(_plain(s, d)[0], 80, 6).withColumn("weight", F.round("weight", 4))


@query("strict_negative", sql(f"WITH $kg, ent AS (SELECT unnest(range((SELECT max(t) + 1 FROM kg))) AS e), free AS (SELECT hr.h, hr.r, e, row_number() OVER (PARTITION BY hr.h, hr.r ORDER BY e) - 1 AS place, count(*) OVER (PARTITION BY hr.h, hr.r) AS n FROM (SELECT DISTINCT h, r FROM kg) hr, ent WHERE NOT EXISTS (SELECT 1 FROM kg k WHERE k.h = hr.h AND k.r = hr.r AND k.t = e)) SELECT kg.h, kg.r, kg.t, g.range AS draw, free.e AS negative FROM kg, range(2) g, free WHERE free.h = kg.h AND free.r = kg.r AND free.place = {_KEY.format('9, kg.h, kg.r, kg.t, g.range')} % free.n"))
def _(s, d):
    k = kg(s, d)
    return S.strict_negatives(k, k, k.agg(F.max("t")).first()[0] + 1, 2, 9)


@query("key_split", sql(f"WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT *, sum(n) OVER (ORDER BY {_KEY.format('4, o_custkey')}, o_custkey) - n / 2 AS mid FROM n), p AS (SELECT o_custkey, ((mid > 0.8 * (SELECT count(*) FROM orders))::int + (mid > 0.9 * (SELECT count(*) FROM orders))::int)::bigint AS part FROM u) SELECT o_orderkey, part FROM orders JOIN p USING (o_custkey)"))
def _(s, d):
    return S.key_split(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", [0.8, 0.1, 0.1], 4).select("o_orderkey", "part")


@query("ordered_group_split", "WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1), o AS (SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, f DESC) AS k FROM g), t AS (SELECT count(*) AS m FROM orders), w(k, a, b, part) AS (SELECT 0::bigint, 0::bigint, 0::bigint, -1::bigint UNION ALL SELECT o.k, (a + CASE WHEN a + n <= 0.8 * m THEN n ELSE 0 END)::bigint, (b + CASE WHEN a + n > 0.8 * m AND a + b + n <= 0.9 * m THEN n ELSE 0 END)::bigint, (CASE WHEN a + n <= 0.8 * m THEN 0 WHEN a + b + n <= 0.9 * m THEN 1 ELSE 2 END)::bigint FROM w JOIN o ON o.k = w.k + 1, t) SELECT o_orderkey, part FROM orders JOIN o USING (o_custkey) JOIN w USING (k)")
def _(s, d):
    return S.ordered_group_split(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "part")


@query("semisupervised", f"SELECT c_custkey, row_number() OVER (ORDER BY {_KEY.format('2, c_custkey')}, c_custkey) <= 60 AS labeled FROM customer")
def _(s, d):
    return S.labelled_subset(table(s, d, "customer").select("c_custkey"), "c_custkey", 60, 2)


@query("edge_mask_random", sql(f"WITH $sets, n AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1), d AS (SELECT set_id, {_KEY.format('8, set_id, k')} % n AS pos FROM (SELECT *, unnest(range(greatest(1, floor(0.3 * n))::bigint)) AS k FROM n)) SELECT set_id, pos FROM sets WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.set_id = sets.set_id AND d.pos = sets.pos)"))
def _(s, d):
    x = sets(s, d)
    return x.join(S.drops(R.sizes_of(x), 0.3, 8), ["set_id", "pos"], "left_anti").select("set_id", "pos")


@query("attribute_mask", sql(f"WITH $sets, n AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1) SELECT DISTINCT set_id, {_KEY.format('1, set_id, k')} % n AS pos FROM (SELECT *, unnest(range(greatest(1, floor(0.15 * n))::bigint)) AS k FROM n)"))
def _(s, d):
    return S.drops(R.sizes_of(sets(s, d)), 0.15, 1)


@query("subsequence_window", sql(f"WITH $chain, n AS (SELECT graph_id, {_KEY.format('3, graph_id')} % (greatest(count(*) - 3, 0) + 1) AS s FROM chain GROUP BY 1) SELECT graph_id, pos - s AS pos, residue_type FROM chain JOIN n USING (graph_id) WHERE pos >= s AND pos < s + 3"))
def _(s, d):
    from spindrel.functions.sequence import truncated

    c = chain(s, d)
    w = S.random_windows(c.groupBy(F.col("graph_id").alias("set_id")).agg(F.count("*").alias("size")), 3, 3).toDF("graph_id", "start")
    return truncated(c.join(w, "graph_id"), 3, F.col("start")).select("graph_id", "pos", "residue_type")


@query("random_pairs", sql(f"WITH $sets, n AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1) SELECT set_id, k AS draw, {_KEY.format(chr(39).join(['1, ', 'a', ', set_id, k']))} % n AS a, {_KEY.format(chr(39).join(['1, ', 'b', ', set_id, k']))} % n AS b FROM (SELECT *, unnest(range(n)) AS k FROM n)"))
def _(s, d):
    n = R.sizes_of(sets(s, d))
    return S.random_pairs(n, n.withColumnRenamed("size", "n"), 1)


# -- in rounds


def _pg_links(s, d):
    return pg_edges(s, d).select(F.col("node_in").alias("a"), F.col("node_out").alias("b"))




@query("connected_components", sql("WITH RECURSIVE $pe, u AS (SELECT node_in AS i, node_out AS o FROM pe UNION SELECT node_out, node_in FROM pe), c(id, r) AS (SELECT DISTINCT i, i FROM u UNION SELECT u.o, c.r FROM c JOIN u ON u.i = c.id) SELECT id, min(r) AS component FROM c GROUP BY 1"))
def _(s, d):
    return I.components(_pg_links(s, d))


@query("component_counts", "SELECT n_regionkey::bigint AS component, count(*) AS n FROM (SELECT c_custkey AS id, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("n"))
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    comp = I.components(n.select((F.col("n") + 100).alias("a"), F.col("r").alias("b")), n.select((F.col("n") + 100).alias("id")))
    return c.join(comp.select((F.col("id") - 100).alias("n"), "component"), "n").groupBy("component").agg(F.count("*").alias("n"))


def _tree(s, d):
    c = table(s, d, "customer").select((F.col("c_custkey") + 1000).alias("node_out"), (F.col("c_nationkey") + 100).cast("long").alias("node_in"))
    n = table(s, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("node_out"), (F.col("n_regionkey") + 1).cast("long").alias("node_in"))
    r = table(s, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("node_out"), F.lit(0).cast("long").alias("node_in"))
    return c.unionByName(n).unionByName(r).withColumn("graph_id", F.lit(0).cast("long"))


_TREE = "tree AS (SELECT c_custkey + 1000 AS o, (c_nationkey + 100)::bigint AS i FROM customer UNION ALL SELECT n_nationkey + 100, n_regionkey + 1 FROM nation UNION ALL SELECT r_regionkey + 1, 0 FROM region)"
_HOPS = f"WITH RECURSIVE {_TREE}, w(n, k) AS (SELECT 0::bigint, 0::bigint UNION ALL SELECT o, k + 1 FROM w JOIN tree ON i = n WHERE k < {{}})"


def _root(s):
    return s.createDataFrame([(0, 0)], "graph_id long, node_id long")


@query("khop_distance", _HOPS.format(3) + " SELECT 0::bigint AS graph_id, n AS node_id, k AS hops FROM w")
def _(s, d):
    return I.hops(_tree(s, d), _root(s), 3)


@query("khop_context", _HOPS.format(3) + " SELECT 0::bigint AS graph_id, n AS node_id, 'substructure' AS part FROM w WHERE k <= 2 UNION ALL SELECT 0, n, 'context' FROM w WHERE k > 1 AND k <= 3 UNION ALL SELECT 0, n, 'anchor' FROM w WHERE k > 1 AND k <= 2")
def _(s, d):
    return I.context(_tree(s, d), _root(s), 2, 1, 3)


@query("bfs_order", _HOPS.format(9) + " SELECT 0::bigint AS graph_id, n AS node_id, row_number() OVER (ORDER BY k, n) - 1 AS place FROM w")
def _(s, d):
    return I.bfs_order(_tree(s, d), _root(s))


# Searches over the whole graph: their queries are the heads whose id is divisible by 20.


@query("neural_lp_walk", sql("WITH $kg, u AS (SELECT h AS i, r, t AS o, weight FROM kg UNION ALL SELECT t, r, h, weight FROM kg), s0 AS (SELECT h AS query, h AS n, 1.0::double AS p FROM kg WHERE h % 20 = 0 GROUP BY 1), a AS (SELECT query, o AS n, sum(p * weight * [0.5, 0.1, 0.2, 0.1, 0.1][r + 1]) AS p FROM s0 JOIN u ON i = n GROUP BY 1, 2), s1 AS (SELECT query, n, p / sum(p) OVER (PARTITION BY query) AS p FROM a), b AS (SELECT query, o AS n, sum(p * weight * [0.1, 0.4, 0.2, 0.2, 0.1][r + 1]) AS p FROM s1 JOIN u ON i = n GROUP BY 1, 2) SELECT query, n AS node_id, round(p / sum(p) OVER (PARTITION BY query), 8) AS p FROM b"))
def _(s, d):
    k = kg(s, d).select(F.col("h").alias("node_in"), F.col("r").alias("relation"), F.col("t").alias("node_out"), "weight")
    k = written(k, "triplets")
    both = k.unionByName(k.select(F.col("node_out").alias("node_in"), "relation", F.col("node_in").alias("node_out"), "weight"))
    start = k.where("node_in % 20 = 0").select(F.col("node_in").alias("query"), F.col("node_in").alias("node_id")).distinct()
    return I.relational_walk(both, start, [[0.5, 0.1, 0.2, 0.1, 0.1], [0.1, 0.4, 0.2, 0.2, 0.1]]).withColumn("p", F.round("p", 8))


@query("prefix_enumeration", sql("WITH $sets, n AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1) SELECT set_id, unnest(range(n // 2 + 1)) AS prefix, unnest(range(n // 2 + 1)) * 2 AS n FROM n"))
def _(s, d):
    return I.prefixes(R.sizes_of(sets(s, d)), 2)


_STEPS = ", ".join(f"n{i} AS (SELECT query, e.t AS state, score + w AS score FROM s{i - 1} JOIN e ON e.h = state), s{i} AS (SELECT query, state, score FROM (SELECT query, state, max(score) AS score, row_number() OVER (PARTITION BY query ORDER BY max(score) DESC, state) AS k FROM n{i} WHERE state % 5 <> 0 GROUP BY 1, 2) WHERE k <= 5)" for i in (1, 2, 3))


@query("beam_search", sql(f"WITH $kg, k AS (SELECT h, t, round(ln(weight), 6) AS w FROM kg), e AS (SELECT h, t, w FROM k UNION ALL SELECT t, h, w FROM k), s0 AS (SELECT DISTINCT h AS query, h AS state, 0.0::double AS score FROM kg WHERE h % 20 = 0), {_STEPS} SELECT query, state, round(max(score), 6) AS score FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3) WHERE state % 5 = 0 GROUP BY 1, 2"))
def _(s, d):
    k = kg(s, d).select("h", "t", F.round(F.log(F.col("weight")), 6).alias("w"))
    e = k.unionByName(k.select(F.col("t").alias("h"), F.col("h").alias("t"), "w"))
    start = k.where("h % 20 = 0").select(F.col("h").alias("query"), F.col("h").alias("state")).distinct().withColumn("score", F.lit(0.0))

    def expand(f):
        return f.join(e.withColumnRenamed("h", "state"), "state").select("query", F.col("t").alias("state"), (F.col("score") + F.col("w")).alias("score"), (F.col("t") % 5 == 0).alias("stop"))

    return I.beam(start, expand, 5, 3).withColumn("score", F.round("score", 6))


# -- molecules


def _mols(s, d):
    return C.parsed(table(s, d, "smiles").where("smiles is not null").dropDuplicates(["sample_id"]), form=canonical)


@query("molecule_atoms")
def _(s, d):
    return C.atoms(_mols(s, d))


@query("molecule_atom_counts", "WITH n AS (SELECT DISTINCT graph_id, node_id, atom_type FROM nodes), s AS (SELECT DISTINCT sample_id FROM smiles WHERE smiles IS NOT NULL) SELECT graph_id, atom_type::bigint AS atom_type, count(*) AS n FROM n JOIN s ON sample_id = graph_id WHERE atom_type IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    # What the texts hold against the registry's nodes, for records that have any.
    a = C.atoms(_mols(s, d)).where("atom_type > 1").groupBy("graph_id", F.col("atom_type").cast("long").alias("atom_type")).agg(F.count("*").alias("n"))
    return a.join(table(s, d, "nodes").select("graph_id").distinct(), "graph_id", "left_semi")


@query("molecule_bonds")
def _(s, d):
    return C.bonds(_mols(s, d))


@query("molecule_to_smiles")
def _(s, d):
    return C.to_smiles(_mols(s, d))


@query("explicit_valence")
def _(s, d):
    return C.valences(_mols(s, d))


@query("is_valid")
def _(s, d):
    return C.valid(_mols(s, d), unknown=False)


@query("atom_types", "SELECT DISTINCT atom_type FROM nodes WHERE atom_type IS NOT NULL")
def _(s, d):
    return table(s, d, "nodes").where("atom_type is not null").select("atom_type").distinct()


@query("ion_to_molecule")
def _(s, d):
    return C.neutral(C.valences(_mols(s, d)))


@query("circular_fingerprint")
def _(s, d):
    m = written(_mols(s, d), "molecules")
    n = C.atoms(m).select("graph_id", "node_id", F.concat_ws("|", "atom_type", "formal_charge", "aromatic").alias("key"))
    return I.circular_fingerprint(n, C.bonds(m).select("graph_id", "node_in", "node_out", F.col("bond_order").alias("bond")))


@query("ring_core")
def _(s, d):
    return I.pruned(C.bonds(_mols(s, d)).where("node_in < node_out").select("graph_id", F.col("node_in").alias("a"), F.col("node_out").alias("b")))


# -- loading


@query("vocab_first_seen", "WITH l AS (SELECT sample_id AS line, depositor AS h, source AS t FROM smiles WHERE depositor IS NOT NULL AND source IS NOT NULL), u AS (SELECT h AS token, line, 0 AS side FROM l UNION ALL SELECT t, line, 1 FROM l), f AS (SELECT token, min((line, side)) AS place FROM u GROUP BY 1) SELECT token, row_number() OVER (ORDER BY place, token) - 1 AS id FROM f")
def _(s, d):
    x = table(s, d, "smiles").where("depositor is not null and source is not null")
    r = x.select(F.lit(0).alias("file_ord"), F.col("sample_id").alias("line"), F.col("depositor").alias("h"), F.col("source").alias("t"), F.lit("in").alias("r"))
    return L.contiguous(L.triplets(r)[1])


@query("degree_counts", sql("WITH $kg SELECT h, r, count(*) AS n FROM kg GROUP BY 1, 2"))
def _(s, d):
    return kg(s, d).groupBy("h", "r").agg(F.count("*").alias("n"))


@query("latest_measurements", "SELECT sample_id, task_id, measured_at, arg_max(value, loaded_at) AS value FROM (SELECT DISTINCT * FROM targets) WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2, 3")
def _(s, d):
    t = table(s, d, "targets").where("value is not null and not isnan(value)").distinct()
    return t.groupBy("sample_id", "task_id", "measured_at").agg(F.max_by("value", "loaded_at").alias("value"))


# -- histories


@query("replay_buffer", sql("WITH $ev, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM ev) SELECT user_id, event_id, value FROM r WHERE k <= 5"))
def _(s, d):
    from spindrel.streaming.history import newest

    return newest(ev(s, d), 5).select("user_id", "event_id", "value")


@query("ema_baseline", sql("WITH $ev, h AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS x FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM h) SELECT event_type, count(*) AS n, round(sum(x * CASE WHEN k = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - k) END), 6) AS ema FROM r GROUP BY 1"))
def _(s, d):
    from spindrel.streaming.history import moving_average

    return moving_average(ev(s, d), 0.9)


@query("metric_log", sql("WITH $ev SELECT event_type, date_trunc('hour', ts) AS epoch, count(*) AS n, round(avg(value), 6) AS mean FROM ev GROUP BY 1, 2"))
def _(s, d):
    from spindrel.streaming.history import log_means

    return log_means(ev(s, d)).withColumn("mean", F.round("mean", 6))


@query("discounted_reward", sql("WITH $ev, r AS (SELECT *, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS left_ FROM ev) SELECT event_id, round(value * pow(0.9, left_), 6) AS reward FROM r"))
def _(s, d):
    w = Window.partitionBy("user_id")
    e = ev(s, d).withColumn("left", F.count("*").over(w) - F.row_number().over(w.orderBy("ts", "event_id")))
    return e.select("event_id", F.round(F.col("value") * F.pow(F.lit(0.9), F.col("left")), 6).alias("reward"))


@query("running_top", sql("WITH $pred SELECT id, score FROM pred ORDER BY score DESC, id LIMIT 10"))
def _(s, d):
    return pred(s, d).select("id", "score").orderBy(F.desc("score"), "id").limit(10)
