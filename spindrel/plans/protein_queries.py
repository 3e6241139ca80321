"""Queries over two levels of proteins, reactions, features, lookups by position, and datasets."""

from pyspark.sql import functions as F

from spindrel.functions import sequence as Q
from spindrel.functions.features import ATOMS, features
from spindrel.functions.smiles import NUMBER, canonical
from spindrel.operators import graph as G
from spindrel.operators import message as P
from spindrel.operators import protein as T
from spindrel.operators import ragged as R
from spindrel.operators import reaction as X
from spindrel.operators import sampling as S
from spindrel.plans.registry import query
from spindrel.plans.views import chain, emb, kg, pg_edges, pg_nodes, pred, sets, sql
from spindrel.session import table
from spindrel.sources import molecules as C
from spindrel.sources.catalogue import catalogue

_KEY = "('0x' || substr(md5(concat_ws('-', {})), 1, 8))::bigint"

# -- residues and their atoms: a residue of type k has k % 3 + 1 atoms, the second of which is its alpha carbon

_ATOM = "atom AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY pos, k) - 1 AS atom_id, pos AS residue_id, k, CASE WHEN k = 1 THEN 'CA' ELSE 'N' END AS atom_name FROM (SELECT graph_id, pos, unnest(range(residue_type % 3 + 1)) AS k FROM chain))"


def levels(s, d):
    from pyspark.sql import Window

    r = chain(s, d).select("graph_id", F.col("pos").alias("residue_id"), "residue_type")
    a = r.select("graph_id", "residue_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("residue_type") % 3)).alias("k"))
    w = Window.partitionBy("graph_id").orderBy("residue_id", "k")
    return r, a.withColumn("atom_id", (F.row_number().over(w) - 1).cast("long")).withColumn("atom_name", F.when(F.col("k") == 1, "CA").otherwise("N"))


@query("residue_to_atoms", sql(f"WITH $chain, {_ATOM}, n AS (SELECT graph_id, count(*) AS n FROM chain GROUP BY 1) SELECT a.graph_id, n - 1 - residue_id AS pos, atom_id FROM atom a JOIN n USING (graph_id) WHERE residue_id % 2 = 0"))
def _(s, d):
    r, a = levels(s, d)
    n = r.groupBy("graph_id").agg(F.count("*").alias("n"))
    q = r.where("residue_id % 2 = 0").join(n, "graph_id").select("graph_id", (F.col("n") - 1 - F.col("residue_id")).alias("pos"), "residue_id")
    return T.residue_atoms(q, a)


_SUBSET = "r AS (SELECT graph_id, pos, row_number() OVER (PARTITION BY graph_id ORDER BY pos) - 1 AS k FROM ({})), a AS (SELECT atom.graph_id, row_number() OVER (PARTITION BY atom.graph_id ORDER BY atom_id) - 1 AS atom_id, r.k AS residue_id, atom_name FROM atom JOIN r ON r.graph_id = atom.graph_id AND r.pos = residue_id)"


@query("residue_subset_atoms", sql(f"WITH $chain, {_ATOM}, {_SUBSET.format('SELECT graph_id, pos FROM chain WHERE residue_type < 10')} SELECT * FROM a"))
def _(s, d):
    return T.residue_subset(*levels(s, d), "residue_type < 10")[1].select("graph_id", "atom_id", "residue_id", "atom_name")


@query("residue_slice", sql(f"WITH $chain, {_ATOM}, {_SUBSET.format('SELECT graph_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY graph_id) AS n FROM chain) WHERE pos >= 1 AND pos < n - 1 AND (pos - 1) % 2 = 0')} SELECT * FROM a"))
def _(s, d):
    return T.residue_slice(*levels(s, d), 1, -1, 2)[1].select("graph_id", "atom_id", "residue_id", "atom_name")


@query("protein_view", sql(f"WITH $chain, {_ATOM} SELECT graph_id, atom_id AS node_id, 'atom' AS level FROM atom UNION ALL SELECT graph_id, pos, 'residue' FROM chain"))
def _(s, d):
    r, a = levels(s, d)
    both = [T.view(r, a, x).select("graph_id", "node_id", F.lit(x).alias("level")) for x in ("atom", "residue")]
    return both[0].unionByName(both[1])


@query("alpha_carbons", sql(f"WITH $chain, {_ATOM} SELECT graph_id, residue_id, min(atom_id) AS atom_id FROM atom WHERE atom_name = 'CA' GROUP BY 1, 2"))
def _(s, d):
    return T.alpha_carbons(*levels(s, d))[1].select("graph_id", "residue_id", "atom_id")


@query("subspace_nodes", sql(f"WITH $emb, n AS (SELECT label AS graph_id, vec_id AS node_id, v[1] AS x, v[2] AS y, v[3] AS z FROM emb), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {_KEY.format('3, graph_id, node_id')}, node_id) AS k FROM n) WHERE k = 1), d AS (SELECT n.graph_id, n.node_id, sqrt(pow(n.x - c.x, 2) + pow(n.y - c.y, 2) + pow(n.z - c.z, 2)) AS d FROM n JOIN c USING (graph_id)), r AS (SELECT graph_id, max(d) AS r FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY d, node_id) AS k FROM d) WHERE k <= 10 GROUP BY 1) SELECT graph_id, node_id FROM d JOIN r USING (graph_id) WHERE d < greatest(1.5 * r, 0.05)"))
def _(s, d):
    n = emb(s, d).select(F.col("label").alias("graph_id"), F.col("vec_id").alias("node_id"), F.slice("v", 1, 3).alias("position"))
    return T.subspace(n, 10, 0.05, 3).select("graph_id", "node_id")


@query("filtered_ids", "SELECT c_custkey FROM customer WHERE split_part(c_name, '#', 2) NOT IN (SELECT split_part(c_name, '#', 2) FROM customer WHERE c_nationkey < 5) OR split_part(c_name, '#', 2) = ''")
def _(s, d):
    c = table(s, d, "customer").withColumn("tail", F.concat(F.split("c_name", "#")[1], F.lit("_A")))
    ids = c.where("c_nationkey < 5").select(F.split("c_name", "#")[1].alias("id"))
    return T.without_ids(c, "tail", ids).select("c_custkey")


@query("truncated_contacts", sql("WITH $chain SELECT graph_id, pos AS residue_id, residue_type FROM chain WHERE pos < 4"))
def _(s, d):
    return levels(s, d)[0].where("residue_id < 4")


@query("pair_residues", sql("WITH $chain SELECT a.graph_id AS sample_id, 1 AS side, a.pos, a.residue_type FROM chain a WHERE EXISTS (SELECT 1 FROM chain b WHERE b.graph_id = a.graph_id + 1) UNION ALL SELECT graph_id - 1, 2, pos, residue_type FROM chain c WHERE EXISTS (SELECT 1 FROM chain b WHERE b.graph_id = c.graph_id - 1)"))
def _(s, d):
    t = Q.sequence_text(chain(s, d), Q.RESIDUES)
    pairs = t.select(F.col("graph_id").alias("sample_id"), F.col("sequence").alias("sequence_1")).join(t.select((F.col("graph_id") - 1).alias("sample_id"), F.col("sequence").alias("sequence_2")), "sample_id")
    return T.paired_residues(pairs, Q.RESIDUES)


@query("pair_logits", sql("WITH $chain SELECT a.graph_id, a.pos AS a, b.pos AS b, round(0.001 * a.q * b.q - 0.05 * abs(a.q - b.q) + 0.1, 6) AS logit FROM chain a JOIN chain b ON a.graph_id = b.graph_id AND b.pos > a.pos"))
def _(s, d):
    c = chain(s, d)
    j = c.select("graph_id", F.col("pos").alias("a"), F.col("q").alias("x")).join(c.select("graph_id", F.col("pos").alias("b"), F.col("q").alias("y")), "graph_id").where("b > a")
    return T.pair_head(j, (0.001, -0.05), 0.1).select("graph_id", "a", "b", F.round("logit", 6).alias("logit"))


@query("ligand_split_sizes", "WITH m AS (SELECT sample_id, min(lower(trim(split))) AS split FROM smiles WHERE smiles IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT protein_id FROM sequences WHERE length(sequence) > 0) SELECT split, count(*) AS n FROM m JOIN p ON protein_id = sample_id GROUP BY 1")
def _(s, d):
    m = table(s, d, "smiles").where("smiles is not null").groupBy("sample_id").agg(F.min("smiles").alias("smiles"), F.min(F.lower(F.trim("split"))).alias("split"))
    p = table(s, d, "sequences").where("length(sequence) > 0").groupBy(F.col("protein_id").alias("sample_id")).agg(F.min("sequence").alias("sequence"))
    return C.protein_ligands(m.join(p, "sample_id"), canonical)[1]


# -- reactions: chains of lines as products; bonds of many pieces are missing before, some are of another kind

_B = "b AS (SELECT graph_id, pos AS a, pos + 1 AS b, residue_type % 3 AS bond, q FROM (SELECT *, count(*) OVER (PARTITION BY graph_id) AS n FROM chain) WHERE pos + 1 < n)"
_D = "x AS (SELECT graph_id, a, b, q > 40 AS made FROM b WHERE q > 40 OR q > 30 AND bond <> 0), y AS (SELECT graph_id, made, count(*) AS n, min(a) AS a, min(b) AS b, max(made::int) OVER (PARTITION BY graph_id) AS m FROM x GROUP BY graph_id, made), c AS (SELECT graph_id, a, b FROM y WHERE n = 1 AND (made OR m = 0))"


def _bonds(s, d):
    c = chain(s, d)
    n = c.groupBy("graph_id").agg(F.count("*").alias("n"))
    p = c.join(n, "graph_id").where("pos + 1 < n").select("graph_id", F.col("pos").alias("a"), (F.col("pos") + 1).alias("b"), (F.col("residue_type") % 3).alias("bond"), "q")
    return p, p.where("q <= 40").withColumn("bond", F.when(F.col("q") > 30, F.lit(0).cast("long")).otherwise(F.col("bond")))


@query("reaction_centre", sql(f"WITH $chain, {_B}, {_D} SELECT * FROM c"))
def _(s, d):
    return X.centres(*_bonds(s, d))


@query("synthons", sql(f"WITH $chain, {_B}, {_D}, n AS (SELECT graph_id, count(*) AS n FROM chain GROUP BY 1) SELECT chain.graph_id, pos AS node_id, CASE WHEN pos <= c.a THEN c.a ELSE n - 1 END AS synthon FROM chain JOIN c ON c.graph_id = chain.graph_id JOIN n ON n.graph_id = chain.graph_id"))
def _(s, d):
    p, r = _bonds(s, d)
    return X.synthons(p, X.centres(p, r))


@query("reaction_features", sql("WITH $pn SELECT a.graph_id, a.node_id, b.node_id AS synthon_node, b.node_id IS NULL AS is_new, coalesce(a.node_id % 5 <> b.node_id % 7, false) AS is_modified FROM pn a LEFT JOIN (SELECT * FROM pn WHERE flag AND node_id % 3 <> 0) b ON a.graph_id = b.graph_id AND a.node_id = b.node_id"))
def _(s, d):
    n = pg_nodes(s, d)
    a = n.select("graph_id", "node_id", F.col("node_id").alias("atom_map"), (F.col("node_id") % 5).alias("kind"))
    b = n.where("flag").select("graph_id", "node_id", F.when(F.col("node_id") % 3 == 0, 0).otherwise(F.col("node_id")).alias("atom_map"), (F.col("node_id") % 7).alias("kind"))
    return X.mapped_nodes(a, b)


_PREDICT = "sp AS (SELECT o_custkey AS product, o_orderkey AS split, round(o_totalprice / 1000) AS logp FROM orders), pr AS (SELECT graph_id AS split, pos % 2 AS synthon, pos AS reactant, q AS l FROM chain), n AS (SELECT split, count(DISTINCT synthon) AS n FROM pr GROUP BY 1), e AS (SELECT a.split, a.reactant AS first, b.reactant AS second, a.l + b.l AS l FROM pr a JOIN pr b ON a.split = b.split AND a.synthon < b.synthon UNION ALL SELECT pr.split, reactant, NULL, l FROM pr JOIN n ON n.split = pr.split WHERE n = 1), best AS (SELECT product, row_number() OVER (PARTITION BY product ORDER BY logp + l DESC, sp.split, first, second NULLS FIRST) - 1 AS place, sp.split, first, second, logp + l AS logp FROM sp JOIN e ON e.split = sp.split)"


def _predicted(s, d):
    splits = table(s, d, "orders").select(F.col("o_custkey").alias("product"), F.col("o_orderkey").alias("split"), F.round(F.col("o_totalprice") / 1000).alias("logp"))
    p = chain(s, d).select(F.col("graph_id").alias("split"), (F.col("pos") % 2).alias("synthon"), F.col("pos").alias("reactant"), F.col("q").alias("logp"))
    return X.best_products(splits, p, 6)


@query("retrosynthesis_predict", sql(f"WITH $chain, {_PREDICT} SELECT * FROM best WHERE place < 6"))
def _(s, d):
    return _predicted(s, d)


@query("retrosynthesis_accuracy", sql(f"WITH $chain, {_PREDICT}, h AS (SELECT product, min(place) FILTER (first = product % 4) + 1 AS rank FROM best WHERE place < 6 GROUP BY 1) SELECT round(avg(coalesce((rank <= 1)::int, 0)), 8) AS top_1, round(avg(coalesce((rank <= 3)::int, 0)), 8) AS top_3, round(avg(coalesce((rank <= 5)::int, 0)), 8) AS top_5 FROM h"))
def _(s, d):
    p = _predicted(s, d).select(F.col("product").alias("query"), "place", F.col("first").alias("answer"))
    t = p.select("query", (F.col("query") % 4).alias("answer")).distinct()
    a = X.top_accuracy(X.first_hits(p, t), (1, 3, 5))
    return a.select(*[F.round(c, 8).alias(c) for c in a.columns])


# -- readouts and properties

_GATES = ([[0.3, -0.2], [0.1, 0.4], [0.5, 0.2], [-0.3, 0.6]], [[0.2], [-0.1], [0.4], [0.3]], [0.1, 0.2, 0.3, 0.4])


def _lstm(k, q, r, h, c):
    """One step in SQL: gates from the last question, answer, and state."""
    z = [f"({w[0]} * {q} + {w[1]} * {r} + {_GATES[2][i]} + {_GATES[1][i][0]} * {h})" for i, w in enumerate(_GATES[0])]
    sg = lambda x: f"(1 / (1 + exp(-{x})))"
    return f"(SELECT *, {sg(z[3])} * tanh(c{k}) AS h{k} FROM (SELECT *, {sg(z[1])} * {c} + {sg(z[0])} * tanh({z[2]}) AS c{k} FROM {{}}))"


_ANSWER = "(SELECT graph_id, sum(exp(s) * x) / sum(exp(s)) AS r{k} FROM (SELECT n.graph_id, x, x * h{k} - max(x * h{k}) OVER (PARTITION BY n.graph_id) AS s FROM n JOIN t{k} USING (graph_id)) GROUP BY 1)"


@query("set2set", sql(f"WITH $pn, n AS (SELECT graph_id, value / 5000 AS x FROM pn), t1 AS {_lstm(1, '0', '0', '0', '0').format('(SELECT DISTINCT graph_id FROM n)')}, r1 AS {_ANSWER.format(k=1)}, t2 AS {_lstm(2, 'h1', 'r1', 'h1', 'c1').format('(SELECT * FROM t1 JOIN r1 USING (graph_id))')}, r2 AS {_ANSWER.format(k=2)} SELECT graph_id, round(h2, 6) AS question, round(r2, 6) AS answer FROM t2 JOIN r2 USING (graph_id)"))
def _(s, d):
    n = pg_nodes(s, d).select("graph_id", F.array(F.col("value") / 5000).alias("v"))
    y = P.set2set(n, 2, *_GATES)
    return y.select("graph_id", F.round(F.col("y")[0], 6).alias("question"), F.round(F.col("y")[1], 6).alias("answer"))


@query("sort_readout", sql("WITH $pn SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY value DESC, node_id) - 1 AS place, value, node_id FROM pn"))
def _(s, d):
    n = pg_nodes(s, d).select(F.col("graph_id").alias("set_id"), F.col("node_id").alias("pos"), "value")
    return R.ragged_sort(n, descending=True).select(F.col("set_id").alias("graph_id"), "place", "value", F.col("pos").alias("node_id"))


_PROPS = "p AS (SELECT t AS residue_type, k AS property, CASE WHEN t = 19 AND k = 2 THEN 0 ELSE (t * 7 + k * 3) % 11 + 0.1 * k END::double AS v FROM range(20) a(t), range(8) b(k)), z AS (SELECT residue_type, property, (v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-10) AS x FROM p WINDOW w AS (PARTITION BY property))"


def _properties(s):
    g = s.range(160).select((F.col("id") % 20).alias("residue_type"), F.floor(F.col("id") / 20).alias("property"))
    v = (F.col("residue_type") * 7 + F.col("property") * 3) % 11 + 0.1 * F.col("property")
    return g.withColumn("value", F.when((F.col("residue_type") == 19) & (F.col("property") == 2), F.lit(None)).otherwise(v))


@query("standardised_properties", f"WITH {_PROPS} SELECT residue_type, property, round(x, 8) AS x FROM z")
def _(s, d):
    return Q.standardised(_properties(s)).withColumn("x", F.round("x", 8))


@query("property_autocorrelation", sql(f"WITH $chain, {_PROPS}, m AS (SELECT graph_id, property, pos, x, avg(x) OVER w AS m, var_pop(x) OVER w AS v FROM chain JOIN z USING (residue_type) WINDOW w AS (PARTITION BY graph_id, property)), j AS (SELECT a.*, b.x AS y, b.pos - a.pos AS lag FROM m a JOIN m b ON a.graph_id = b.graph_id AND a.property = b.property AND b.pos - a.pos BETWEEN 1 AND 2) SELECT property, lag, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT graph_id, property, lag, avg(x * y) AS value FROM j GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def _(s, d):
    a = Q.property_autocorrelation(chain(s, d), _properties(s), 2, "broto")
    return a.groupBy("property", "lag").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


# -- features

_PLACES = "t AS (SELECT a, i - 1 AS place FROM (SELECT unnest([{}]) AS a, unnest(range(1, {})) AS i))".format(", ".join(str(NUMBER[a]) for a in ATOMS), len(ATOMS) + 1)


def _molecules(s, d):
    return C.parsed(table(s, d, "smiles").where("smiles is not null").dropDuplicates(["sample_id"]), form=canonical)


@query("atom_symbol", f"WITH {_PLACES}, n AS (SELECT DISTINCT graph_id, node_id, atom_type FROM nodes), s AS (SELECT DISTINCT sample_id FROM smiles WHERE smiles IS NOT NULL) SELECT graph_id, coalesce(place, {len(ATOMS)})::bigint AS place, count(*) AS n FROM n JOIN s ON sample_id = graph_id LEFT JOIN t ON a = atom_type GROUP BY 1, 2")
def _(s, d):
    a = C.described(_molecules(s, d)).join(table(s, d, "nodes").select("graph_id").distinct(), "graph_id", "left_semi")
    f = a.where("atom_type > 1").select("graph_id", F.posexplode(features("atom_symbol")).alias("place", "x"))
    return f.where("x = 1").groupBy("graph_id", F.col("place").cast("long").alias("place")).agg(F.count("*").alias("n"))


@query("residue_default", sql("WITH $chain SELECT graph_id, pos, residue_type AS place, 21 AS width FROM chain"))
def _(s, d):
    f = chain(s, d).withColumn("f", features("residue_default"))
    return f.select("graph_id", "pos", (F.array_position("f", 1) - 1).alias("place"), F.size("f").alias("width"))


for name in ("atom_default", "atom_center_identification", "atom_synthon_completion", "atom_explicit_property_prediction", "atom_property_prediction", "atom_pretrain", "bond_default", "bond_property_prediction", "bond_pretrain"):

    @query(name)
    def _(s, d, name=name):
        x = C.described(_molecules(s, d), name[:4])
        f = x.withColumn("f", features(name)).select("graph_id", F.col("node_id" if name[0] == "a" else "bond_id").alias("item"), F.concat_ws("", F.col("f").cast("array<string>")).alias("features"))
        return f


@query("bond_types")
def _(s, d):
    return C.bonds(_molecules(s, d)).select("bond_order").distinct()


@query("bond_length", sql("WITH $emb SELECT a.vec_id AS node_in, b.vec_id AS node_out, round(sqrt(pow(a.v[1] - b.v[1], 2) + pow(a.v[2] - b.v[2], 2) + pow(a.v[3] - b.v[3], 2)), 6) AS length FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1"))
def _(s, d):
    from spindrel.functions.vectors import distance

    e = emb(s, d).select("vec_id", F.slice("v", 1, 3).alias("p"))
    j = e.select(F.col("vec_id").alias("node_in"), F.col("p").alias("a")).join(e.select((F.col("vec_id") - 1).alias("node_in"), F.col("vec_id").alias("node_out"), F.col("p").alias("b")), "node_in")
    return j.select("node_in", "node_out", F.round(distance(F.col("a"), F.col("b")), 6).alias("length"))


@query("scaffolds")
def _(s, d):
    return C.scaffolds(_molecules(s, d))


@query("scaffold_split")
def _(s, d):
    k = C.scaffolds(_molecules(s, d)).withColumn("key", F.xxhash64("scaffold"))
    return S.key_split(k.select("graph_id", "key"), "key", [0.8, 0.1, 0.1], 4).select("graph_id", "key", "part")


@query("ordered_scaffold_split")
def _(s, d):
    k = C.scaffolds(_molecules(s, d)).withColumn("key", F.xxhash64("scaffold"))
    return S.ordered_group_split(k.select("graph_id", "key"), "key", "graph_id").select("graph_id", "key", "part")


@query("equal_molecules")
def _(s, d):
    k = C.scaffolds(_molecules(s, d))
    first = k.groupBy("molecule").agg(F.min("graph_id").alias("first"), F.count("*").alias("n"))
    return k.join(first.where("n > 1"), "molecule").select("graph_id", "first")


@query("dataset_catalogue", "SELECT * FROM (VALUES ('molecule', 22), ('node', 3), ('protein', 12), ('protein_ligand', 2), ('protein_pair', 3), ('reaction', 1), ('triplet', 6)) t(kind, n)")
def _(s, d):
    return catalogue(s).groupBy("kind").agg(F.count("*").cast("int").alias("n"))


# -- lookups by position, batches, packed numbers


@query("triplet_at", sql("WITH $kg, n AS (SELECT *, row_number() OVER (ORDER BY h * 1000000000 + t * 10 + r) - 1 AS k FROM kg) SELECT x.pos, h, r, t FROM n JOIN (SELECT range AS pos, range * 7 % 500 AS k FROM range(900)) x USING (k)"))
def _(s, d):
    k = kg(s, d).withColumn("key", F.col("h") * 1_000_000_000 + F.col("t") * 10 + F.col("r"))
    i = s.range(900).select(F.col("id").alias("pos"), (F.col("id") * 7 % 500).alias("at"))
    return G.at_positions(k, "key", i).select("pos", "h", "r", "t")


@query("sample_slice", "SELECT sample_id FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS k FROM (SELECT DISTINCT sample_id FROM smiles)) WHERE k >= 10 AND k % 3 = 1")
def _(s, d):
    from spindrel.operators.ordered import numbered

    x = table(s, d, "smiles").select("sample_id").distinct()
    return numbered(x, "sample_id", name="at").where("at >= 10 and at % 3 = 1").select("sample_id")


@query("batches", sql("WITH $pred, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM pred) SELECT id, k // 64 AS batch_id, k % 64 AS place FROM n"))
def _(s, d):
    return G.batches(pred(s, d).select("id"), "id", 64)


@query("shuffled_batches", sql(f"WITH $pred, n AS (SELECT id, row_number() OVER (ORDER BY {_KEY.format('5, id')}, id) - 1 AS k FROM pred) SELECT id, k // 64 AS batch_id, k % 64 AS place FROM n"))
def _(s, d):
    return G.batches(pred(s, d).select("id"), "id", 64, 5)


@query("unpack", sql("WITH $pn SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS node_id, value FROM pn"))
def _(s, d):
    g = G.Graphs(pg_nodes(s, d), pg_edges(s, d))
    packed = G.absolute_ids(g).join(g.nodes.select("graph_id", "node_id", "value"), ["graph_id", "node_id"]).select("absolute", "value")
    return G.unpacked(packed, g.offsets())


@query("shuffled_attribute", sql(f"WITH $sets, d AS (SELECT set_id, value, row_number() OVER (PARTITION BY set_id ORDER BY {_KEY.format('6, set_id, pos')}, pos) - 1 AS pos FROM sets) SELECT set_id, pos, value FROM d"))
def _(s, d):
    return S.shuffled(sets(s, d), "set_id", "pos", "value", 6)


@query("stratified_split", f"WITH n AS (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY {_KEY.format('4, o_custkey')}, o_custkey) - n / 2 AS mid, sum(n) OVER (PARTITION BY o_orderpriority) AS total FROM n) SELECT o_orderkey, ((mid > 0.8 * total)::int + (mid > 0.9 * total)::int)::bigint AS part FROM orders JOIN u USING (o_orderpriority, o_custkey)")
def _(s, d):
    return S.stratified_key_split(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", [0.8, 0.1, 0.1], 4).select("o_orderkey", "part")


@query("pooled_means", sql("WITH $pred SELECT set_id, round(avg(score), 4) AS score FROM (SELECT * FROM pred UNION ALL SELECT * FROM pred WHERE target = 1) GROUP BY 1"))
def _(s, d):
    p = pred(s, d)
    return G.pooled([p, p.where("target = 1")], ["set_id"], "score", "mean").withColumn("score", F.round("score", 4))


@query("dictionary_map", sql("WITH $kg, n AS (SELECT h, r, count(*) AS n FROM kg GROUP BY 1, 2) SELECT h, string_agg(r || ':' || n, ',' ORDER BY r) AS entries FROM n GROUP BY 1"))
def _(s, d):
    m = G.as_map(kg(s, d).groupBy("h", "r").agg(F.count("*").alias("n")), "r", "n", ["h"])
    return m.select("h", F.concat_ws(",", F.transform(F.map_entries("map"), lambda e: F.concat_ws(":", e["key"], e["value"]))).alias("entries"))


@query("property_predict", sql("WITH $emb, w AS (SELECT vec_id, label, 0.5 * v[1] - 0.25 * v[2] + 0.1 AS y FROM emb), t AS (SELECT label, avg(v[4]) AS m, stddev_samp(v[4]) AS s FROM emb GROUP BY 1) SELECT vec_id, round(y * s + m, 6) AS y FROM w JOIN t USING (label)"))
def _(s, d):
    e = emb(s, d)
    t = e.groupBy("label").agg(F.avg(F.col("v")[3]).alias("m"), F.stddev_samp(F.col("v")[3]).alias("s"))
    y = P.dense_layer(e.select("vec_id", "label", F.slice("v", 1, 2).alias("v")), [[0.5, -0.25]], [0.1]).withColumn("y", F.col("v")[0])
    return y.join(t, "label").select("vec_id", F.round(F.col("y") * F.col("s") + F.col("m"), 6).alias("y"))


@query("prefix_likelihood", sql("WITH $sets, x AS (SELECT set_id, pos, value / 1000 - max(value / 1000) OVER (PARTITION BY set_id) AS x, count(*) OVER (PARTITION BY set_id) AS n FROM sets), l AS (SELECT set_id, pos, n, x - ln(sum(exp(x)) OVER (PARTITION BY set_id)) AS p FROM x) SELECT set_id, round(avg(p) FILTER (pos < n // 2 + 1), 9) AS log_likelihood FROM l GROUP BY 1"))
def _(s, d):
    x = sets(s, d).withColumn("value", F.col("value") / 1000)
    j = R.ragged_softmax(x, log=True).join(R.sizes_of(x), "set_id")
    return j.groupBy("set_id").agg(F.round(F.avg(F.when(F.col("pos") < F.floor(F.col("size") / 2) + 1, F.col("p"))), 9).alias("log_likelihood"))
