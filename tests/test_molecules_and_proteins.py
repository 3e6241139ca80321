"""Features, scaffolds, residues and reactions against values worked out by hand or by brute force."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.functions.features import ATOMS, features
from spindrel.operators import graph as G
from spindrel.operators import message as P
from spindrel.operators import protein as T
from spindrel.operators import reaction as X
from spindrel.sources import files as L
from spindrel.sources import molecules as M
from spindrel.sources.catalogue import catalogue


def mols(spark, *smiles):
    return M.parsed(spark.createDataFrame(list(enumerate(smiles)), "sample_id long, smiles string"))


def test_atoms_are_described(spark):
    rows = {(r.graph_id, r.node_id): r for r in M.described(mols(spark, "CCO", "c1ccccc1N", "C1CC1C#N", "[NH4+]", "C=CC=C")).collect()}
    assert [rows[0, k].total_hs for k in range(3)] == [3, 2, 1]
    assert [rows[1, k].total_hs for k in range(7)] == [1, 1, 1, 1, 1, 0, 2] and rows[1, 0].ring_sizes == [6] and not rows[1, 6].in_ring
    assert rows[2, 0].ring_sizes == [3] and rows[2, 3].hybrid == 2 and rows[2, 0].hybrid == 4 and rows[2, 2].total_hs == 1
    assert rows[3, 0].total_hs == 4 and rows[3, 0].formal_charge == 1
    bonds = [r.conjugated for r in M.described(mols(spark, "C=CC=C"), "bond").orderBy("bond_id").collect()]
    assert bonds == [False, True, False]


def test_places_of_features(spark):
    d = M.described(mols(spark, "CC[Xe]"))
    f = [r.f for r in d.withColumn("f", features("atom_symbol")).orderBy("node_id").collect()]
    assert [x.index(1) for x in f] == [ATOMS.index("C")] * 2 + [len(ATOMS)] and all(sum(x) == 1 and len(x) == 18 for x in f)
    g = d.withColumn("f", features("atom_default")).where("node_id = 0").first().f
    assert len(g) == 18 + 4 + 8 + 12 + 8 + 9 + 2 and sum(g) == 6
    assert d.withColumn("f", features("atom_synthon_completion")).first().f[-6:] == [0] * 6
    with pytest.raises(KeyError):
        features("atom_unheard_of")


def test_scaffolds_keep_rings_linkers_and_double_bonds(spark):
    k = [r.scaffold for r in M.scaffolds(mols(spark, "c1ccccc1CC(N)c1ccccc1", "Cc1ccccc1CCc1ccccc1", "O=C1CCCCC1", "CC1CCCCC1=O", "C1CCCCC1", "CCO", "c1ccc(cc1)CCCc1ccccc1")).orderBy("graph_id").collect()]
    assert k[0] == k[1] and k[2] == k[3] and k[5] == "" and len({k[0], k[2], k[4], k[6]}) == 4
    m = [r.molecule for r in M.scaffolds(mols(spark, "OCC", "CCO", "C(O)C", "CCN", "C[C@H](O)N", "C[C@@H](N)O")).orderBy("graph_id").collect()]
    assert m[0] == m[1] == m[2] != m[3] and m[4] == m[5]


def test_reactions_of_both_sides(spark):
    r = spark.createDataFrame([(1, "CC.O>>CCO"), (2, "C(>>CC"), (3, "CC>CC"), (4, None)], "id long, text string")
    assert [(x.id, len(x.reactant_atoms), len(x.product_atoms)) for x in M.reaction_graphs(r, "id", "text").collect()] == [(1, 3, 3)]
    s = spark.createDataFrame([(1, "AC", "CC", "train"), (2, "A", "C(", "train"), (3, None, "C", "test"), (4, "G", "C", "test")], "sample_id long, sequence string, smiles string, split string")
    kept, sizes = M.protein_ligands(s)
    assert {x.sample_id for x in kept.collect()} == {1, 4} and {(x.split, x.n) for x in sizes.collect()} == {("train", 1), ("test", 1)}


def test_one_made_bond_goes_before_changed_ones(spark):
    shape = "graph_id long, a long, b long, bond int"
    p = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 3, 2), (2, 1, 2, 1), (2, 2, 3, 1), (3, 1, 2, 2), (3, 2, 3, 1), (4, 1, 2, 1)], shape)
    r = spark.createDataFrame([(1, 2, 3, 1), (3, 1, 2, 1), (3, 2, 3, 1), (4, 1, 2, 1)], shape)
    c = X.centres(p, r)
    assert {tuple(x) for x in c.collect()} == {(1, 1, 2), (3, 1, 2)}  # 2 makes two bonds, 4 changes none
    assert {tuple(x) for x in X.synthons(p.select("graph_id", "a", "b"), c).collect()} == {(1, 1, 1), (1, 2, 3), (1, 3, 3), (3, 1, 1), (3, 2, 3), (3, 3, 3)}


def test_pairs_and_singles_are_ranked_together(spark):
    s = spark.createDataFrame([("p", 1, -1.0), ("p", 2, -0.5)], "product string, split int, logp double")
    q = spark.createDataFrame([(1, 0, "a", -0.1), (1, 0, "b", -0.3), (1, 1, "c", -0.2), (2, 0, "d", -0.9)], "split int, synthon int, reactant string, logp double")
    got = [(r.first, r.second, round(r.logp, 6)) for r in X.best_products(s, q, 2).orderBy("place").collect()]
    assert got == [("a", "c", -1.3), ("d", None, -1.4)]
    h = X.first_hits(spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "query int, place long, answer string"), spark.createDataFrame([(1, "y"), (2, "q"), (3, "q")], "query int, answer string"))
    assert {(r.query, r.rank) for r in h.collect()} == {(1, 2), (2, None), (3, None)}
    assert X.top_accuracy(h, (1, 3)).first().top_3 == pytest.approx(1 / 3)


def test_set2set_like_numpy(spark):
    rng = np.random.default_rng(0)
    d, steps = 3, 3
    wi, wh, b = rng.normal(size=(4 * d, 2 * d)), rng.normal(size=(4 * d, d)), rng.normal(size=4 * d)
    graphs = {g: rng.normal(size=(n, d)) for g, n in ((1, 4), (2, 1), (3, 7))}
    nodes = spark.createDataFrame([(g, x.tolist()) for g, v in graphs.items() for x in v], "graph_id long, v array<double>")
    got = {r.graph_id: r.y for r in P.set2set(nodes, steps, wi.tolist(), wh.tolist(), b.tolist()).collect()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    for g, v in graphs.items():
        y, h, c = np.zeros(2 * d), np.zeros(d), np.zeros(d)
        for _ in range(steps):
            i, f, n, o = np.split(wi @ y + b + wh @ h, 4)
            c = sig(f) * c + sig(i) * np.tanh(n)
            h = sig(o) * np.tanh(c)
            e = np.exp(v @ h - (v @ h).max())
            y = np.concatenate([h, (e / e.sum()) @ v])
        assert got[g] == pytest.approx(y.tolist())


def test_residues_take_their_atoms_along(spark):
    r = spark.createDataFrame([(1, i, i) for i in range(4)], "graph_id long, residue_id long, residue_type long")
    a = spark.createDataFrame([(1, k, k // 2, "CA" if k % 2 and k < 6 else "N") for k in range(8)], "graph_id long, atom_id long, residue_id long, atom_name string")
    kept, atoms = T.residue_slice(r, a, -3, None, 2)
    assert sorted((x.residue_id, x.residue_type) for x in kept.collect()) == [(0, 1), (1, 3)]
    assert sorted((x.atom_id, x.residue_id) for x in atoms.collect()) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    live, ca = T.alpha_carbons(r, a)
    assert live.count() == 3 and sorted(x.atom_id for x in ca.collect()) == [1, 3, 5]
    with pytest.raises(ValueError):
        T.view(r, a, "chain")


def test_packed_rows_find_their_graph(spark):
    o = spark.createDataFrame([(5, 0, 3), (6, 3, 0), (9, 3, 10)], "graph_id long, node_offset long, num_node long")
    p = spark.createDataFrame([(k,) for k in range(13)], "absolute long")
    got = sorted((r.graph_id, r.node_id) for r in G.unpacked(p, o, 4).collect())
    assert got == [(5, k) for k in range(3)] + [(9, k) for k in range(10)]


def test_lines_of_packed_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.txt", "1\n2\n")
        z.writestr("b.txt", "3\n")
    assert sorted((r.file, r.n) for r in L.line_counts(spark, str(tmp_path / "x.zip")).collect()) == [("a.txt", 2), ("b.txt", 1)]
    spark.range(5).selectExpr("cast(id as string)").coalesce(1).write.option("compression", "gzip").text(str(tmp_path / "t"))
    assert L.line_counts(spark, str(tmp_path / "t")).agg(F.sum("n")).first()[0] == 5


def test_kinds_of_literals(spark):
    cases = {"12": "int", " -3 ": "int", "1.5": "float", ".5e-3": "float", "2e5": "float", "None": "none", "True": "bool", "[1, 2]": "list", "{'a': 1}": "dict", "12a": "text", "": "text"}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.k for r in df.withColumn("k", L.literal_kind(F.col("c"))).collect()} == cases


def test_catalogue_names_readers(spark):
    rows = catalogue(spark).collect()
    assert len(rows) == len({r.name for r in rows}) == 49 and all(r.reader for r in rows)
