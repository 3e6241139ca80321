import pytest

from spindrel.functions.registry import Registry, duration, flatten, means, nested
from spindrel.sources import files as L
from spindrel.sources import molecules as C
from spindrel.streaming import history as H


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_triplets_share_vocabulary(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("b\tlikes\ta\na\tlikes\tc\n")
    (tmp_path / "b.tsv").write_text("c\thas\tb\r\nd\thas\ta\r\n")
    t, ent, rel = L.read_triplets(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")])
    assert rows(ent) == [("a", 1), ("b", 0), ("c", 2), ("d", 3)] and rows(rel) == [("has", 1), ("likes", 0)]
    assert rows(t) == [(0, 0, 0, 1, 0), (0, 1, 1, 2, 0), (1, 0, 2, 0, 1), (1, 1, 3, 1, 1)]
    with pytest.raises(ValueError):
        L.contiguous(spark.createDataFrame([("a", 0), ("b", 2)], "token string, id long"))


def test_nodes_with_unseen_ends(spark, tmp_path):
    (tmp_path / "n").write_text("x\t1\t2\tred\ny\t3\t4\tblue\n")
    (tmp_path / "e").write_text("x\tz\ny\tx\n")
    n, e = L.read_nodes(spark, str(tmp_path / "n"), str(tmp_path / "e"))
    assert rows(n) == [(0, "x", [1.0, 2.0], 0), (1, "y", [3.0, 4.0], 1), (2, "z", [0.0, 0.0], 0)] and rows(e) == [(0, 2), (1, 0)]


def test_csv_targets(spark, tmp_path):
    (tmp_path / "m.csv").write_text("smiles,y,z\nCCO,1.5,\nCC,oops,2\n,,\n")
    got = L.read_csv_targets(spark, str(tmp_path / "m.csv")).collect()
    assert [r.smiles for r in got] == ["CCO", "CC"] and got[0].y == 1.5 and got[0].z != got[0].z and got[1].y != got[1].y


def test_fasta(spark, tmp_path):
    (tmp_path / "s.fa").write_text("junk\n>one x\nACD\nEF\n\n>two\n>three\nGG\n")
    got = L.fasta(L.numbered_lines(spark, str(tmp_path / "s.fa"))).select("record", "name", "sequence")
    assert rows(got) == [(0, "one x", "ACDEF"), (1, "two", ""), (2, "three", "GG")]


PDB = """HEADER    nothing
ATOM      1  N   GLY A   1      11.104   6.134  -6.504  1.00  0.00           N
ATOM      2  CA  GLY A   1      11.639   6.071  -5.147  1.00  0.00           C
ATOM      3  N   ALA A   2A      9.639   6.071  -5.147  1.00  0.00           N
HETATM    4  O   HOH B   1       1.000   2.000   3.000  0.50 10.00           O
ATOM      5  broken
"""


def test_pdb_round_trip(spark, tmp_path):
    (tmp_path / "p.pdb").write_text(PDB)
    a = L.pdb_residues(L.pdb_atoms(L.numbered_lines(spark, str(tmp_path / "p.pdb")))).orderBy("line")
    got = a.collect()
    assert [r.residue_id for r in got] == [0, 0, 1, 2] and got[2].insertion_code == "A" and got[3].hetero and got[1].x == 11.639
    assert [r.value for r in L.pdb_lines(a).orderBy("line").collect()] == PDB.splitlines()[1:5]


def test_molecules(spark):
    df = spark.createDataFrame([(1, "C[N+](=O)[O-]"), (2, "CN(C)(C)(C)C"), (3, "xq"), (4, None), (5, "c1ccccc1")], "sample_id long, smiles string")
    g = C.parsed(df)
    assert {r.id for r in g.collect()} == {1, 2, 5}
    assert {r.graph_id: r.valid for r in C.valid(g).collect()} == {1: True, 2: False, 5: True}
    assert rows(C.bonds(g).where("graph_id = 1").select("edge_id", "node_in", "node_out"))[:2] == [(0, 0, 1), (1, 1, 0)]
    assert {r.valence for r in C.valences(g).where("graph_id = 5").collect()} == {3}
    with pytest.raises(Exception, match="no SMILES"):
        C.parsed(df, strict=True).collect()
    r = spark.createDataFrame([(1, "CC>O>CO"), (2, "CC")], "id long, t string")
    assert rows(C.reactions(r, "id", "t")) == [(1, "CC", "O", "CO")]


def test_streams_like_tables(spark, tmp_path):
    ev = spark.createDataFrame([(i, f"2024-01-01 0{i % 6}:00:0{i % 10}", i % 3, "ab"[i % 2], float(i)) for i in range(30)], "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    s = H.read_events(spark, str(tmp_path / "in"), ev.schema, 3)
    q = H.stream_means(s, late="1 day").writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("means").selectExpr("event_type", "n", "mean")) == rows(H.log_means(ev).selectExpr("event_type", "n", "mean"))
    q = H.stream_newest(s, 4).writeStream.format("memory").queryName("newest").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    last = {r.user_id: sorted(r.event_ids) for r in spark.table("newest").orderBy("n_seen").collect()}
    want: dict = {}
    for r in H.newest(ev, 4).collect():
        want.setdefault(r.user_id, []).append(r.event_id)
    assert last == {k: sorted(v) for k, v in want.items()}


def test_registry_and_settings():
    reg = Registry()
    reg.register("readout.mean", max)
    reg.register("pool.mean", min)
    assert reg.get("readout.mean") is max and reg.search("pool.mean") is min
    with pytest.raises(KeyError, match="several"):
        reg.search("mean")
    with pytest.raises(KeyError):
        reg.search("other")
    with pytest.raises(KeyError):
        reg.register("pool.mean", sum)
    assert nested(flatten({"a": {"b": 1}, "c": 2})) == {"a": {"b": 1}, "c": 2}
    assert means([{"a": {"b": 1}}, {"a": {"b": 3}}]) == {"a": {"b": 2}}
    assert duration(7200) == "2.00 hours" and duration(1) == "1.00 secs"


def test_smiles_round_trip(spark, sf):
    import pandas as pd

    from spindrel.functions.smiles import parse, problem, write

    def shape(g):
        atoms, bonds = g
        degree = [0.0] * len(atoms)
        ends = []
        for a, b, o, _ in bonds:
            degree[a] += o
            degree[b] += o
        for a, b, o, _ in bonds:
            ends.append((o, *sorted([(atoms[a][0], degree[a]), (atoms[b][0], degree[b])])))
        return sorted((x[0], x[1], x[2], x[3], d) for x, d in zip(atoms, degree)), sorted(ends)

    texts = [t.strip() for t in pd.read_parquet(f"{sf}/smiles.parquet").smiles.dropna() if problem(t.strip()) is None]
    texts += ["C1CC2CC1CC2.[Na+].O", "c1ccccc1-c1ccccc1", "C" * 3000, "*C#N", "[13CH3:2]C", "C%12CCCCC%12", "C12C3C4C1C5C2C3C45"]
    assert len(texts) > 50
    for t in texts:
        g = parse(t)
        again = write(*g)
        assert problem(again) is None and shape(parse(again)) == shape(g), (t, again)
    assert write([], []) == ""
    df = spark.createDataFrame([(1, "CC(=O)[O-]"), (2, "c1ccsc1")], "sample_id long, smiles string")
    assert rows(C.to_smiles(C.parsed(df))) == [(1, "CC(=O)[O-]"), (2, "c1ccsc1")]


def test_lines_of_blocks_are_numbered_through(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 50) for k in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\r\ntwo\r\n\r\nfour")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        rows = L.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    got = {}
    for r in rows:
        got.setdefault(r.file[-5:], {})[r.line] = r.value
    assert [got["a.txt"][k] for k in range(3000)] == lines and len(got["a.txt"]) == 3000
    assert got["b.txt"] == {0: "one", 1: "two", 2: "", 3: "four"}
