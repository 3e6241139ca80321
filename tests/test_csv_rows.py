import pyarrow as pa

from spindrel.functions.smiles import canonical, parse, problem
from spindrel.sources.csv_rows import REASONS, Field, check_lines, parted_rows, read_csv_lines, rejected_rows, valid_rows

LINES = [
    ("CCO,ethanol,1.5,-2e3,1,cell", None),
    ('"CCO"," a ""b"" , c ", .5 ," 5. ","0",', None),
    ("", "skip"),
    (" , , ,,, ", "skip"),
    ('"",,', "skip"),
    (None, "skip"),
    ('CCO,5" tube,1,1,1,x', "quoting"),
    ('CCO,"a" old,1,1,1,x', "quoting"),
    ('CCO,a,1,1,1,"x', "quoting"),
    ('"a"b","x', "quoting"),
    ("CCO,a,1,1,1", "column_count"),
    ("CCO,a,1,1,1,x,y", "column_count"),
    ("CCO;a;1;1;1;x", "column_count"),
    (",a,1,1,1,x", "bad_smiles"),
    ("C(,a,1,1,1,x", "bad_smiles"),
    ("C1CC,a,1,1,1,x", "bad_smiles"),
    ("[Xq],a,x,1,1,x", "bad_smiles"),
    ("-,a,1,1,1,x", "bad_smiles"),
    ("CCO,a,1e,1,1,x", "bad_target"),
    ("CCO,a,1,0x1F,1,x", "bad_target"),
    ("CCO,a,1,1,2,x", "bad_target"),
    ("CCO,a,nan,1,1,x", "bad_target"),
    ("CCO,a,,,,", None),
]


def checked(lines):
    valid, columns, rejected, why = check_lines(pa.array(lines, pa.string()))
    return dict(zip(valid.tolist(), zip(*(c.to_pylist() for c in columns)))), dict(zip(rejected.tolist(), [REASONS[k] for k in why]))


def test_reasons_in_order():
    for cut in (0, 1, 5):  # arrays that begin within a buffer, too
        rows, reasons = checked(pa.array([x for x, _ in LINES], pa.string()).slice(cut).to_pylist())
        assert reasons == {k: w for k, (_, w) in enumerate(LINES[cut:]) if w not in (None, "skip")}
        assert set(rows) == {k for k, (_, w) in enumerate(LINES[cut:]) if w is None}
    valid, columns, rejected, _ = check_lines(pa.array([x for x, _ in LINES], pa.string()).slice(1))
    assert [c.to_pylist()[0] for c in columns] == ["CCO", 'a "b" , c', ".5", "5.", "0", ""]
    assert checked([]) == ({}, {})


def test_bad_last_field_closes_on_its_own_line():
    rows, reasons = checked(['CCO,a,1,1,1,"x', "CCO,a,1,1,1,x", '"CCO,a,1,1,1,x', "CCO,b,1,1,1,x"])
    assert reasons == {0: "quoting", 2: "quoting"} and set(rows) == {1, 3}


def test_other_fields(spark):
    df = spark.createDataFrame([(1, "a,1,CC"), (2, "b,x,CC"), (3, "c,1,C("), (4, "é,,C"), (5, "a,1")], "raw_id long, raw_line string")
    f = (Field("reason_text"), Field("y", "number"), Field("mol", "smiles"))
    assert [tuple(r) for r in valid_rows(df, f).orderBy("raw_id").collect()] == [(1, "a", 1.0, "CC"), (4, "é", None, "C")]
    assert {tuple(r) for r in rejected_rows(df, f).collect()} == {(2, "bad_target"), (3, "bad_smiles"), (5, "column_count")}


def test_parted_rows_on_spark(spark):
    df = spark.createDataFrame([(i, x, 7) for i, (x, _) in enumerate(LINES)], "raw_id long, raw_line string, reason int")
    got = {r.raw_id: r for r in parted_rows(df).collect()}
    assert set(got) == {i for i, (_, w) in enumerate(LINES) if w != "skip"}
    assert got[0].affinity == -2000.0 and got[0].toxic == 1 and got[1].assay is None and got[22].solubility is None
    assert {(r.raw_id, r.reason) for r in rejected_rows(df.union(df)).collect()} == {(i, w) for i, (_, w) in enumerate(LINES) if w not in (None, "skip")}
    assert rejected_rows(df.limit(0)).count() == 0
    long = spark.createDataFrame([(None, "C" * 200_000 + ",n,1,1,1,x")], "raw_id long, raw_line string")
    assert len(parted_rows(long).first().smiles) == 200_000


def test_smiles_forms():
    assert canonical(" ﻿|CC (CL)-c1ccc(cc1)[NA+].O.|\n") == canonical("O.CC(Cl)c1ccc(cc1)[Na+]")
    assert canonical("c1ccccc1") != canonical("C1CCCCC1")
    assert canonical("CC[N+](=O)[O-]") == "CC[N+](=O)[O-]"
    assert canonical("(CCO)") == "CCO" and canonical("(C)C(C)") == "(C)C(C)"
    assert canonical(" .,; ") is None and canonical(None) is None
    assert canonical("C/C=C\\[C@@H](O)[C@H](N)[13C@H]", stereo=False) == "CC=CC(O)C(N)[13CH]"
    assert canonical("[c@h]([NH3+])") == "[c@H]([NH3+])"
    assert canonical("[na+]") == "[Na+]" and canonical("[nh]") == "[nH]"


def test_parse_and_problem():
    atoms, bonds = parse("C[N+](=O)[O-]")
    assert [a[0] for a in atoms] == [6, 7, 8, 8] and [a[1] for a in atoms] == [0, 1, 0, -1]
    assert [b[:3] for b in bonds] == [(0, 1, 1.0), (1, 2, 2.0), (1, 3, 1.0)]
    assert len(parse("c1ccccc1")[1]) == 6 and all(b[2] == 1.5 for b in parse("c1ccccc1")[1])
    assert parse("C1CC%01")[1][-1][:2] == (0, 2)
    assert problem("") == "empty" and problem("q") == "symbol" and problem("[N+") == "bracket" and problem("C)") == "parenthesis" and problem("C%12C") == "ring"
    assert parse("C(") is None and parse("-") is None


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CCO,a,1,1,1,x\nC(,a,1,1,1,x\n\n")
    (tmp_path / "b.csv").write_text("CC,b,1,1,,x\n")
    raw = read_csv_lines(spark, str(tmp_path))
    assert raw.select("raw_id").distinct().count() == raw.count() == 4
    assert sorted(r.smiles for r in valid_rows(raw).collect()) == ["CC", "CCO"] and rejected_rows(raw).count() == 1
