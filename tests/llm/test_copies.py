import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spindrel.functions.smiles import canonical
from spindrel.llm.copies import canonical_table, collapsed, copy_pairs, counted_texts, split_bucket, Trie
from spindrel.llm.queries import p2_found


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, t string, key int, n string")


def test_collapse_cases(spark):
    rows = [(3, "CCO", 0, ""), (1, " CC-O ", 0, ""), (2, "|CCO|", 0, ""), (4, "C(CL)C", 0, ""), (5, "C(Cl)C", 0, ""), (6, None, 0, ""), (7, "  ", 0, ""), (8, "O.CCO", 0, ""), (9, "CCO.O", 0, ""), (None, "CCO", 0, "")]
    df = frame(spark, rows)
    assert {(r.id_a, r.id_b) for r in copy_pairs(df, "id", "t").collect()} == {(1, 2), (1, 3), (4, 5), (8, 9)}
    assert {(r.id, r.text, r.n_copies) for r in collapsed(df, "id", "t").collect()} == {(1, "CCO", 3), (4, "C(Cl)C", 2), (8, "CCO.O", 2)}
    assert copy_pairs(df.limit(0), "id", "t").count() == 0 and collapsed(df.limit(0), "id", "t").count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab", min_size=1, max_size=14), max_size=60), st.sampled_from([1, 3, 50]))
def test_counts_like_a_dictionary(spark, texts, cap):
    df = frame(spark, [(i, t, 0, "") for i, t in enumerate(texts)]) if texts else frame(spark, []).limit(0)
    got = {bytes(r.key).decode(): (r.n, r.lo) for r in counted_texts(canonical_table(df, "id", "t", lambda x: x), cap).collect()}
    assert got == {t: (texts.count(t), texts.index(t)) for t in texts}


def test_hot_and_long_texts(spark):
    long = "C" * 50_000
    df = spark.range(3000).selectExpr("id", "case when id < 1500 then 'CCO' when id < 1502 then '" + long + "' else concat('N', id) end t")
    got = collapsed(df, "id", "t").toPandas().sort_values("n_copies", ascending=False)
    assert len(got) == 1500 and got.n_copies.tolist()[:2] == [1500, 2] and len(got.text.iloc[1]) == 50_000


def test_trie_counts():
    t = Trie()
    for k, i in ((b"abcde", 5), (b"abcd", 2), (b"abcde", 1)):
        t.add(k, 1, i)
    assert sorted(t.items()) == [(b"abcd", 1, 2), (b"abcde", 2, 1)]


def test_buckets_are_split_until_they_fit():
    rows = [(b"AAAA" * 9 + f"{i:04d}".encode(), 1, i) for i in range(50)] + [(b"B", 1, 99)] + [(b"AAAA", 1, i) for i in range(30)] + [(b"", 1, 7)]
    got = list(split_bucket(rows, 0, 10))
    assert sorted(r for b in got for r in b) == sorted(rows)
    assert all(len(b) <= 10 or len({r[0] for r in b}) == 1 for b in got) and len(got) <= 55
    assert [len({r[0] for r in b}) for b in got if len(b) == 30] == [1]
    assert list(split_bucket(rows, 0, 100)) == [rows]


def test_found_like_brute_force(spark, sf):
    s = pd.read_parquet(f"{sf}/smiles.parquet").drop_duplicates("sample_id").dropna(subset="smiles")
    key = s.smiles.map(canonical)
    lo = s.sample_id.groupby(key).transform("min")
    want = {(a, b) for a, b in zip(lo, s.sample_id) if a != b}
    assert {(r.id_a, r.id_b) for r in p2_found(spark, sf).collect()} == want
