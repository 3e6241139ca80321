import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spindrel.llm.queries import p1_found
from spindrel.llm.splits import connected_components, grouped_split, linked_groups, read_split, registry_keys


def components(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(top)}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40), st.sampled_from([0, 5, 1000]))
def test_components_like_union_find(spark, pairs, one_task):
    df = spark.createDataFrame(pairs, "src long, dst long") if pairs else spark.createDataFrame([], "src long, dst long")
    got = {r.id: r.component for r in connected_components(df, max(one_task, 1)).collect()}
    assert got == components(pairs)


def test_long_chain_and_hub(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long"), 3).collect()}
    assert got == components(pairs)


def tables(spark):
    s = spark.createDataFrame(
        [
            (1, "DEP-1", None, "train"),
            (2, " dep 1", "R1", " TEST"),
            (3, None, "R1", "train "),
            (4, "dep-2", None, "valid"),
            (5, None, None, None),
            (6, "", "", "test"),
            (7, "", "", "train"),
            (8, "d9", None, "Valid"),
            (None, "dep-2", "R1", "test"),
        ],
        "sample_id long, depositor string, source_ref string, split string",
    )
    n = spark.createDataFrame([(4, 1, 8), (4, 0, 6), (4, 0, 6), (8, 0, 6), (8, 1, 8), (5, 0, 8), (5, 1, 6), (99, 0, 6)], "graph_id long, node_id long, atom_type int")
    return s, n


def test_links_by_every_key(spark):
    s, n = tables(spark)
    got = {r.id: r.component for r in linked_groups(s, "sample_id", registry_keys(s, n)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 8: 4, 5: 5, 6: 6, 7: 7}
    empty = linked_groups(s.limit(0), "sample_id", registry_keys(s.limit(0), n.limit(0)))
    assert empty.count() == 0
    assert {r.x for r in s.select(read_split("split").alias("x")).collect()} == {"train", "test", "valid", None}


@pytest.mark.parametrize("hot", [0, 400])
def test_split_keeps_groups_and_proportions(spark, hot):
    rows = [(i, i // 3) for i in range(1500)] + [(5000 + i, 9999) for i in range(hot)]
    out = grouped_split(spark.createDataFrame(rows, "id long, component long")).toPandas()
    assert len(out) == len(rows) and out.groupby("component").split.nunique().max() == 1
    share = out.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["valid"] - 0.1) < 0.02
    assert grouped_split(spark.createDataFrame([], "id long, component long")).count() == 0


def test_found_like_brute_force(spark, sf):
    s = pd.read_parquet(f"{sf}/smiles.parquet").sort_values("loaded_at").drop_duplicates("sample_id")
    n = pd.read_parquet(f"{sf}/nodes.parquet").drop_duplicates(["graph_id", "node_id"]).sort_values("node_id")
    mol = n.groupby("graph_id").atom_type.agg(lambda x: ",".join(map(str, x)))
    keys = [s.depositor.str.lower().str.replace(r"[\s-]", "", regex=True), s.source_ref, s.sample_id.map(mol)]
    pairs = [(i, i) for i in s.sample_id]
    for k in keys:
        for ids in s.sample_id.groupby(k).agg(list):
            pairs += [(ids[0], x) for x in ids[1:]]
    top = components(pairs)
    sp = s.split.str.lower().str.strip()
    comp = s.sample_id.map(top)
    mixed = sp.groupby(comp).nunique()
    want = set(s.sample_id[comp.map(mixed) > 1])
    assert {r.sample_id for r in p1_found(spark, sf).collect()} == want
