import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spindrel.functions import scores as C
from spindrel.functions import sequence as Q
from spindrel.operators import geometry as G
from spindrel.operators import graph as GR
from spindrel.operators import iterative as I
from spindrel.operators import message as P
from spindrel.operators import metrics as M
from spindrel.operators import ragged as R
from spindrel.operators import sampling as S
from spindrel.operators import schema as T
from spindrel.operators.ordered import running


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def ring(spark):
    n = spark.createDataFrame([(0, i) for i in range(6)] + [(1, 0)], "graph_id long, node_id long")
    e = spark.createDataFrame([(0, i, (i + 1) % 6, 1.0) for i in range(6)], "graph_id long, node_in long, node_out long, weight double")
    return GR.Graphs(n, e)


def test_ring_subgraph(ring):
    assert rows(ring.subgraph("node_id between 2 and 4").edges.select("node_in", "node_out")) == [(0, 1), (1, 2)]
    assert rows(ring.node_mask("node_id between 2 and 4").edges.select("node_in", "node_out")) == [(2, 3), (3, 4)]
    assert rows(ring.sizes()) == [(0, 6, 6), (1, 1, 0)]
    assert rows(ring.compact().nodes.select("graph_id").distinct()) == [(0,)]
    assert ring.repeat(0).nodes.count() == 0 and ring.repeat(2).nodes.count() == 14
    assert ring.undirected().edges.count() == 12 and ring.virtual_node().edges.count() == 6 + 14


def test_match_wildcards(spark):
    e = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1), (2, 0), (0, 2)], "h long, t long").withColumn("edge", F.monotonically_increasing_id())
    p = spark.createDataFrame([(0, 0, -1), (1, 1, 2)], "pattern_id long, h long, t long")
    assert rows(GR.match(e, p, ("h", "t")).select("pattern_id", "h", "t")) == [(0, 0, 1), (0, 0, 2), (1, 1, 2)]
    with pytest.raises(PySparkException):
        GR.match(e, spark.createDataFrame([(0, -1, -1)], "pattern_id long, h long, t long"), ("h", "t")).collect()


def test_lookup_errors_and_defaults(spark):
    t = spark.createDataFrame([(0, 0, 5), (1, 1, None)], "a long, b long, v long")
    k = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "a long, b long")
    assert rows(GR.lookup(k.where("a < 1"), t, ["a", "b"], "v")) == [(0, 0, 5)]
    assert rows(GR.has_key(k, t, ["a", "b"])) == [(0, 0, True), (1, 1, True), (2, 2, False)]
    with pytest.raises(PySparkException):
        GR.lookup(k, t, ["a", "b"], "v").collect()


def test_tags_and_references(spark):
    df = T.tag(spark.createDataFrame([(0, 2), (1, -1), (2, 9)], "x long, ref long"), x="node", ref=["edge", "node reference"])
    assert T.by_kind(df, ["node"]) == ["x"] and T.by_kind(df) == ["x", "ref"] and T.by_kind(df, exclude=["node"]) == ["ref"]
    keep = spark.createDataFrame([(0, 2), (1, 0)], "pos long, x long")
    assert rows(T.remapped(df, "ref", T.mapping_of(keep, "x"))) == [(0, 0), (1, -1), (2, -1)]
    assert rows(T.bad_references(df, "ref", df, "x").select("ref")) == [(9,)]
    with pytest.raises(ValueError):
        T.tag(df, x="planet")
    with pytest.raises(PySparkException):
        T.mapping_of(spark.createDataFrame([(0, 1), (1, 1)], "pos long, x long"), "x").collect()


def test_ragged_edges(spark):
    s = spark.createDataFrame([(0, 0, 2.0), (0, 1, 2.0), (2, 0, float("-inf")), (2, 1, 1.0)], "set_id long, pos long, value double")
    n = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "set_id long, size long")
    assert rows(R.ragged_sum(s.where("set_id < 2"), n)) == [(0, 4.0), (1, 0.0), (2, 0.0)]
    assert rows(R.ragged_max(s)) == [(0, 2.0, 0), (2, 1.0, 1)]
    assert rows(R.ragged_topk(s, 4, padded=True).where("set_id = 0").select("place", "pos")) == [(0, 0), (1, 1), (2, 1), (3, 1)]
    assert rows(R.ragged_topk(s, 0)) == []
    spans = spark.createDataFrame([(0, 0, 2), (0, 1, 3), (0, 4, 6), (0, 5, 5)], "set_id long, start long, end long")
    assert [r.pos for r in R.multi_slice(spans).orderBy("pos").collect()] == [0, 1, 2, 4, 5]
    more = spark.createDataFrame([(0, 0, -1.0), (1, 0, -2.0)], "set_id long, pos long, value double")
    assert rows(R.extended(s.where("set_id = 0"), more)) == [(0, 0, 2.0), (0, 1, 2.0), (0, 2, -1.0), (1, 0, -2.0)]
    with pytest.raises(PySparkException):
        R.ragged_cross_entropy(s, spark.createDataFrame([(0, 5)], "set_id long, target long")).collect()
    v = spark.createDataFrame([(1.0, True), (float("nan"), True), (5.0, False)], "x double, m boolean")
    assert v.agg(R.masked_mean(F.col("x"), F.col("m")), R.mean_with_nan(F.col("x"))).first() == (1.0, 3.0)


@pytest.mark.parametrize("descending", [False, True])
def test_running_over_ties(spark, descending):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(3000), "v": np.where(rng.random(3000) < 0.4, 7, rng.integers(0, 50, 3000)).astype(float)})
    got = running(spark.createDataFrame(pdf), "v", "id", {"s": F.col("id")}, descending, "k").toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"], ascending=[not descending, True])
    want = want.assign(s=want.id.cumsum(), k=np.arange(1, 3001)).sort_values("id")
    assert (got.s.to_numpy() == want.s.to_numpy()).all() and (got.k.to_numpy() == want.k.to_numpy()).all()
    assert running(spark.createDataFrame(pdf).limit(0), "v", "id", {"s": F.col("id")}).count() == 0


def test_metric_edges(spark):
    p = lambda x: spark.createDataFrame([(i, float(s), t, 0) for i, (s, t) in enumerate(x)], "id long, score double, target long, set_id long")
    assert M.auroc(p([(3, 1), (2, 1), (1, 0)])).first()[0] == pytest.approx(1.0)
    assert M.auroc(p([(3, 0), (2, 0)])).first()[0] == 0 and M.auprc(p([(3, 0)])).first()[0] == 0
    assert M.f1_max(p([(3, 1), (2, 0), (1, 1)])).first()[0] == pytest.approx(0.8, abs=1e-6)
    c = spark.createDataFrame([(1, 1)] * 5, "predicted long, target long")
    assert M.matthews(c).first()[0] == 0 and M.accuracy(c).first()[0] == 1
    x = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 9.0), (5.0, 4.0)], "a double, b double")
    assert M.spearman(x, "a", "b").first()[0] == pytest.approx(pd.DataFrame(x.collect(), columns=["a", "b"]).rank().corr().iloc[0, 1])


def test_dihedral_like_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20, 3, 3))
    df = spark.createDataFrame([tuple(map(lambda x: x.tolist(), r)) for r in v], "a array<double>, b array<double>, c array<double>")
    got = [r[0] for r in df.select(G.dihedral(F.col("a"), F.col("b"), F.col("c"))).collect()]
    n1, n2 = np.cross(v[:, 0], v[:, 1]), np.cross(v[:, 1], v[:, 2])
    cos = (n1 * n2).sum(1) / np.linalg.norm(n1, axis=1) / np.linalg.norm(n2, axis=1)
    assert np.allclose(got, np.arccos(np.clip(cos, -1, 1)))
    assert spark.range(1).select(G.angle_bin(F.lit(math.pi), 8)).first()[0] == 7


def test_one_hot_and_activation(spark):
    d = spark.createDataFrame([(1,), (9,)], "i int")
    assert [r[0] for r in d.select(C.one_hot(F.col("i"), 3, allow_unknown=True)).collect()] == [[0, 1, 0, 0], [0, 0, 0, 1]]
    with pytest.raises(PySparkException):
        d.select(C.one_hot(F.col("i"), 3)).collect()
    assert d.select(C.shifted_softplus(F.lit(0.0))).first()[0] == pytest.approx(0.0)
    assert d.select(C.shifted_softplus(F.lit(800.0))).first()[0] == pytest.approx(800 - math.log(2))


def test_semiring_empty_rows(spark):
    e = spark.createDataFrame([(0, 0, 1, 2.0)], "graph_id long, node_in long, node_out long, weight double")
    x = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "graph_id long, node_id long, x double")
    assert rows(P.spmm(e, x, "max", "add")) == [(0, 0, 5.0), (0, 1, float("-inf"))]
    assert rows(P.spmm(e, x)) == [(0, 0, 6.0), (0, 1, 0.0)]
    with pytest.raises(ValueError):
        P.spmm(e, x, "median")
    with pytest.raises(ValueError):
        P.spmm(e, x, "add", "pow")


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 300)]
    got = {r.id: r.component for r in I.components(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(7,), (300,), (500,)], "id long")).collect()}
    assert got == {7: 0, 300: 300, 500: 500}
    all_ = {r.id: r.component for r in I.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(all_[i] == 0 for i in range(41)) and all(all_[100 + i] == 100 for i in range(50))


def test_rings_left_after_pruning(spark):
    e = [(0, 0, 1), (0, 1, 2), (0, 2, 0), (0, 2, 3), (0, 3, 4), (0, 4, 5), (0, 5, 6), (0, 6, 4), (1, 0, 1), (1, 1, 2)]
    left = I.pruned(spark.createDataFrame(e + [(0, 6, 7)], "graph_id long, a long, b long"))
    assert rows(left) == sorted(e[:8])


def test_group_splits(spark):
    df = spark.createDataFrame([(i, i // 10) for i in range(100)], "i long, g long")
    out = S.key_split(df, "g", [0.8, 0.1, 0.1]).toPandas()
    assert out.groupby("g").part.nunique().max() == 1 and out.part.value_counts().to_dict() == {0: 80, 1: 10, 2: 10}
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 9, 60)
    df = spark.createDataFrame([(k, g) for k, g in enumerate(np.repeat(np.arange(60), sizes).tolist())], "i long, g long")
    got = S.ordered_group_split(df, "g", "i").select("g", "part").distinct().toPandas().set_index("g").part.to_dict()
    first = np.cumsum(sizes) - sizes
    used, want = [0, 0], {}
    for g in sorted(range(60), key=lambda g: (-sizes[g], -first[g])):
        part = 0 if used[0] + sizes[g] <= 0.8 * sizes.sum() else 1 if used[0] + used[1] + sizes[g] <= 0.9 * sizes.sum() else 2
        want[g] = part
        if part < 2:
            used[part] += sizes[g]
    assert got == want


def test_strict_negatives_are_unknown(spark):
    facts = spark.createDataFrame([(0, 0, t) for t in range(0, 20, 2)] + [(1, 0, t) for t in range(5)], "h long, r long, t long")
    got = S.strict_negatives(facts, facts, 20, 3).toPandas()
    known = {tuple(r) for r in facts.collect()}
    assert not any((h, r, n) in known for h, r, n in zip(got.h, got.r, got.negative)) and got.negative.between(0, 19).all()
    full = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "h long, r long, t long")
    assert {r.negative for r in S.strict_negatives(full, full, 2, 1).collect()} == {None}


def test_sequences_round_trip(spark):
    df = spark.createDataFrame([(1, "ACGX"), (2, ""), (3, None)], "graph_id long, sequence string")
    r = Q.residues_of(df, "GAC")
    assert rows(r) == [(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 3, 0)]
    assert rows(Q.sequence_text(r, "GAC")) == [(1, "ACGG")]
    with pytest.raises(ValueError):
        Q.autocorrelation(r.withColumn("x", F.lit(1.0)), 2, "other")
