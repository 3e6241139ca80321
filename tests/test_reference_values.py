"""Values worked out by hand from the definitions, not from the code or its SQL."""

import math

import pytest

from spindrel.functions import scores as C
from spindrel.functions import sequence as Q
from spindrel.operators import iterative as I
from spindrel.operators import message as P
from spindrel.operators import sampling as S
from spindrel.sources import molecules as M


def test_pairs_of_residues_against_their_codons(spark):
    """Ids count G A S P ...: chain A A G has the pairs AA and AG, a half each; A and G have 4 codons, S has 6, M and W one."""
    c = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 2, 0)], "graph_id long, pos long, residue_type long")
    got = {(r.a, r.b): r.dde for r in Q.dipeptide_deviation(c).collect()}
    of = lambda share, x, y, n=2: (share - x * y / 3721) / math.sqrt(x * y / 3721 * (1 - x * y / 3721) / n)
    assert len(got) == 400
    assert got[1, 1] == pytest.approx(of(0.5, 4, 4)) and got[1, 0] == pytest.approx(of(0.5, 4, 4))
    assert got[2, 1] == pytest.approx(of(0, 6, 4)) and got[14, 19] == pytest.approx(of(0, 1, 1))
    assert {(r.a, r.b) for r in Q.dipeptide_deviation(c, occurring=True).collect()} == {(1, 1), (1, 0)}


def test_sampled_weights_are_unbiased(spark):
    """All four nodes drawn: each weight is divided by 4 times the node's share of the squared weight that reaches it."""
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 3, 2.0), (3, 0, 4.0)], "node_in long, node_out long, weight double")
    n = spark.createDataFrame([(i,) for i in range(4)], "node_id long")
    got = {r.node_out: r.weight for r in S.node_sample(e, n, 4)[1].collect()}
    assert got == {1: pytest.approx(1 / (4 * 1 / 25)), 2: pytest.approx(2 / (4 * 4 / 25)), 3: pytest.approx(2 / (4 * 4 / 25)), 0: pytest.approx(4 / (4 * 16 / 25))}
    got = {r.node_out: r.weight for r in S.edge_sample(e, 4).collect()}
    p = {1: 2.0, 2: 1.0, 3: 1.0, 0: 0.5}  # 1 / weight out + 1 / weight in, each the edge's own
    assert got == {k: pytest.approx(w / (4 * p[k] / 4.5)) for k, w in {1: 1, 2: 2, 3: 2, 0: 4}.items()}


def test_attention_has_loops(spark):
    e = spark.createDataFrame([(0, 1, 2, 3.0)], "graph_id long, node_in long, node_out long, weight double")
    n = spark.createDataFrame([(0, 1, 1.0), (0, 2, -2.0), (0, 3, 5.0)], "graph_id long, node_id long, x double")
    got = {r.node_id: r.y for r in P.attention(e, n, 1.0, 1.0, 0.2).collect()}
    # Node 2: the edge scores -1, leaky -0.2, weight 3; its loop scores -4, leaky -0.8, weight 1.
    a, b = 3 * math.exp(-0.2), math.exp(-0.8)
    assert got == {1: pytest.approx(1.0), 3: pytest.approx(5.0), 2: pytest.approx((a * 1 + b * -2) / (a + b))}


def test_ratio_is_cut_at_ten(spark):
    f = lambda p, a, r: spark.range(1).select(C.clipped_objective(C.F.lit(p), C.F.lit(a), C.F.lit(r))).first()[0]
    assert f(5.0, 0.0, -1.0) == pytest.approx(-10.0)  # the ratio is e^5
    assert f(5.0, 0.0, 1.0) == pytest.approx(1.2)
    assert f(math.log(0.5), 0.0, 2.0) == pytest.approx(1.0)
    assert f(math.log(0.5), 0.0, -2.0) == pytest.approx(-1.6)


def test_valid_share_is_cumulative(spark):
    """Groups of 9, 8, 2 and 1 of 20: 9 go to train (16), 8 would pass it and, with train, stay within 18: valid."""
    rows = [(k, i) for i, k in enumerate("a" * 9 + "b" * 8 + "c" * 2 + "d")]
    got = {r.g: r.part for r in S.ordered_group_split(spark.createDataFrame(rows, "g string, i long"), "g", "i").collect()}
    assert got == {"a": 0, "b": 1, "c": 0, "d": 0}


def test_groups_of_one_size_go_latest_first(spark):
    rows = [(k, i) for i, k in enumerate("aabbccddee")]
    got = {r.g: r.part for r in S.ordered_group_split(spark.createDataFrame(rows, "g string, i long"), "g", "i", (0.6, 0.2)).collect()}
    assert got == {"e": 0, "d": 0, "c": 0, "b": 1, "a": 2}


def test_atoms_without_a_valence_are_an_error(spark):
    m = M.parsed(spark.createDataFrame([(1, "[Xe]")], "sample_id long, smiles string"))
    with pytest.raises(Exception, match="no valence is known for atom 54"):
        M.valid(m).collect()
    assert [r.valid for r in M.valid(m, unknown=False).collect()] == [False]


def test_walks_go_on_to_the_last_node(spark):
    n = 12
    e = spark.createDataFrame([(0, i, i + 1) for i in range(n)], "graph_id long, node_in long, node_out long")
    got = I.bfs_order(e, spark.createDataFrame([(0, 0)], "graph_id long, node_id long")).collect()
    assert sorted((r.node_id, r.place) for r in got) == [(i, i) for i in range(n + 1)]


def test_cuts_and_even_clusters(spark):
    """Two clusters of two nodes, joined by one edge in each direction: 4 of 6 weights lie within; the assignment is even."""
    links = [(1, 2), (2, 1), (3, 4), (4, 3), (2, 3), (3, 2)]
    e = spark.createDataFrame([(0, a, b, 1.0) for a, b in links], "graph_id long, node_in long, node_out long, weight double")
    s = spark.createDataFrame([(0, n, int(n > 2), 1.0) for n in range(1, 5)], "graph_id long, node_id long, cluster int, p double")
    r = P.mincut(e, s, 2).first()
    assert r.cut == pytest.approx(1 - 4 / 6) and r.orthogonality == pytest.approx(0.0, abs=1e-6)
    one = s.withColumn("cluster", C.F.lit(0))
    assert P.mincut(e, one, 2).first().orthogonality == pytest.approx(math.sqrt((1 - 1 / math.sqrt(2)) ** 2 + 0.5))


def test_operators_are_found_by_name():
    from spindrel.functions.registry import register_all

    r = register_all()
    assert r.search("node_sample") is S.node_sample and r.get("message.attention") is P.attention and len(r.items) > 150
