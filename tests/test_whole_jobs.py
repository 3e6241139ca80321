"""Jobs done whole: no set, triplet, head or length is left out."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spindrel.operators import construct as K
from spindrel.operators import ragged as R
from spindrel.plans.catalog import QUERIES
from spindrel.plans.views import chain, kg, pg_edges


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_padding_to_the_largest_set_gives_every_row_back(spark):
    data = [(1, i, float(i)) for i in range(9)] + [(2, 0, 5.0)]
    x = spark.createDataFrame(data, "set_id long, pos long, value double")
    p = {r.set_id: (r.padded, r.mask) for r in R.to_padded(x).collect()}
    assert p[2] == ([5.0] + [0.0] * 8, [True] + [False] * 8) and all(p[1][1])
    assert rows(R.from_padded(R.to_padded(x), R.sizes_of(x))) == sorted(data)


def test_every_triplet_is_matched_once_a_kind(spark, sf):
    want = rows(kg(spark, sf).select("h", "r", "t"))
    for kind in ("hr", "t"):
        assert rows(QUERIES[f"match_{kind}"](spark, sf).select("h", "r", "t")) == want
    assert QUERIES["match_counts"](spark, sf).groupBy().sum("n").first()[0] == 3 * len(want)


def test_every_triplet_is_ranked_and_drawn_for(spark, sf):
    n = kg(spark, sf).count()
    assert QUERIES["kgc_filtered_rank"](spark, sf).count() == n
    assert QUERIES["strict_negative"](spark, sf).count() == 2 * n


def test_beams_of_queried_heads_go_over_every_edge(spark, sf):
    got = {(q, n): p for q, n, p in QUERIES["beam_search"](spark, sf).select("query", "state", "score").collect()}
    edges = defaultdict(list)
    k = [tuple(r) for r in kg(spark, sf).select("h", "t", F.round(F.log("weight"), 6)).collect()]
    for h, t, w in k:
        edges[h].append((t, w))
        edges[t].append((h, w))
    want = {}
    for q in {h for h, _, _ in k if h % 20 == 0}:
        beam = {q: 0.0}
        for _ in range(3):
            best = {}
            for n, p in beam.items():
                for t, w in edges[n]:
                    out = want if t % 5 == 0 else best
                    key = (q, t) if t % 5 == 0 else t
                    out[key] = max(out.get(key, p + w), p + w)
            beam = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])
    assert got == {k: pytest.approx(p, abs=2e-6) for k, p in want.items()}


def test_every_edge_and_as_many_absent_ones_are_asked_for(spark, sf):
    n = pg_edges(spark, sf).count()
    got = [r.weight for r in QUERIES["get_edge"](spark, sf).collect()]
    assert len(got) == 2 * n and sum(w > 0 for w in got) == n


def test_all_nodes_of_every_chain_are_paired(spark, sf):
    n = chain(spark, sf).groupBy("graph_id").count().selectExpr("sum(2 * count * count)").first()[0]
    assert QUERIES["full_graph"](spark, sf).count() == n


def test_prefixes_of_sets_beyond_five(spark, sf):
    got = rows(K.snake_prefixes(spark.createDataFrame([(1, 7)], "set_id long, size long"), 1))
    assert got == [(1, i * i - 1 - u, u) for i in range(1, 8) for u in (1, 0) if u < i]
    assert QUERIES["snake_prefixes"](spark, sf).where("length >= 25").count() > 0
