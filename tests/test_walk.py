"""Steps of a walk over a grid of cells."""

import os
from collections import defaultdict

import pytest

from spindrel import session
from spindrel.operators import iterative as I
from spindrel.session import scratch, written


def test_steps_add_up_whatever_the_cells(spark, monkeypatch):
    monkeypatch.setattr(I, "CELL", 7)
    monkeypatch.setattr(I, "ADDED", 5)
    edges = [(a, (a * b) % 2, (a * 7 + b * 3) % 11, float(1 + (a + b) % 4)) for a in range(11) for b in range(1, 6)]
    heads = [(100 + q, n) for q, n in enumerate((0, 3, 5, 8))] + [(200, 1), (200, 2)]
    weights = [[0.5, 0.25], [0.125, 1.0], [1.0, 0.5]]
    want = {q: defaultdict(float) for q, _ in heads}
    for q, n in heads:
        want[q][n] += 1.0
    for step in weights:
        for q, at in want.items():
            nxt = defaultdict(float)
            for a, r, b, w in edges:
                if a in at:
                    nxt[b] += at[a] * step[r] * w
            total = sum(nxt.values())
            want[q] = {n: p / total for n, p in nxt.items()}
    e = spark.createDataFrame(edges, "node_in long, relation long, node_out long, weight double")
    got = {(r.query, r.node_id): r.p for r in I.relational_walk(e, spark.createDataFrame(heads, "query long, node_id long"), weights).collect()}
    assert got == {(q, n): pytest.approx(p, rel=1e-12) for q, at in want.items() for n, p in at.items()}


def test_terms_of_a_step_are_not_moved(spark):
    # 300 queries by 300 links of one node: the only exchange has states and edges, and no sums are exchanged after it.
    e = spark.range(300).selectExpr("0L as node_in", "0L as relation", "id as node_out", "1.0D as weight")
    out = I.relational_walk(e, spark.range(300).selectExpr("id as query", "0L as node_id"), [[1.0]])
    assert out.count() == 90_000
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in text.split("MapInArrow")[0]


def test_shuffles_go_with_the_table_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(b.toString().startswith("shuffle_") for b in [root.getAllBlocks().apply(k) for k in range(root.getAllBlocks().size())])
    with scratch(spark):
        n = files()
        t = written(spark.range(1000).selectExpr("id % 10 as k").groupBy("k").count())
        assert t.count() == 10 and os.listdir(tmp_path / "spindrel") and files() <= n
    assert spark.conf.get(key) == before
