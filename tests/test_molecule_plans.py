"""No table of atoms is sent whole to the driver because its size was guessed from that of the texts."""

import math

from spindrel.functions.smiles import parse
from spindrel.plans.catalog import QUERIES
from spindrel.sources import molecules as M


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_valences_are_counted_within_a_molecule(spark, sf):
    texts = ["CC(=O)[O-]", "c1ccccc1N", "[NH4+]", "C[N+](C)(C)C", "[Na+].[Cl-]", "C11", "CC#N"]
    got = {(r.graph_id, r.node_id): (r.atom_type, r.formal_charge, r.valence) for r in M.valences(M.parsed(spark.createDataFrame(list(enumerate(texts)), "sample_id long, smiles string"))).collect()}
    want = {}
    for i, t in enumerate(texts):
        atoms, bonds = parse(t)
        for n, a in enumerate(atoms):
            want[i, n] = (a[0], a[1], math.floor(sum(o * ((x == n) + (y == n)) for x, y, o, _ in bonds) + 0.5))
    assert got == want
    assert "Join" not in plan(QUERIES["explicit_valence"](spark, sf))


def test_validity_joins_nothing(spark, sf):
    assert "Join" not in plan(QUERIES["is_valid"](spark, sf))


def test_neutral_molecules_join_nothing(spark, sf):
    assert "Join" not in plan(QUERIES["ion_to_molecule"](spark, sf))


def planned(spark, build):
    """The plan where the planner may broadcast whatever it takes to be under 1 GB."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1g", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return plan(build())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_atoms_of_fingerprints_are_not_broadcast(spark):
    n = spark.createDataFrame([(1, 0, "C"), (1, 1, "O"), (2, 0, "N")], "graph_id long, node_id long, key string")
    e = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 0, 1.0)], "graph_id long, node_in long, node_out long, bond double")
    names = []

    def build():
        import spindrel.operators.iterative as I

        keep = I.written
        I.written = lambda df, name="stage": (names.append(plan(df)), keep(df, name))[1]
        try:
            return I.circular_fingerprint(n, e)
        finally:
            I.written = keep

    planned(spark, build)
    assert len(names) > 2 and not any("BroadcastHashJoin" in p for p in names)


def test_shares_in_clusters_are_not_broadcast(spark):
    from spindrel.operators import message as P

    e = spark.createDataFrame([(1, 0, 1, 2.0), (1, 1, 0, 2.0)], "graph_id long, node_in long, node_out long, weight double")
    soft = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.5), (1, 1, 1, 1.0)], "graph_id long, node_id long, cluster long, p double")
    assert "BroadcastHashJoin" not in planned(spark, lambda: P.pool_dense(e, soft))
    assert planned(spark, lambda: P.mincut(e, soft, 2)).count("SortMergeJoin") >= 4
