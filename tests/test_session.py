"""The session stays as it was, and the shared folder empty, after queries."""

import os

import pytest

from spindrel import session
from spindrel.plans.catalog import QUERIES
from spindrel.session import dropped, maybe_broadcast, scratch, shared_dir, small_batches, written


def test_tables_are_removed_from_the_shared_folder(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    with scratch(spark):
        for name in ("connected_components", "neural_lp_walk"):
            QUERIES[name](spark, sf).count()
        t = written(spark.range(3))
        assert os.listdir(tmp_path / "spindrel") and t.count() == 3
        dropped(t)
    assert os.listdir(tmp_path / "spindrel") == []


def test_batch_size_is_restored(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), small_batches(spark, 7):
        assert spark.conf.get(key) == "7"
        1 / 0
    assert spark.conf.get(key) == before


def test_clusters_need_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return "yarn" if key == "spark.master" else default

    class Cluster:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_dir(Cluster())


def test_only_small_sides_are_broadcast(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(maybe_broadcast(spark.range(9), 10)) and not hinted(maybe_broadcast(spark.range(11), 10))
