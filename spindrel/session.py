"""Session helpers: defaults for tests, the shared folder for written stages, and size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be sent to every executor. A row is a few dozen bytes, so this is some tens of MB at most.
BROADCAST_ROWS = 500_000


def get_spark(name: str = "spindrel", cores: str = "8", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).master(f"local[{cores}]")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
    }
    return b.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. The cluster names it in ``spark.checkpoint.dir``; a folder of our own serves only where
    that setting is absent, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    key = "spark.spindrel.scratch"
    own = spark.conf.get(key, None)
    if own is None:
        own = tempfile.mkdtemp(prefix="spindrel-")
        spark.conf.set(key, own)
    return own


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it an action's shuffle files go when it ends, and not some time after the driver has collected its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, own = spark.conf.get(key), key in spark.conf.getAll
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if own:
            spark.conf.set(key, before)
        else:
            spark.conf.unset(key)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, it is computed once, and the loss of an executor costs no
    more than the tasks at hand."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spindrel/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spindrel_path = path
    return out


#: Tables that this process has written and not removed.
_paths: list[str] = []


def dropped(df: DataFrame) -> None:
    """Remove a table made by :func:`written` that nothing reads any more."""
    path = getattr(df, "_spindrel_path", None)
    if path in _paths:
        _paths.remove(path)
        _removed(df.sparkSession, path)


def _removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast where its size allows, and unmarked (a shuffle join then) where not."""
    return F.broadcast(df) if small_enough(df, rows) else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Within it, rows go to Python in batches of at most ``rows``: at some KB a row, batches of the default size would take several
    hundred MB of each worker. Meant around an action, such as :func:`written`; the session's setting is restored after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, own = spark.conf.get(key), key in spark.conf.getAll
    spark.conf.set(key, str(min(int(before), rows)) if int(before) > 0 else str(rows))
    try:
        yield
    finally:
        if own:
            spark.conf.set(key, before)
        else:
            spark.conf.unset(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it queries are built and their results used; after it the tables that they wrote are removed, in the shared folder too."""
    before = len(_paths)
    try:
        yield
    finally:
        while len(_paths) > before:
            _removed(spark, _paths.pop())


def clean_scratch(spark: SparkSession) -> None:
    """Remove all tables that this process has written, in the shared folder too, and the session's own temporary folder."""
    while _paths:
        _removed(spark, _paths.pop())
    own = spark.conf.get("spark.spindrel.scratch", None)
    if own:
        shutil.rmtree(own, ignore_errors=True)
