"""Histories of events: bounded buffers, moving averages and logs, over tables and as streams.

``newest`` and ``log_means`` are the batch forms; ``stream_newest`` and ``stream_means`` give the same over a stream, with state that a
bound (the buffer) or a watermark (the windows) limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def newest(events: DataFrame, size: int) -> DataFrame:
    """The ``size`` latest events of each user, as a first-in-first-out buffer of that size would hold them."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= size).drop("_k")


def moving_average(events: DataFrame, momentum: float) -> DataFrame:
    """``(event_type, n, ema)``: ``b <- m b + (1 - m) x`` over the hourly means of each type, beginning with the first. Hours are
    aggregated before; a type's series is a row an hour."""
    h = events.groupBy("event_type", F.date_trunc("hour", F.col("ts")).alias("hour")).agg(F.avg("value").alias("x"))
    z = h.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("hour", "x"))).alias("z"), F.count("*").alias("n"))
    first = F.element_at("z", 1)["x"]
    ema = F.aggregate("z", first, lambda b, x: b * momentum + x["x"] * (1 - momentum))
    return z.select("event_type", "n", F.round(ema, 6).alias("ema"))


def log_means(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Count and mean of each type in each epoch."""
    return events.groupBy("event_type", F.date_trunc(unit, F.col("ts")).alias("epoch")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_means(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean of each type in each window; events later than ``late`` are left out and closed windows leave the state."""
    s = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = s.groupBy("event_type", F.window("at", window).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select("event_type", F.col("w.start").alias("epoch"), "n", "mean")


def stream_newest(stream: DataFrame, size: int) -> DataFrame:
    """For each user and batch the buffer after it: ``(user_id, event_ids, n_seen)``. The state of a user is at most ``size`` events."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (0, [])
        held = [tuple(x) for x in held]
        for b in batches:
            seen += len(b)
            held += list(zip(b["ts"].astype("int64").tolist(), b["event_id"].tolist()))
            held = sorted(held)[-size:]
        state.update((seen, held))
        yield pd.DataFrame({"user_id": [key[0]], "event_ids": [[e for _, e in held]], "n_seen": [seen]})

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, event_ids array<long>, n_seen long", "seen long, held array<struct<t: long, e: long>>", "update", GroupStateTimeout.NoTimeout)
