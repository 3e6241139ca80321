"""Metrics as aggregates over predictions. Ties go to the smaller ``id``; global orders use :mod:`spindrel.operators.ordered`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.operators.ordered import running

EPS = 1e-10


def auroc(pred: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order: ``pred (id, score, target)``; 0 where one kind is missing."""
    r = running(pred, "score", "id", {"above": F.col("target")}, descending=True)
    return r.agg((F.sum(F.when(F.col("target") == 0, F.col("above")).otherwise(0)) / (F.sum("target") * F.sum(1 - F.col("target")) + EPS)).alias("auroc"))


def auprc(pred: DataFrame) -> DataFrame:
    """Average precision; 0 without positives."""
    r = running(pred, "score", "id", {"hits": F.col("target")}, descending=True, count="k")
    return r.agg((F.sum(F.when(F.col("target") == 1, F.col("hits") / F.col("k")).otherwise(0.0)) / (F.sum("target") + EPS)).alias("auprc"))


def _order(desc: bool = True):
    return Window.partitionBy("set_id").orderBy(F.col("score").desc(), F.col("id"))


def ragged_auroc(pred: DataFrame) -> DataFrame:
    r = pred.withColumn("above", F.sum("target").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("set_id").agg((F.sum(F.when(F.col("target") == 0, F.col("above")).otherwise(0)) / (F.sum("target") * F.sum(1 - F.col("target")) + EPS)).alias("auroc"))


def ragged_auprc(pred: DataFrame) -> DataFrame:
    w = _order()
    r = pred.withColumn("hits", F.sum("target").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(w))
    return r.groupBy("set_id").agg((F.sum(F.when(F.col("target") == 1, F.col("hits") / F.col("k")).otherwise(0.0)) / (F.sum("target") + EPS)).alias("auprc"))


def f1_max(pred: DataFrame) -> DataFrame:
    """Largest harmonic mean of precision (mean over the sets begun) and recall (mean over all sets) at any threshold."""
    w = _order()
    r = pred.withColumn("k", F.row_number().over(w)).withColumn("h", F.sum("target").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("p", F.col("h") / F.col("k")).withColumn("r", F.col("h") / (F.sum("target").over(Window.partitionBy("set_id")) + EPS))
    r = r.withColumn("dp", F.col("p") - F.coalesce(F.lag("p").over(w), F.lit(0.0))).withColumn("dr", F.col("r") - F.coalesce(F.lag("r").over(w), F.lit(0.0)))
    n = pred.select("set_id").distinct().count()
    g = running(r.select("id", "score", "dp", "dr", "k"), "score", "id", {"sp": F.col("dp"), "sr": F.col("dr"), "begun": (F.col("k") == 1).cast("long")}, descending=True)
    p, rec = F.col("sp") / F.col("begun"), F.col("sr") / n
    return g.agg(F.max(2 * p * rec / (p + rec + EPS)).alias("f1_max"))


def top_precision(pred: DataFrame, k: int) -> DataFrame:
    """Share of hits among the k best of each set, 0 for sets of fewer."""
    r = pred.withColumn("place", F.row_number().over(_order()))
    n = F.count("*")
    return r.groupBy("set_id").agg(F.when(n < k, 0.0).otherwise(F.sum(F.when(F.col("place") <= k, F.col("target"))) / k).alias("precision"))


def r2(p: Column, t: Column) -> Column:
    return 1 - F.avg(F.pow(p - t, 2)) / F.var_pop(t)


def pearson(p: Column, t: Column) -> Column:
    return F.covar_pop(p, t) / (F.stddev_pop(p) * F.stddev_pop(t))


def mae(p: Column, t: Column) -> Column:
    return F.avg(F.abs(p - t))


def rmse(p: Column, t: Column) -> Column:
    return F.sqrt(F.avg(F.pow(p - t, 2)))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks. Values are counted first, so any number of ties is a row."""
    def ranks(c: str) -> DataFrame:
        n = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        r = running(n.withColumn("i", F.col("v")), "v", "i", {"upto": F.col("n")})
        return r.select(F.col("v").alias(c), (F.col("upto") - (F.col("n") - 1) / 2).alias(f"rank_{c}"))

    j = df.groupBy(a, b).agg(F.count("*").alias("m")).join(ranks(a), a).join(ranks(b), b)
    x, y, m = F.col(f"rank_{a}"), F.col(f"rank_{b}"), F.col("m")
    n = F.sum(m)
    mean = lambda e: F.sum(e * m) / n
    sd = lambda e: F.sqrt(mean(e * e) - mean(e) * mean(e))
    return j.agg(((mean(x * y) - mean(x) * mean(y)) / (sd(x) * sd(y) + EPS)).alias("spearman"))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("predicted", "target").agg(F.count("*").alias("n"))


def matthews(df: DataFrame) -> DataFrame:
    """Correlation of classes from ``(predicted, target)``, through the confusion matrix (a row a pair of classes)."""
    c = confusion(df)
    p = c.groupBy("predicted").agg(F.sum("n").alias("p")).withColumnRenamed("predicted", "c")
    t = c.groupBy("target").agg(F.sum("n").alias("t")).withColumnRenamed("target", "c")
    j = p.join(t, "c", "full").fillna(0, ["p", "t"]).agg(F.sum(F.col("p") * F.col("t")).alias("pt"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum("t").alias("s"))
    hit = c.agg(F.coalesce(F.sum(F.when(F.col("predicted") == F.col("target"), F.col("n"))), F.lit(0)).alias("hit"))
    f = lambda x: F.col(x).cast("double")
    return j.crossJoin(hit).select(((f("hit") * f("s") - f("pt")) / F.sqrt((f("s") * f("s") - f("pp")) * (f("s") * f("s") - f("tt")) + EPS)).alias("mcc"))


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("predicted") == F.col("target")).cast("double")).alias("accuracy"))


def ragged_accuracy(pred: DataFrame) -> DataFrame:
    """Whether the best of each set is the target: ``pred (set_id, id, score, target)``; the share of sets."""
    best = pred.groupBy("set_id").agg(F.max(F.struct("score", (-F.col("id")).alias("i"), "target")).alias("b"))
    return best.agg(F.avg(F.col("b.target").cast("double")).alias("accuracy"))


def ranks(candidates: DataFrame, filtered: bool = True) -> DataFrame:
    """``candidates (query, score, positive, known)``: place of the positive among those not known, ties against it."""
    pos = candidates.where("positive").select("query", F.col("score").alias("ps"))
    j = candidates.join(pos, "query")
    beat = (F.col("ps") <= F.col("score")) & ((~F.col("known") & ~F.col("positive")) if filtered else F.lit(True))
    return j.groupBy("query").agg((F.count(F.when(beat, 1)) + 1).alias("rank"))


def block_ranks(test: DataFrame, known: DataFrame, blocks: DataFrame, filtered: bool = True) -> DataFrame:
    """``(query, rank)`` as :func:`ranks` gives it, without a row for each query and entity.

    ``test (query, h, r, block, score)`` has the score of each positive, ``known (h, r, score)`` a row for each known entity of a head
    and relation, the positive one included, and ``blocks (block, score, n)`` how many entities have a score for the queries of a block.
    Entities at least as good are counted a block and score; filtered ranks take away those known.
    """
    at_least = lambda *by: F.sum("n").over(Window.partitionBy(*by).orderBy(F.col("score").desc()))
    j = test.join(blocks.select("block", "score", at_least("block").alias("beat")), ["block", "score"])
    if filtered:
        k = known.groupBy("h", "r", "score").agg(F.count("*").alias("n"))
        j = j.join(k.select("h", "r", "score", at_least("h", "r").alias("known")), ["h", "r", "score"]).withColumn("beat", F.col("beat") - F.col("known"))
    return j.select("query", (F.col("beat") + 1).alias("rank"))


def rank_metrics(r: DataFrame, hits: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    return r.agg(F.avg("rank").alias("mr"), F.avg(1 / F.col("rank")).alias("mrr"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in hits])


def task_statistics(df: DataFrame, task: str = "task", value: str = "value") -> DataFrame:
    """Mean, sample deviation, count and number of classes of each task, over values that are numbers."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(task).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"), (F.max(v).cast("long") + 1).alias("num_class"))


def task_weights(df: DataFrame, task: str = "task", target: str = "target") -> DataFrame:
    """Mean number of positives over that of the task, within 1 and 10."""
    n = df.groupBy(task).agg(F.sum(target).alias("pos"))
    m = n.agg(F.avg("pos").alias("mean"))
    return n.crossJoin(F.broadcast(m)).select(task, F.least(F.greatest(F.col("mean") / F.col("pos"), F.lit(1.0)), F.lit(10.0)).alias("weight"))


def bce(p: Column, t: Column) -> Column:
    """Binary cross entropy of a logit."""
    return F.greatest(p, F.lit(0.0)) - p * t + F.log1p(F.exp(-F.abs(p)))


def cycle_bonus(logp: Column, sa: Column, longest_cycle: Column) -> Column:
    """A standardised score less the excess of the longest cycle over six."""
    return logp - sa - F.greatest(longest_cycle - 6, F.lit(0))
