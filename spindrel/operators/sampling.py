"""Sampling, splits and negatives. Randomness is a number from the md5 of a seed and the row's ids, so every draw can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.operators.ordered import running
from spindrel.operators.ragged import key_of
from spindrel.session import maybe_broadcast

TWO32 = 4294967296.0


def uniform(*cols: Column) -> Column:
    """A repeatable number in (0, 1)."""
    return (key_of(*cols) + 0.5) / TWO32


def weighted_sample(df: DataFrame, weight: Column, n: int, seed: int, *ids: Column) -> DataFrame:
    """``n`` rows without replacement, likelier as ``weight`` is greater (0 never): the largest of ``ln(u) / weight``, kept by a
    bounded top-n."""
    return df.withColumn("_k", F.when(weight > 0, F.log(uniform(F.lit(seed), *ids)) / weight)).where("_k is not null").orderBy(F.desc("_k"), *ids).limit(n).drop("_k")


def node_sample(edges: DataFrame, nodes: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes drawn by the squared weight that reaches them (its share of all is ``p``), and the edges among them, weights divided by
    ``n p``, so that sums over the sample are unbiased."""
    p = edges.groupBy(F.col("node_out").alias("node_id")).agg(F.sum(F.col("weight") * F.col("weight")).alias("p"))
    total = p.agg(F.sum("p").alias("s"))
    p = p.crossJoin(F.broadcast(total)).select("node_id", (F.col("p") / F.col("s")).alias("p"))
    kept = weighted_sample(nodes.select("node_id").join(p, "node_id"), F.col("p"), n, seed, F.col("node_id"))
    k = kept.select("node_id", "p")
    e = edges.join(k.select(F.col("node_id").alias("node_in")), "node_in", "left_semi").join(k.select(F.col("node_id").alias("node_out"), "p"), "node_out")
    return kept.select("node_id"), e.select("node_in", "node_out", (F.col("weight") / (n * F.col("p"))).alias("weight"))


def merged_best(best: DataFrame, found: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """The ``k`` best of earlier and new results, each ``key`` once with its best score."""
    every = best.select(key, score).unionByName(found.select(key, score)).groupBy(key).agg(F.max(score).alias(score))
    return every.orderBy(F.desc(score), key).limit(k)


def edge_negatives(edges: DataFrame, sizes: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """``(graph_id, draw, a, b)``: random pairs of nodes of each graph ``(graph_id, size)`` that no edge joins, of ``draws`` pairs drawn."""
    n = sizes.select(F.col("graph_id").alias("set_id"), "size")
    pairs = random_pairs(n, n.select("set_id", F.lit(draws).cast("long").alias("n")), seed).withColumnRenamed("set_id", "graph_id")
    return pairs.join(edges.select("graph_id", F.col("node_in").alias("a"), F.col("node_out").alias("b")), ["graph_id", "a", "b"], "left_anti").select("graph_id", "draw", "a", "b")


def edge_sample(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Edges drawn by the sum of the inverse degrees of their ends (its share of all is ``p``), weights divided by ``n p``."""
    a = edges.groupBy("node_in").agg(F.sum("weight").alias("da"))
    b = edges.groupBy("node_out").agg(F.sum("weight").alias("db"))
    p = edges.join(a, "node_in").join(b, "node_out").withColumn("p", 1 / F.col("da") + 1 / F.col("db"))
    stats = p.agg(F.sum("p").alias("s"))
    p = p.crossJoin(F.broadcast(stats)).withColumn("p", F.col("p") / F.col("s"))
    kept = weighted_sample(p, F.col("p"), n, seed, F.col("node_in"), F.col("node_out"))
    return kept.select("node_in", "node_out", (F.col("weight") / (n * F.col("p"))).alias("weight"))


def strict_negatives(triplets: DataFrame, facts: DataFrame, entities: int, draws: int, seed: int = 0) -> DataFrame:
    """``(h, r, t, draw, negative)``: tails that no fact has under the triplet's head and relation, uniformly with replacement.

    The draw is a place among the entities that aren't known; the known ones, in order, push it up past them. A head and relation
    that know every entity give null.
    """
    known = facts.groupBy("h", "r").agg(F.sort_array(F.collect_set("t")).alias("known"))
    d = triplets.select("h", "r", "t").join(known, ["h", "r"]).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    free = F.lit(entities) - F.size("known")
    place = F.when(free > 0, F.pmod(key_of(F.lit(seed), F.col("h"), F.col("r"), F.col("t"), F.col("draw")), free))
    return d.select("h", "r", "t", "draw", F.aggregate("known", place, lambda x, k: F.when(k <= x, x + 1).otherwise(x)).alias("negative"))


def key_split(df: DataFrame, key: str, shares: list[float], seed: int = 0) -> DataFrame:
    """``df`` with ``part``: all rows of a key in one part, keys in a repeatable random order, boundaries at the key edge nearest to
    the wanted sizes."""
    n = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("k", key_of(F.lit(seed), F.col(key)))
    n = n.withColumn("i", F.xxhash64(key))
    r = running(n, "k", "i", {"upto": F.col("n")})
    total = df.count()
    mid = F.col("upto") - F.col("n") / 2
    part, acc = F.lit(0).cast("long"), 0.0
    for s in shares[:-1]:
        acc += s
        part = part + (mid > acc * total).cast("long")
    return df.join(r.select(key, part.alias("part")), key)


def stratified_key_split(df: DataFrame, key: str, stratum: str, shares: list[float], seed: int = 0) -> DataFrame:
    """``df`` with ``part``: :func:`key_split` within each stratum, whose keys are its own; the number of strata doesn't matter."""
    n = df.groupBy(stratum, key).agg(F.count("*").alias("n")).withColumn("k", key_of(F.lit(seed), F.col(key)))
    w = Window.partitionBy(stratum).orderBy("k", key)
    mid = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2
    total = F.sum("n").over(Window.partitionBy(stratum))
    part, acc = F.lit(0).cast("long"), 0.0
    for s in shares[:-1]:
        acc += s
        part = part + (mid > acc * total).cast("long")
    return df.join(n.withColumn("part", part).select(stratum, key, "part"), [stratum, key])


def shuffled(df: DataFrame, by: str, order: str, value: str, seed: int = 0) -> DataFrame:
    """``df`` with the values of one column dealt out anew among the rows of each group, in a repeatable random order."""
    w = lambda *o: Window.partitionBy(by).orderBy(*o)
    at = df.withColumn("_k", F.row_number().over(w(order)))
    dealt = df.select(by, F.col(value).alias("_v"), F.row_number().over(w(key_of(F.lit(seed), F.col(by), F.col(order)), order)).alias("_k"))
    return at.join(dealt, [by, "_k"]).withColumn(value, F.col("_v")).drop("_k", "_v")


def ordered_group_split(df: DataFrame, group: str, index: str, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """``df`` with ``part``: groups largest first (then latest first row) to train while train stays within its share, else to valid
    while train and valid together stay within theirs, else to test.

    Groups of one size are alike, so only the sizes and how many groups have each reach the driver (fewer than the root of twice the
    rows); a group's part follows from its rank among those of its size, taken in ranges cut at quantiles, not in one task.
    """
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.min(index).alias("first"))
    total = df.count()
    cut = [shares[0] * total, (shares[0] + shares[1]) * total]
    used, plan, before = [0, 0], [], 0
    for r in g.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).toLocalIterator():
        size, left = r["n"], r["m"]
        a = max(0, min(left, int((cut[0] - used[0] + 1e-9) // size)))
        used[0] += a * size
        b = max(0, min(left - a, int((cut[1] - used[0] - used[1] + 1e-9) // size)))
        used[1] += b * size
        plan.append((size, a, a + b, before))
        before += left
    p = df.sparkSession.createDataFrame(plan, "n long, a long, b long, before long")
    ranked = running(g.withColumn("_i", -F.col("first").cast("long")), "n", "_i", {}, descending=True, count="rank")
    rank = F.col("rank") - F.col("before")
    part = F.when(rank <= F.col("a"), 0).when(rank <= F.col("b"), 1).otherwise(2).cast("long")
    placed = ranked.join(maybe_broadcast(p), "n").withColumn("part", part).select(group, "part")
    return df.join(placed, group)


def labelled_subset(df: DataFrame, index: str, n: int, seed: int = 0) -> DataFrame:
    """``df`` with ``labeled``: true for ``n`` rows in a repeatable random order."""
    kept = df.select(index).orderBy(key_of(F.lit(seed), F.col(index)), index).limit(n).withColumn("labeled", F.lit(True))
    return df.join(kept, index, "left").withColumn("labeled", F.coalesce("labeled", F.lit(False)))


def drops(sizes: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """``(set_id, pos)`` that ``max(1, floor(rate * size))`` draws with replacement hit in each set."""
    n = F.greatest(F.lit(1), F.floor(F.lit(rate) * F.col("size"))).cast("long")
    d = sizes.where("size > 0").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return d.select("set_id", F.pmod(key_of(F.lit(seed), F.col("set_id"), F.col("draw")), F.col("size")).alias("pos")).distinct()


def random_windows(sizes: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """``(set_id, start)``: where a window of at most ``length`` begins in each set."""
    room = F.greatest(F.col("size") - length, F.lit(0)) + 1
    return sizes.select("set_id", F.pmod(key_of(F.lit(seed), F.col("set_id")), room).alias("start"))


def random_pairs(sizes: DataFrame, counts: DataFrame, seed: int = 0) -> DataFrame:
    """``(set_id, draw, a, b)``: as many pairs of each set as ``counts (set_id, n)`` says."""
    d = sizes.where("size > 0").join(counts.where("n > 0"), "set_id").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pick = lambda side: F.pmod(key_of(F.lit(seed), F.lit(side), F.col("set_id"), F.col("draw")), F.col("size"))
    return d.select("set_id", "draw", pick("a").alias("a"), pick("b").alias("b"))
