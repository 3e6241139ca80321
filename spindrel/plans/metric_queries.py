"""Queries of metrics."""

from pyspark.sql import functions as F

from spindrel.operators import metrics as M
from spindrel.plans.registry import query
from spindrel.plans.views import emb, kg, pred, reg, sql
from spindrel.session import table


def r(df, n=8):
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_CUM = "c AS (SELECT *, sum(target) OVER w AS h, row_number() OVER w AS k FROM pred WINDOW w AS ({}ORDER BY score DESC, id))"
_ROC = "sum(CASE WHEN target = 0 THEN h ELSE 0 END) / (sum(target) * sum(1 - target) + 1e-10)"
_PRC = "sum(CASE WHEN target = 1 THEN h / k ELSE 0 END) / (sum(target) + 1e-10)"


@query("auroc", sql(f"WITH $pred, {_CUM.format('')} SELECT round({_ROC}, 8) AS auroc FROM c"))
def _(s, d):
    return r(M.auroc(pred(s, d)))


@query("auprc", sql(f"WITH $pred, {_CUM.format('')} SELECT round({_PRC}, 8) AS auprc FROM c"))
def _(s, d):
    return r(M.auprc(pred(s, d)))


@query("variadic_auroc", sql(f"WITH $pred, {_CUM.format('PARTITION BY set_id ')} SELECT set_id, round({_ROC}, 8) AS auroc FROM c GROUP BY 1"))
def _(s, d):
    return r(M.ragged_auroc(pred(s, d)))


@query("variadic_auprc", sql(f"WITH $pred, {_CUM.format('PARTITION BY set_id ')} SELECT set_id, round({_PRC}, 8) AS auprc FROM c GROUP BY 1"))
def _(s, d):
    return r(M.ragged_auprc(pred(s, d)))


_FSETS = "p AS (SELECT o_orderkey AS id, o_custkey AS set_id, o_totalprice AS score, (o_orderstatus = 'F')::bigint AS target FROM orders)"


def _f(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("set_id"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("long").alias("target"))


@query("f1_max", f"WITH {_FSETS}, a AS (SELECT *, row_number() OVER w AS k, sum(target) OVER w AS h, sum(target) OVER (PARTITION BY set_id) AS n FROM p WINDOW w AS (PARTITION BY set_id ORDER BY score DESC, id)), b AS (SELECT *, h / k - coalesce(lag(h / k) OVER w, 0) AS dp, h / (n + 1e-10) - coalesce(lag(h / (n + 1e-10)) OVER w, 0) AS dr FROM a WINDOW w AS (PARTITION BY set_id ORDER BY score DESC, id)), c AS (SELECT sum(dp) OVER w / sum((k = 1)::int) OVER w AS p, sum(dr) OVER w / (SELECT count(DISTINCT set_id) FROM p) AS r FROM b WINDOW w AS (ORDER BY score DESC, id)) SELECT round(max(2 * p * r / (p + r + 1e-10)), 6) AS f1_max FROM c")
def _(s, d):
    return r(M.f1_max(_f(s, d)), 6)


@query("top_precision", f"WITH {_FSETS}, c AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, id) AS k FROM p) SELECT set_id, round(CASE WHEN count(*) < 5 THEN 0 ELSE sum(target) FILTER (k <= 5) / 5 END, 6)::double AS precision FROM c GROUP BY 1")
def _(s, d):
    return r(M.top_precision(_f(s, d), 5), 6)


@query("regression_metrics", sql("WITH $reg SELECT task, round(1 - avg(pow(pred - target, 2)) / var_pop(target), 8) AS r2, round(corr(pred, target), 8) AS pearsonr, round(avg(abs(pred - target)), 4) AS mae, round(sqrt(avg(pow(pred - target, 2))), 4) AS rmse FROM reg GROUP BY 1"))
def _(s, d):
    p, t = F.col("pred"), F.col("target")
    return reg(s, d).groupBy("task").agg(F.round(M.r2(p, t), 8).alias("r2"), F.round(M.pearson(p, t), 8).alias("pearsonr"), F.round(M.mae(p, t), 4).alias("mae"), F.round(M.rmse(p, t), 4).alias("rmse"))


@query("spearmanr", sql("WITH $reg, q AS (SELECT floor(pred / 100) AS a, floor(target / 100) AS b FROM reg), x AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM q) SELECT round((avg(ra * rb) - avg(ra) * avg(rb)) / (stddev_pop(ra) * stddev_pop(rb) + 1e-10), 6) AS spearman FROM x"))
def _(s, d):
    x = reg(s, d).select(F.floor(F.col("pred") / 100).alias("a"), F.floor(F.col("target") / 100).alias("b"))
    return r(M.spearman(x, "a", "b"), 6)


_CLS = "x AS (SELECT label AS target, (CASE WHEN v[1] > 0 THEN label ELSE (label + 1) % 10 END)::bigint AS predicted FROM emb)"


def _cls(s, d):
    return emb(s, d).select(F.col("label").alias("target"), F.when(F.col("v")[0] > 0, F.col("label")).otherwise((F.col("label") + 1) % 10).alias("predicted"))


@query("accuracy", sql(f"WITH $emb, {_CLS} SELECT round(avg((target = predicted)::int), 8) AS accuracy FROM x"))
def _(s, d):
    return r(M.accuracy(_cls(s, d)))


@query("matthews_corrcoef", sql(f"WITH $emb, {_CLS}, p AS (SELECT predicted AS c, count(*) AS p FROM x GROUP BY 1), t AS (SELECT target AS c, count(*) AS t FROM x GROUP BY 1), j AS (SELECT coalesce(p, 0) AS p, coalesce(t, 0) AS t FROM p FULL JOIN t USING (c)), a AS (SELECT sum(p * t)::double AS pt, sum(p * p)::double AS pp, sum(t * t)::double AS tt, sum(t)::double AS s FROM j) SELECT round(((SELECT count(*) FROM x WHERE target = predicted) * s - pt) / sqrt((s * s - pp) * (s * s - tt) + 1e-10), 8) AS mcc FROM a"))
def _(s, d):
    return r(M.matthews(_cls(s, d)))


@query("confusion_matrix", sql(f"WITH $emb, {_CLS} SELECT predicted, target, count(*) AS n FROM x GROUP BY ALL"))
def _(s, d):
    return M.confusion(_cls(s, d))


@query("variadic_accuracy", f"WITH {_FSETS}, b AS (SELECT set_id, arg_max(target, (score, -id)) AS t FROM p GROUP BY 1) SELECT round(avg(t), 8) AS accuracy FROM b")
def _(s, d):
    return r(M.ragged_accuracy(_f(s, d)))


# Ranking of every triplet against every tail. The score is the sum of a part of the query and a part of the entity, modulo 101, so
# queries with equal parts are a block: entities are counted by their part, and blocks of queries by score have 101 rows each.
_TEST = "test AS (SELECT DISTINCT h, r, t FROM kg), ent AS (SELECT DISTINCT t AS e FROM kg)"
_CAND = "cand AS (SELECT test.h || ':' || test.r || ':' || test.t AS query, e = test.t AS positive, k.t IS NOT NULL AS known, ((test.h * 31 + e * 17 + test.r * 7) % 101)::double AS score FROM test CROSS JOIN ent LEFT JOIN test k ON k.h = test.h AND k.r = test.r AND k.t = e)"


def _ranks(s, d, filtered):
    k = kg(s, d).select("h", "r", "t").distinct()
    part = ((F.col("h") * 31 + F.col("r") * 7) % 101).alias("block")
    ents = k.select("t").distinct().groupBy((F.col("t") * 17 % 101).alias("e")).agg(F.count("*").alias("n"))
    blocks = s.range(101).withColumnRenamed("id", "block").crossJoin(F.broadcast(ents)).groupBy("block", ((F.col("block") + F.col("e")) % 101).cast("double").alias("score")).agg(F.sum("n").alias("n"))
    test = k.select(F.concat_ws(":", "h", "r", "t").alias("query"), "h", "r", part, ((F.col("h") * 31 + F.col("t") * 17 + F.col("r") * 7) % 101).cast("double").alias("score"))
    return M.block_ranks(test, test, blocks, filtered)


for kind, cond in (("filtered", "ps <= score AND NOT known AND NOT positive"), ("unfiltered", "ps <= score")):
    _R = f"r AS (SELECT cand.query, count(*) FILTER ({cond}) + 1 AS rank FROM cand JOIN (SELECT query, score AS ps FROM cand WHERE positive) p ON p.query = cand.query GROUP BY 1)"

    @query(f"kgc_{kind}_rank", sql(f"WITH $kg, {_TEST}, {_CAND}, {_R} SELECT query, rank FROM r"))
    def _(s, d, kind=kind):
        return _ranks(s, d, kind == "filtered")

    @query(f"kgc_{kind}_metrics", sql(f"WITH $kg, {_TEST}, {_CAND}, {_R} SELECT round(avg(rank), 6) AS mr, round(avg(1 / rank), 8) AS mrr, round(avg((rank <= 1)::int), 8) AS hits_1, round(avg((rank <= 3)::int), 8) AS hits_3, round(avg((rank <= 10)::int), 8) AS hits_10 FROM r"))
    def _(s, d, kind=kind):
        return r(M.rank_metrics(_ranks(s, d, kind == "filtered"))).withColumn("mr", F.round("mr", 6))


@query("task_statistics", "SELECT task_id::bigint AS task, round(avg(v), 5) AS mean, round(stddev_samp(v), 4) AS std, count(v) AS n FROM (SELECT task_id, CASE WHEN isnan(value) OR abs(value) > 1000 THEN NULL ELSE value END AS v FROM targets) GROUP BY 1")
def _(s, d):
    t = table(s, d, "targets").select(F.col("task_id").cast("long").alias("task"), F.when(F.isnan("value") | (F.abs("value") <= 1000), F.col("value")).alias("value"))
    x = M.task_statistics(t)
    return x.select("task", F.round("mean", 5).alias("mean"), F.round("std", 4).alias("std"), "n")


@query("task_weights", sql("WITH $pred, n AS (SELECT set_id AS task, sum(target) AS p FROM pred GROUP BY 1) SELECT task, round(least(greatest((SELECT avg(p) FROM n) / p, 1), 10), 6) AS weight FROM n"))
def _(s, d):
    return r(M.task_weights(pred(s, d).withColumnRenamed("set_id", "task")), 6)


@query("binary_cross_entropy", sql("WITH $pred SELECT set_id, round(avg(greatest(z, 0) - z * target + ln(1 + exp(-abs(z)))), 6) AS loss FROM (SELECT set_id, target, (score - 250000) / 100000 AS z FROM pred) GROUP BY 1"))
def _(s, d):
    z = (F.col("score") - 250000) / 100000
    return pred(s, d).groupBy("set_id").agg(F.round(F.avg(M.bce(z, F.col("target"))), 6).alias("loss"))
