"""Queries over ragged sets."""

from pyspark.sql import functions as F

from spindrel.operators import ragged as R
from spindrel.plans.registry import query
from spindrel.plans.views import sets, sql

A = "array"


def _sizes(spark, d):
    return R.sizes_of(sets(spark, d))


@query("variadic_sum", sql("WITH $sets SELECT set_id, round(sum(value), 2) AS total FROM sets GROUP BY set_id"))
def _(s, d):
    return R.ragged_sum(sets(s, d)).withColumn("total", F.round("total", 2))


@query("variadic_mean", sql("WITH $sets SELECT set_id, round(avg(value), 6) AS mean FROM sets GROUP BY set_id"))
def _(s, d):
    return R.ragged_mean(sets(s, d)).withColumn("mean", F.round("mean", 6))


@query("variadic_max", sql("WITH $sets SELECT set_id, max(value) AS top, arg_max(pos, (value, -pos)) AS arg FROM sets GROUP BY set_id"))
def _(s, d):
    return R.ragged_max(sets(s, d))


@query("variadic_sort", sql("WITH $sets SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY value, pos) - 1 AS place, value, pos FROM sets"))
def _(s, d):
    return R.ragged_sort(sets(s, d))


@query("variadic_sort_descending", sql("WITH $sets SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY value DESC, pos) - 1 AS place, value, pos FROM sets"))
def _(s, d):
    return R.ragged_sort(sets(s, d), descending=True)


def _thousandths(s, d):
    return sets(s, d).withColumn("value", F.col("value") / 1000)


_SOFT = "WITH $sets, x AS (SELECT set_id, pos, value / 1000 - max(value / 1000) OVER (PARTITION BY set_id) AS x FROM sets)"


@query("variadic_softmax", sql(_SOFT + " SELECT set_id, pos, round(exp(x) / sum(exp(x)) OVER (PARTITION BY set_id), 8) AS p FROM x"))
def _(s, d):
    return R.ragged_softmax(_thousandths(s, d)).withColumn("p", F.round("p", 8))


@query("variadic_log_softmax", sql(_SOFT + " SELECT set_id, pos, round(x - ln(sum(exp(x)) OVER (PARTITION BY set_id)), 6) AS p FROM x"))
def _(s, d):
    return R.ragged_softmax(_thousandths(s, d), log=True).withColumn("p", F.round("p", 6))


@query("variadic_cross_entropy", sql(_SOFT + ", l AS (SELECT set_id, pos, x - ln(sum(exp(x)) OVER (PARTITION BY set_id)) AS p, count(*) OVER (PARTITION BY set_id) AS n FROM x) SELECT set_id, round(-p, 6) AS loss FROM l WHERE pos = set_id % n"))
def _(s, d):
    x = _thousandths(s, d)
    target = R.sizes_of(x).select("set_id", (F.col("set_id") % F.col("size")).alias("target"))
    return R.ragged_cross_entropy(x, target).withColumn("loss", F.round("loss", 6))


@query("variadic_arange", sql("WITH $sets, n AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1) SELECT set_id, unnest(range(n)) AS pos FROM n"))
def _(s, d):
    return R.ragged_arange(_sizes(s, d))


_TOP = "WITH $sets, r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY value DESC, pos) - 1 AS place, count(*) OVER (PARTITION BY set_id) AS n FROM sets)"


@query("variadic_topk", sql(_TOP + " SELECT set_id, place, value, pos FROM r WHERE place < 3"))
def _(s, d):
    return R.ragged_topk(sets(s, d), 3)


@query("variadic_topk_each", sql(_TOP + " SELECT set_id, place, value, pos FROM r WHERE place < set_id % 4"))
def _(s, d):
    return R.ragged_topk(sets(s, d), F.col("set_id") % 4)


@query("variadic_topk_padded", sql(_TOP + " SELECT set_id, k AS place, value, pos FROM r, range(3) AS g(k) WHERE place = least(k, n - 1)"))
def _(s, d):
    return R.ragged_topk(sets(s, d), 3, padded=True)


@query("variadic_meshgrid", sql("WITH $sets SELECT a.set_id, a.pos AS pos_a, a.value AS a, b.pos AS pos_b, b.value AS b FROM sets a JOIN sets b USING (set_id) WHERE a.pos % 2 = 0 AND b.pos % 2 = 1"))
def _(s, d):
    x = sets(s, d)
    return R.ragged_meshgrid(x.where("pos % 2 = 0"), x.where("pos % 2 = 1"))


def _padded_text(p):
    text = F.concat_ws(",", F.transform("padded", lambda x: x.cast("decimal(12,2)").cast("string")))
    return p.select("set_id", text.alias("padded"), F.size(F.filter("mask", lambda x: x)).cast("long").alias("n_real"))


# Padded to the largest set, so no row is lost.
_WIDTH = "n AS (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM sets GROUP BY set_id))"


@query("variadic_to_padded", sql(f"WITH $sets, {_WIDTH} SELECT set_id, array_to_string(list_transform(range(m), lambda i: coalesce(list(cast(value AS decimal(12, 2)) ORDER BY pos)[i + 1], 0)::varchar), ',') AS padded, count(*) AS n_real FROM sets, n GROUP BY set_id, m"))
def _(s, d):
    return _padded_text(R.to_padded(sets(s, d)))


@query("padded_to_variadic", sql("WITH $sets SELECT set_id, pos, value FROM sets"))
def _(s, d):
    x = sets(s, d)
    return R.from_padded(R.to_padded(x), R.sizes_of(x))


@query("variadic_extend", sql("WITH $sets, n AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1) SELECT set_id, pos, value FROM sets UNION ALL SELECT set_id, pos + n, -value FROM sets JOIN n USING (set_id) WHERE pos < 2"))
def _(s, d):
    x = sets(s, d)
    return R.extended(x, x.where("pos < 2").withColumn("value", -F.col("value")))


_SPANS = "spans AS (SELECT set_id, pos % 5 AS a, pos % 5 + set_id % 3 AS b FROM sets)"


def _spans(s, d):
    return sets(s, d).select("set_id", (F.col("pos") % 5).alias("start"), (F.col("pos") % 5 + F.col("set_id") % 3).alias("end"))


@query("multi_slice", sql(f"WITH $sets, {_SPANS} SELECT DISTINCT set_id, unnest(range(a, b)) AS pos FROM spans"))
def _(s, d):
    return R.multi_slice(_spans(s, d))


@query("multi_slice_mask", sql(f"WITH $sets, {_SPANS}, c AS (SELECT DISTINCT set_id, unnest(range(a, b)) AS pos FROM spans) SELECT s.set_id, s.pos, c.pos IS NOT NULL AS covered FROM sets s LEFT JOIN c ON s.set_id = c.set_id AND s.pos = c.pos"))
def _(s, d):
    return R.multi_slice_mask(_spans(s, d), _sizes(s, d))


@query("as_mask", sql("WITH $sets SELECT set_id, pos, pos % 3 = 1 AS covered FROM sets"))
def _(s, d):
    x = sets(s, d)
    return R.as_mask(x.where("pos % 3 = 1"), R.sizes_of(x))


@query("masked_mean", sql("WITH $sets SELECT set_id, round(coalesce(sum(value) FILTER (pos % 3 = 1), 0) / greatest(count(*) FILTER (pos % 3 = 1), 1), 4) AS mean FROM sets GROUP BY 1"))
def _(s, d):
    return sets(s, d).groupBy("set_id").agg(F.round(R.masked_mean(F.col("value"), F.col("pos") % 3 == 1), 4).alias("mean"))


@query("mean_with_nan", "SELECT task_id::bigint AS task_id, round(avg(value) FILTER (value IS NOT NULL AND NOT isnan(value) AND abs(value) < 1e6), 5) AS mean FROM targets WHERE task_id IS NOT NULL GROUP BY 1")
def _(s, d):
    from spindrel.session import table

    v = F.when(F.abs("value") < 1e6, F.col("value"))
    return table(s, d, "targets").where("task_id is not null").groupBy(F.col("task_id").cast("long").alias("task_id")).agg(F.round(R.mean_with_nan(v), 5).alias("mean"))


_KEY = "('0x' || substr(md5(concat_ws('-', {})), 1, 8))::bigint"


@query("variadic_randperm", sql(f"WITH $sets SELECT set_id, pos, row_number() OVER (PARTITION BY set_id ORDER BY {_KEY.format('7, set_id, pos')}, pos) - 1 AS place FROM sets"))
def _(s, d):
    return R.ragged_randperm(sets(s, d), 7)


@query("variadic_sample", sql(f"WITH $sets, n AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1) SELECT set_id, k AS draw, {_KEY.format('7, set_id, k')} % n AS pos FROM n, range(4) g(k)"))
def _(s, d):
    return R.ragged_sample(_sizes(s, d), 4, 7)
