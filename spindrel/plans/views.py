"""The supplied tables as graphs, ragged sets, chains and predictions: as DataFrames, and as common table expressions for SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrel.session import table


def relations(spark, d):
    """Order priorities as relation ids (a handful of rows)."""
    p = table(spark, d, "orders").select("o_orderpriority").distinct()
    return p.withColumn("r", (F.dense_rank().over(Window.orderBy("o_orderpriority")) - 1).cast("long"))


def kg(spark, d):
    """Triplets ``h, r, t, weight``: customers, priorities of their orders, suppliers (after the customers), and quantities."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    n = table(spark, d, "customer").count()
    rel = F.broadcast(relations(spark, d))
    j = l.select("l_orderkey", "l_suppkey", "l_quantity").join(o.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).join(rel, "o_orderpriority")
    return j.groupBy(F.col("o_custkey").alias("h"), "r", (F.col("l_suppkey") + n).alias("t")).agg(F.sum("l_quantity").alias("weight"))


def pg_nodes(spark, d):
    """Nodes of one graph a nation: customers (even ids) and suppliers (odd ids), with a value and a flag."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("graph_id"), (F.col("c_custkey") * 2).alias("node_id"), F.col("c_acctbal").alias("value"), (F.col("c_mktsegment") == "BUILDING").alias("flag"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("graph_id"), (F.col("s_suppkey") * 2 + 1).alias("node_id"), F.col("s_acctbal").alias("value"), (F.col("s_suppkey") % 2 == 0).alias("flag"))
    return c.unionByName(s)


def pg_edges(spark, d):
    """Edges of those graphs: orders of a customer from a supplier of the same nation."""
    o, l = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy(F.col("c_nationkey").cast("long").alias("graph_id"), (F.col("c_custkey") * 2).alias("node_in"), (F.col("s_suppkey") * 2 + 1).alias("node_out")).agg(F.sum("l_quantity").alias("weight"))


def chain(spark, d):
    """One chain an order: residues in the order of its lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), (F.col("l_partkey") % 20).alias("residue_type"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("q"))


def sets(spark, d):
    return chain(spark, d).select(F.col("graph_id").alias("set_id"), "pos", "value")


def emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


def pred(spark, d):
    """Scores and binary targets of orders, grouped by priority."""
    o = table(spark, d, "orders").join(F.broadcast(relations(spark, d)), "o_orderpriority")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("long").alias("target"), F.col("r").alias("set_id"))


def reg(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_extendedprice").alias("pred"), (F.col("l_quantity") * F.col("p_retailprice")).alias("target"), (F.col("l_suppkey") % 7).alias("task"))


def ev(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


VIEWS = {
    "kg": """kg AS (SELECT o_custkey AS h, p.r, l_suppkey + (SELECT count(*) FROM customer) AS t, sum(l_quantity) AS weight
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS r FROM (SELECT DISTINCT o_orderpriority FROM orders)) p USING (o_orderpriority) GROUP BY ALL)""",
    "pn": """pn AS (SELECT c_nationkey::bigint AS graph_id, c_custkey * 2 AS node_id, c_acctbal AS value, c_mktsegment = 'BUILDING' AS flag FROM customer
 UNION ALL SELECT s_nationkey::bigint, s_suppkey * 2 + 1, s_acctbal, s_suppkey % 2 = 0 FROM supplier)""",
    "pe": """pe AS (SELECT c_nationkey::bigint AS graph_id, c_custkey * 2 AS node_in, s_suppkey * 2 + 1 AS node_out, sum(l_quantity) AS weight
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey GROUP BY ALL)""",
    "chain": """chain AS (SELECT l_orderkey AS graph_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS pos,
 l_partkey % 20 AS residue_type, l_extendedprice AS value, l_quantity AS q FROM lineitem)""",
    "sets": """sets AS (SELECT l_orderkey AS set_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS pos, l_extendedprice AS value FROM lineitem)""",
    "emb": "emb AS (SELECT vec_id, embedding::double[] AS v, label::bigint AS label FROM embeddings)",
    "pred": """pred AS (SELECT o_orderkey AS id, o_totalprice AS score, (o_orderstatus = 'F')::bigint AS target, r AS set_id FROM orders
 JOIN (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS r FROM (SELECT DISTINCT o_orderpriority FROM orders)) USING (o_orderpriority))""",
    "reg": "reg AS (SELECT l_extendedprice AS pred, l_quantity * p_retailprice AS target, l_suppkey % 7 AS task FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "ev": "ev AS (SELECT event_id, ts, user_id, event_type, value FROM events)",
}


def sql(text: str) -> str:
    """``text`` with each ``$name`` replaced by the common table expression of that view."""
    return re.sub(r"\$(\w+)", lambda m: VIEWS[m[1]], text)
