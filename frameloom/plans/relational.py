"""Relational queries on the star schema that Spark itself supplies. They have no counterpart among the engine's own operators."""

from __future__ import annotations

from pyspark.sql import functions as F


def rel_pricing_summary(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_shipdate <= timestamp '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.count("*").alias("n"))


def rel_revenue_by_nation(spark, sf):
    """The small sides are read whole, so their size is known to the planner, which broadcasts them only below its threshold."""
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("lineitem", "orders", "customer", "nation", "region")}
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def rel_orders_rollup(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def rel_customers_without_orders(spark, sf):
    c, o = spark.read.parquet(f"{sf}/customer.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def rel_event_sessions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    found = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("started"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select("user_id", "started", "n", "total")


QUERIES = {f.__name__: f for f in (rel_pricing_summary, rel_revenue_by_nation, rel_orders_rollup, rel_customers_without_orders, rel_event_sessions)}

ORACLES = {
    "rel_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "rel_revenue_by_nation": """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "rel_orders_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "rel_customers_without_orders": "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey",
    "rel_event_sessions": """SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) AS total FROM (
SELECT *, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)) GROUP BY user_id, s""",
}
