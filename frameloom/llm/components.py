"""Connected components by alternating large-star and small-star steps over staged edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import release, remove, staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(spark: SparkSession, edges: DataFrame, work: str) -> DataFrame:
    """edges (a, b) of long node ids -> node, root, where root is the least node of the component; nodes without an edge
    are left out. Every step keeps u > v; the steps end when they change nothing, as every component is a star then."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now, step = staged(edges.select(u, v).where("u <> v").distinct(), f"{work}/edges-0"), 0
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        least = staged(least, f"{work}/least-{step}")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, f"{work}/large-{step}")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), f"{work}/low-{step}")
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        step += 1
        now = staged(small.distinct(), f"{work}/edges-{step}")
        for name in (f"edges-{step - 1}", f"least-{step - 1}", f"large-{step - 1}", f"low-{step - 1}"):
            remove(spark, f"{work}/{name}")
        release(spark)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
