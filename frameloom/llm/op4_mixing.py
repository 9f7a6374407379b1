"""Mixing sources to target weights by systematic sampling.

A source of S words with target T expects T / S copies of each of its documents. Documents of a source stand in order of
size; the prefix sum of expected copies plus one offset in [0, 1) per source crosses some integer boundaries at each
document, and the document is emitted once per boundary crossed. The order by size keeps the words taken near the target.
Expected copies and offset are integers in units of 2^-32, and a prefix sum is only needed modulo 2^32, so the sums are exact
at any number of documents and no document exceeds ``cap`` copies.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating; shares of all words by weight, capped at ``cap``
times a source's words; what is above goes to the others by weight, round after round until none is above. Sources are a
table that is numbered and summed like the documents, not a list in the driver.

Places come from a range partitioned sort: each task numbers its own rows, and sums over the counts of (task, source) give the
place of each task's first row. Repeated rows are spread over tasks by where they were read. No source, and no group of
repeats, has to fit in a task.

Defined results: null and empty texts have size 0, as have texts of white space; a source without words has target 0; a
document of size 0 may be emitted but takes no words. Very long texts are one document like any other. Rows that tie in
source, size, doc_id and text share the copies due to them in an arbitrary order. An empty table gives no rows. Extra columns
of any name are kept by ``mixed`` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm.common import parallel, staged, whole, work_dir

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text):
    """The number of words of a text; null has none."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def offset_of(source, seed: str = SEED):
    """The source's offset in units of 2^-32, 32 bits of a digest, so that reruns agree."""
    name = F.concat(F.lit(seed), F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def crossings(place, each, offset):
    """The integer boundaries between offset + place * each and one ``each`` later, all in units of 2^-32. The product is
    taken modulo 2^32 in halves, so that no step leaves 64 bits."""
    low = (1 << 32) - 1
    e = each.bitwiseAND(F.lit(low))
    high, rest = F.shiftrightunsigned(place, 16).bitwiseAND(F.lit(0xFFFF)), place.bitwiseAND(F.lit(0xFFFF))
    product = F.shiftleft((high * e).bitwiseAND(F.lit(0xFFFF)), 16) + rest * e
    return F.shiftrightunsigned((product + offset).bitwiseAND(F.lit(low)) + each, 32)


def targets(sizes: DataFrame, work: str, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target: one row a source. sizes: source, size, one row a document."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    by = by.repartitionByRange(min(parallel(by), 64), order).sortWithinPartitions(order).withColumn("n", F.monotonically_increasing_id())
    by = staged(by, f"{work}/sources").withColumn("task", F.shiftright("n", 33))
    ahead = F.sum("held").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))  # a row a task
    first = by.groupBy("task").agg(F.min("n").alias("least"), F.count("*").alias("held")).withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - F.col("least") + F.col("ahead")) % len(weights) + 1).cast("int")).cast("long")
    by = staged(by.join(F.broadcast(first), "task").select("source", "source_size", w.alias("w")), f"{work}/weights")
    total, weight = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    capped, gone = 0, 0
    while weight > gone:
        level = float(total - capped) / (weight - gone)
        above = F.col("source_size") * cap < F.lit(level) * F.col("w")
        now = by.where(above).agg(F.coalesce(F.sum(F.col("source_size") * cap), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if tuple(now) == (capped, gone):
            break
        capped, gone = now
    most = (F.col("source_size") * cap).cast("double")
    return by.select("source", "source_size", (F.least(F.lit(level) * F.col("w"), most) if weight > gone else most).alias("target"))


def copies(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, th, source, size, source_size, target, copies, one row a row of docs."""
    work = work_dir(spark, "mixing")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "source", size_of(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("at"))
    order = [F.col("source").asc_nulls_last(), "size", "doc_id", "th", "at"]
    rows = own.repartitionByRange(parallel(own), *order).sortWithinPartitions(*order).drop("at").withColumn("n", F.monotonically_increasing_id())
    rows = staged(rows, f"{work}/rows").withColumn("task", F.shiftright("n", 33))
    share = targets(rows, work, weights, cap)
    first = rows.groupBy("task", "source").agg(F.min("n").alias("least"), F.count("*").alias("held"))
    ahead = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("ahead", ahead).alias("f").join(share.alias("s"), F.col("f.source").eqNullSafe(F.col("s.source"))).select("task", "f.source", "least", "ahead", "source_size", "target")
    first = staged(first, f"{work}/tasks")
    out = rows.alias("r").join(first.hint("merge").alias("f"), (F.col("r.task") == F.col("f.task")) & F.col("r.source").eqNullSafe(F.col("f.source")))
    each = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * 4294967296.0)).otherwise(F.lit(0)).cast("long")
    place = F.col("n") - F.col("least") + F.col("ahead")
    return out.select("doc_id", "th", "r.source", "size", "source_size", "target", crossings(place, each, offset_of(F.col("r.source"), seed)).alias("copies"))


def mixed(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as in docs. Repeated rows are pooled: they come as often
    as all of them are taken."""
    work = work_dir(spark, "mixed")
    due = copies(spark, docs, weights, cap, seed).groupBy("doc_id", "th", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    due = staged(due.where("copies > 0"), f"{work}/due")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "source", whole(docs))
    on = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.th") == F.col("m.th")) & F.col("d.source").eqNullSafe(F.col("m.source"))
    got = own.alias("d").join(due.hint("merge").alias("m"), on).select("d.doc_id", "d.th", "d.source", "d.row", "m.copies", "m.rows")
    every = got.where("rows = 1").select("row", F.col("copies").alias("n"))
    if due.where("rows > 1").limit(1).count():
        # repeats are numbered task by task: no task holds all rows of one document
        several = got.where("rows > 1").repartition(parallel(got)).withColumn("m", F.monotonically_increasing_id())
        several = staged(several, f"{work}/several").withColumn("task", F.shiftright("m", 33))
        key = ["doc_id", "th", "source"]
        held = several.groupBy(*key, "task").agg(F.count("*").alias("held"))
        ahead = F.coalesce(F.sum("held").over(Window.partitionBy(*key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = staged(held.select(*key, "task", ahead.alias("ahead")), f"{work}/held")
        nth = several.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "task").orderBy("m")))
        both = [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*key, "task")]
        placed = nth.alias("s").join(held.hint("merge").alias("h"), both)
        extra = F.when(F.col("s.nth") + F.col("h.ahead") <= F.col("s.copies") % F.col("s.rows"), 1).otherwise(0)
        every = every.unionByName(placed.select("s.row", (F.expr("s.copies div s.rows") + extra).alias("n")))
    return every.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copies(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, text FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS weight,
         coalesce(sum(source_size) OVER b, 0) * 3 AS capped, coalesce(sum(w) OVER b, 0) AS gone
  FROM s WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min(CAST(total - capped AS DOUBLE) / (weight - gone), gone) AS lev FROM o
  WHERE CAST(total - capped AS DOUBLE) / (weight - gone) * w <= source_size * 3
), t AS (
  SELECT source, source_size, coalesce(least(lev * w, CAST(source_size * 3 AS DOUBLE)), CAST(source_size * 3 AS DOUBLE)) AS target,
         CAST(CAST('0x' || substr(md5('mix' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 8) AS BIGINT) AS HUGEINT)  AS u
  FROM s CROSS JOIN l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size * 4294967296.0::DOUBLE) AS HUGEINT) ELSE 0 END AS e,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((((n + 1) * e + u) // 4294967296 - (n * e + u) // 4294967296) * size AS BIGINT) AS taken FROM p
"""
