"""Shared helpers: the shared working folder, staged tables, whole rows beside private columns, bounded samples."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_WORK: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="frameloom-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


def out_dir(spark: SparkSession, name: str) -> str:
    """A new folder for files that are a result and stay."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, which ``clear`` or the end of the driver removes."""
    _WORK.append(out_dir(spark, name))
    return _WORK[-1]


@atexit.register
def clear() -> None:
    """Remove the intermediate tables made so far; results that still read them must have been written elsewhere."""
    while _WORK:
        with contextlib.suppress(OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
            files, path = pafs.FileSystem.from_uri(_WORK.pop())
            files.delete_dir(path)


def staged(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished jobs."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_KEPT: dict = {}


def kept_by_worker(key, make):
    """What a Python worker keeps between tasks, such as results for words already met: for one use at a time, so that the
    stages of a pipeline do not add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def slices(batches, rows: int = 256):
    """Arrow batches in short pieces, so that Python objects of only a few rows live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def parallel(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, th and text, where (doc_id, th) names a row up to exact repeats of that row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))


def named(rows: DataFrame) -> DataFrame:
    """rows (doc_id, th) with columns that name a row and are never null."""
    return rows.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__none": F.col("doc_id").isNull(), "__th": F.col("th")})


NAME = ["__none", "__id", "__th"]


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame) -> Column:
    """All columns of docs as one struct ``row``, so that no name in it can clash with columns put beside it."""
    return F.struct(*map(quoted, docs.columns)).alias("row")


def together(batches, least: int):
    """Arrow tables of a slice's rows, or of ``least`` bytes if that is more."""
    held, size = [], 0
    for batch in slices(batches):
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def filtered(docs: DataFrame, judge: Callable[[pa.ChunkedArray], list[bool]], least: int = 0) -> DataFrame:
    """The rows of docs whose text ``judge`` accepts; it sees the texts of a slice, or of ``least`` bytes. Columns as in docs."""
    names, place = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def keep(batches):
        for table in together(batches, least):
            yield from table.filter(pa.array(judge(table.column(place)), pa.bool_())).to_batches()

    return plain.mapInArrow(keep, plain.schema).toDF(*names)


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct rows (text, by) for each value of by, those of the least hash of doc_id and text; rows:
    doc_id, text, by. Rows are kept by thresholds on the hash, so no group meets in one task; the driver gets the count and
    about twice ``most`` hashes for each value of by."""
    own = rows.select("by", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).alias("h"))
    scale = 1 << 53
    least = {r["by"]: min(scale, 2 * most * scale // r["n"]) for r in own.groupBy("by").agg(F.count("*").alias("n")).collect()}
    if not least:
        return own.select("by", "text")

    def under(bounds: dict) -> Column:
        return F.col("h") <= F.element_at(F.create_map(*(F.lit(x) for kv in bounds.items() for x in kv)), F.col("by"))

    found: dict = {}
    for r in own.where(under(least)).select("by", "h").distinct().collect():
        found.setdefault(r["by"], []).append(r["h"])
    cut = {by: sorted(found.get(by, [0]))[:most][-1] for by in least}
    return own.where(under(cut)).groupBy("by", "h").agg(F.first("text").alias("text")).select("by", "text")


def one_each(docs: DataFrame, rooted: DataFrame, work: str) -> DataFrame:
    """One row of docs for each root, that of the smallest doc_id (none comes last), then of the least hash of its text;
    rooted: doc_id, th and root of every row. Columns as in docs."""
    first = named(rooted).groupBy("root").agg(F.min(F.struct(*NAME)).alias("x")).select("x.*")
    own = named(docs.select("doc_id", F.xxhash64("text").alias("th"), whole(docs))).select(*NAME, "row")
    kept = own.join(staged(first, f"{work}/firsts").hint("merge"), NAME)
    return kept.groupBy(*NAME).agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
