"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the first four return the columns of
docs, extra ones of any name included. ``run`` writes each stage's rows as Parquet into the shared folder and reads them again.

Defined results, by stage, for null, empty, very long, tied and repeated rows: language_id drops texts without a letter (null
and empty ones too) and judges repeated rows alike; near_dedup takes null, empty and white-space texts as copies of each other
and keeps one of any repeated rows, ties in doc_id falling to the least hash; decontaminate keeps texts without words; mix
counts null texts as size 0 and orders ties by text; tokens writes the end id alone for null and empty texts. Texts of any length
are read whole. An empty table passes through every stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import near_copies, op3_language, op4_mixing, op6_decontaminate, op10_tokens
from frameloom.llm.common import out_dir, remove, staged, work_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best language has under half of the probability, go."""
    return op3_language.accepted(spark, docs, op3_language.learned(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, that of the smallest doc_id. Copies are linked by op1's fingerprints
    (SimHash, covering tables, 2 bits) and by five-word shingles of similarity 0.8 or more."""
    return near_copies.deduplicated(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    return op6_decontaminate.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return op4_mixing.mixed(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; one row a document, read back from them."""
    return op10_tokens.documents_of(*op10_tokens.written(spark, docs, out_dir(spark, "tokens")))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

ORACLE_SQL = None  # SQL has no language model, no min-hash bands and no tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if last:  # the next stage's rows are whole
            remove(spark, last)
        last = f"{folder}/{name}"
    return docs
