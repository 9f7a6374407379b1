"""Substring dedup by relative Lempel-Ziv parsing.

Documents are cut at anchors into passages (``repeats``), such that every window of ``window`` words lies in one passage
and equal windows lie under equal anchors. The reference is every distinct passage whose anchor occurs twice, in blocks: a
block is the passages under one anchor, indexed by a suffix array (``suffixes``). Each passage is factored greedily
against its block, the only one that can share a window with it: a factor is the longest match with another passage, or
all the rest of a passage that stands elsewhere as it is, or one word. Factors of ``window`` words or more are duplicate
spans. At a factor boundary, the windows that cross it and whose rest the next factor covers are looked up in the index; others
cannot repeat, so a boundary hides nothing. A document's spans are the union over its passages.

Two shortcuts change no result: an anchor with one distinct passage needs no parse, as copies of it are one factor each;
and blocks of over ``group_limit`` passages are not parsed but have their windows counted, spread over tasks.

Defined results: null and empty texts have no words. Repeated rows are documents of their own, so their texts repeat.
Texts under ``window`` words are never touched; very long texts are read in overlapping parts of 2^20 words. Ties in doc_id are
told apart by their texts. Extra columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import keyed, slices, work_dir
from frameloom.llm.repeats import Spec, covered, marks, with_marks

WINDOW, GRAM = 35, 9


def joined(repeats: np.ndarray) -> list[tuple[int, int]]:
    """(first word, length) of every run of words in duplicate spans."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], repeats.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def _marked(spark: SparkSession, docs: DataFrame, window: int, gram: int, group_limit: int) -> tuple[Spec, DataFrame]:
    spec, own = Spec(window, gram, "words", group_limit=group_limit, parse=True), keyed(docs)
    return spec, with_marks(own, marks(spark, own, spec, work_dir(spark, "substring")))


def parsed(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_limit: int = 4096) -> DataFrame:
    """Every row of docs (doc_id, text) as doc_id, text, n_words, spans (array of start, length in words)."""
    spec, marked = _marked(spark, docs, window, gram, group_limit)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, spans = [], []
            for text, runs in zip(batch["text"], batch["runs"].to_pylist(), strict=True):
                n = len(text.as_buffer().to_pybytes().split()) if text.is_valid else 0
                counts.append(n)
                spans.append([{"start": a, "length": b} for a, b in joined(covered(n, runs, spec))] if runs else [])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"].cast(pa.string()), pa.array(counts, pa.int64()), pa.array(spans, kind)], ["doc_id", "text", "n_words", "spans"])

    return marked.select("doc_id", "text", "runs").mapInArrow(parse, "doc_id long, text string, n_words long, spans array<struct<start: long, length: long>>")


def _cut(spec: Spec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        counts, removed, texts = [], [], []
        for text, runs in zip(batch["text"], batch["runs"].to_pylist(), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            keep = [w for w, x in zip(words, covered(len(words), runs, spec).tolist(), strict=True) if not x] if runs else words
            counts.append(len(words))
            removed.append(len(words) - len(keep))
            texts.append(b" ".join(keep))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_limit: int = 4096) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: every row of docs without the words of its duplicate spans."""
    spec, marked = _marked(spark, docs, window, gram, group_limit)
    return marked.select("doc_id", "text", "runs").mapInArrow(partial(_cut, spec), "doc_id long, n_words long, n_removed long, kept_text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), r AS (
  SELECT doc_id, i FROM g JOIN (SELECT s FROM g GROUP BY s HAVING count(*) > 1) USING (s)
), c AS (
  SELECT DISTINCT doc_id, i + k AS p FROM r, range(0, 35) AS t(k)
), p AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), k AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n
  FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY 1
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
