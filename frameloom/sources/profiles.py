"""Profile documents as JSON: version 2, and version 1 whose learned vectors become their mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "version int, anchors array<array<double>>, evidence array<double>, auto_learn array<array<double>>, metadata struct<f0_mu: double, f0_sigma: double>"


def parsed(rows: DataFrame, text: str = "value") -> DataFrame:
    """Adds version, anchors, evidence, f0_mu, f0_sigma and error (null if the document can be used)."""
    p = F.from_json(text, SCHEMA)
    out = rows.withColumn("__p", p)
    learned = F.col("__p.auto_learn")
    n = F.size(learned)
    total = F.aggregate(F.slice(learned, 2, 1 << 30), F.element_at(learned, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    mean = F.when((F.col("__p.version") == 1) & (n > 0), F.transform(total, lambda x: x / n))
    known = F.coalesce(F.col("__p.version").isin(1, 2), F.lit(False))
    return out.select(
        *rows.columns, F.col("__p.version").alias("version"), F.coalesce("__p.anchors", F.array().cast("array<array<double>>")).alias("anchors"),
        F.coalesce(F.col("__p.evidence"), mean).alias("evidence"), F.coalesce("__p.metadata.f0_mu", F.lit(0.0)).alias("f0_mu"), F.coalesce("__p.metadata.f0_sigma", F.lit(0.0)).alias("f0_sigma"),
        F.when(~known, "unknown version").alias("error"),
    )


def rendered(profiles: DataFrame) -> DataFrame:
    """Adds value: the version 2 document of anchors, evidence, f0_mu and f0_sigma."""
    return profiles.withColumn("value", F.to_json(F.struct(F.lit(2).alias("version"), "anchors", "evidence", F.struct("f0_mu", "f0_sigma").alias("metadata"))))


def begun_empty(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The profiles of ``after`` that may be written: those that have anchors now and had none before the session, so that what
    a session learned never replaces an enrolment."""
    enrolled = before.where(F.size("anchors") > 0).select(key)
    return after.where(F.size("anchors") > 0).join(enrolled, key, "left_anti")
