"""Profiles: centroids, condition groups, adaptation, consistency and guards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.vectors import blend, cosine

MERGE_COS, PER_GROUP, MOST_GROUPS, GUARD, BLEND, EVIDENCE_RATE = 0.70, 4, 4, 0.4, 0.1, 0.3


def centroids(rows: DataFrame) -> DataFrame:
    """grp, centroid: the element-wise mean of the vectors (grp, vec). One row a (group, place) is shuffled after partial
    aggregation, whatever the size of a group."""
    at = rows.select("grp", F.posexplode("vec").alias("pos", "x")).groupBy("grp", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return at.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def adapted(profiles: DataFrame, share: float = BLEND) -> DataFrame:
    """Adds adapted = share * centroid + (1 - share) * evidence; the evidence where there is no centroid, null without evidence."""
    both = blend(F.col("centroid"), F.col("evidence"), share)
    return profiles.withColumn("adapted", F.when(F.col("evidence").isNotNull(), F.when(F.col("centroid").isNull(), F.col("evidence").cast("array<double>")).otherwise(both)))


def evidence(rows: DataFrame, order: list[str], rate: float = EVIDENCE_RATE) -> DataFrame:
    """grp, evidence: the exponential mean of each group's vectors (grp, vec) in order, the first of them as it is. In closed form
    the k-th of n weighs rate * (1 - rate)^(n - k), the first without the rate; sums by (group, place) merge like a mean's."""
    w = Window.partitionBy("grp")
    k, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    weighed = rows.select("grp", "vec", *order).select("grp", "vec", (F.pow(F.lit(1 - rate), n - k) * F.when(k == 1, 1.0).otherwise(rate)).alias("w"))
    at = weighed.select("grp", "w", F.posexplode("vec").alias("pos", "x")).groupBy("grp", "pos").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("x"))
    return at.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("evidence"))


def evidence_step(evidence: np.ndarray | None, vec: np.ndarray, rate: float = EVIDENCE_RATE) -> np.ndarray:
    """The first evidence as it is, then an exponential mean."""
    return np.array(vec, float) if evidence is None else (1 - rate) * evidence + rate * np.asarray(vec, float)


def _cos(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / size if size else 0.0


def condition_means(anchors: np.ndarray) -> list[np.ndarray]:
    """Merge the two groups of closest means until clamp(n / 4, 1, 4) are left; with at most 4 left, stop once the closest
    are less alike than MERGE_COS. Of equal pairs the first by place merges. Cosines are kept in one upper triangle, of which a
    merge changes one row and one column."""
    means = np.array(anchors, float)
    n, alive, size = len(means), np.ones(len(means), bool), np.ones(len(means))
    left, budget = n, min(max(n // PER_GROUP, 1), MOST_GROUPS)

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)

    near = np.where(np.triu(np.ones((n, n), bool), 1), unit(means) @ unit(means).T, -np.inf)
    while left > budget:
        i, j = divmod(int(near.argmax()), n)
        if near[i, j] < MERGE_COS and left <= MOST_GROUPS:
            break
        means[i] = (means[i] * size[i] + means[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j], left = False, left - 1
        near[j], near[:, j] = -np.inf, -np.inf
        now = np.where(alive, unit(means) @ unit(means[i]), -np.inf)
        near[i, i + 1 :], near[:i, i] = now[i + 1 :], now[:i]
    return list(means[alive])


def condition_groups(rows: DataFrame) -> DataFrame:
    """grp, condition, centroid from anchors (grp, idx, vec); a profile's anchors are few, so one task takes a profile."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        means = condition_means(np.array(part["vec"].tolist(), float))
        return pd.DataFrame({"grp": part["grp"].iloc[0], "condition": range(len(means)), "centroid": [m.tolist() for m in means]})

    return rows.select("grp", "idx", "vec").groupBy("grp").applyInPandas(merge, "grp long, condition int, centroid array<double>")


def consistency(rows: DataFrame, least: int = 6, floor: float = 0.40) -> DataFrame:
    """grp, n, median_cos, accepted: the upper median of the cosines of a profile's anchor pairs (grp, idx, vec); 0 for fewer
    than two. Pairs stay within one enrolment, which is a few anchors."""
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.idx") < F.col("b.idx"))).select("a.grp", cosine(F.col("a.vec"), F.col("b.vec")).alias("cos"))
    middle = pairs.groupBy("grp").agg(F.sort_array(F.collect_list("cos")).alias("all")).select("grp", F.element_at("all", (F.floor(F.size("all") / 2) + 1).cast("int")).alias("median_cos"))
    out = rows.groupBy("grp").agg(F.count("*").alias("n")).join(middle, "grp", "left")
    out = out.withColumn("median_cos", F.coalesce("median_cos", F.lit(0.0)))
    return out.withColumn("accepted", (F.col("n") >= least) & (F.col("median_cos") >= floor))


def within_guard(scores: DataFrame, most: float = GUARD) -> DataFrame:
    """key, grp, distance, admitted from best_by_group: 1 - cosine, not floored; no anchors, no row."""
    distance = 1 - F.col("cos")
    return scores.select("key", "grp", distance.alias("distance"), (distance <= most).alias("admitted"))


def f0_statistics(rows: DataFrame, key: str, f0: str) -> DataFrame:
    """key, f0_mu, f0_sigma: mean and population deviation of the voiced (finite) values; 0 and 0 where none is."""
    x = F.col(f0).cast("double")
    voiced = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return rows.groupBy(key).agg(F.coalesce(F.avg(voiced), F.lit(0.0)).alias("f0_mu"), F.coalesce(F.stddev_pop(voiced), F.lit(0.0)).alias("f0_sigma"))


def pooled(n1, mean1, var1, n2, mean2, var2):
    """The count-weighted mean and variance of two parts, as (mean, variance) columns."""
    n = n1 + n2
    mean = (n1 * mean1 + n2 * mean2) / n
    square = (n1 * (var1 + mean1 * mean1) + n2 * (var2 + mean2 * mean2)) / n
    return mean, F.greatest(square - mean * mean, F.lit(0.0))
