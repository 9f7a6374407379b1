"""Gate settings as text: 'v2 threshold hangover release', or three numbers of the first version."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, MOST = (0.05, 0.0, 0.0), (0.95, 2000.0, 2000.0)


def gate_settings(text: Column, floor: float = 0.45) -> Column:
    """struct(threshold, hangover_ms, release_ms), null if the text is of another version or malformed. Values are clamped; a
    first-version threshold is raised to the floor."""
    parts = F.split(F.trim(text), r"\s+")
    second = F.element_at(parts, 1) == "v2"
    numbers = F.when(second, F.slice(parts, 2, 9)).otherwise(parts)
    values = [F.element_at(numbers, i + 1).try_cast("double") for i in range(3)]
    fit = [F.least(F.lit(hi), F.greatest(F.lit(lo), v)) for v, lo, hi in zip(values, LEAST, MOST, strict=True)]
    fit[0] = F.when(second, fit[0]).otherwise(F.greatest(fit[0], F.lit(floor)))
    good = (F.size(numbers) == 3) & values[0].isNotNull() & values[1].isNotNull() & values[2].isNotNull()
    return F.when(good, F.struct(fit[0].alias("threshold"), fit[1].alias("hangover_ms"), fit[2].alias("release_ms")))


def separator_threshold(text: Column, usual: float = 0.45) -> Column:
    """A number from 0.05 to 0.95; anything else gives the usual one."""
    value = F.trim(text).try_cast("double")
    return F.when(value.between(0.05, 0.95), value).otherwise(usual)
