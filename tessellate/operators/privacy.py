"""Privacy reports: what a corpus still holds, by pattern and severity, and what sanitising changed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHANGED, MEDIUM, SCANNED, transformations

MASKED = r"\[已脱敏[^\]]*\]"


def findings(files: DataFrame, text: str = "body", patterns: Mapping[str, str] = SCANNED, medium: tuple[str, ...] = MEDIUM) -> DataFrame:
    """(pattern, severity, count, files) for every pattern, those without a match too; masks are left out first.

    Each file gives one row of counts, summed before the shuffle. An empty table has all counts 0.
    """
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), MASKED, "")
    rows = files.select(bare.alias("t")).select(*(F.regexp_count("t", F.lit(p)).alias(f"p{i}") for i, p in enumerate(patterns.values())))
    sums = rows.agg(*(a for i in range(len(patterns)) for a in (F.coalesce(F.sum(f"p{i}"), F.lit(0)).alias(f"n{i}"), F.count_if(F.col(f"p{i}") > 0).alias(f"f{i}"))))
    each = F.array(*(F.struct(F.lit(name).alias("pattern"), F.lit("medium" if name in medium else "high").alias("severity"), F.col(f"n{i}").alias("count"), F.col(f"f{i}").alias("files")) for i, name in enumerate(patterns)))
    return sums.select(F.inline(each))


def summary(found: DataFrame) -> DataFrame:
    """(high_risk, medium_risk, status): blocked if anything of high severity is left."""
    sums = found.agg(*(F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("count"))), F.lit(0)).alias(f"{s}_risk") for s in ("high", "medium")))
    return sums.withColumn("status", F.when(F.col("high_risk") == 0, "pass").otherwise("blocked"))


def changes(files: DataFrame, text: str = "body", mail: str | None = None) -> DataFrame:
    """(pattern, count) for every pattern: matches over all files before anything is changed. An empty table has all counts 0."""
    sums = files.select(transformations(F.coalesce(F.col(text), F.lit("")), mail).alias("m")).agg(*(F.coalesce(F.sum(F.col("m")[k]), F.lit(0)).alias(k) for k in CHANGED))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("pattern"), F.col(k).alias("count")) for k in CHANGED))))
