"""Feedback rows: checks, categories, lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..functions.text import bare

#: Most characters kept of each free field.
KEPT = {"contact": 200, "page": 500, "time": 50, "user_agent": 200}


def category(raw: Column, known: Sequence[str], other: str = "其他") -> Column:
    """A known category as it is, a blank one as `other`, any other cut to 20 characters."""
    c = bare(raw)
    return F.when(c == "", other).when(c.isin(*known), c).otherwise(F.substring(c, 1, 20))


def checked(rows: DataFrame, known: Sequence[str], limits: Limits = Limits()) -> DataFrame:
    """rows (content, category and any of KEPT) with clean fields and error: content_required, content_too_long or null."""
    content = bare(F.col("content"))
    error = F.when(content == "", "content_required").when(F.length(content) > limits.message_chars, "content_too_long")
    cut = {c: F.substring(bare(F.col(c)), 1, n) for c, n in KEPT.items() if c in rows.columns}
    return rows.withColumns({"error": error, "content": content, "category": category(F.col("category"), known), **cut})
