"""Message sequences: validation, repair, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Limits


def role_of(role):
    return F.when(role == "bot", "assistant").otherwise(role)


def validated(turns: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(conv_id, error): the first rule that a conversation (conv_id, turn, role, text) breaks, or null."""
    rows = turns.withColumn("r", role_of(F.col("role")))
    rows = rows.withColumn("before", F.lag("r").over(Window.partitionBy("conv_id").orderBy("turn")))
    error = (
        F.when(~F.coalesce(F.col("r").isin("user", "assistant"), F.lit(False)), "illegal_role")
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_content")
        .when(F.length("text") > limits.message_chars, "content_too_long")
        .when(F.col("before") == F.col("r"), "non_alternating")
    )
    return rows.withColumn("e", error).groupBy("conv_id").agg(F.min_by("e", F.when(F.col("e").isNotNull(), F.col("turn"))).alias("error"))


def tail(turns: DataFrame, n: int) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("from_end", last).filter(F.col("from_end") <= n)


def repaired(turns: DataFrame, n: int = 12) -> DataFrame:
    """Bad rows left out; of a run of one role the first user or last assistant message; ends trimmed to user ... assistant; the last n."""
    rows = turns.withColumn("r", role_of(F.col("role"))).filter(F.col("r").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("new", F.when(F.lag("r").over(by) == F.col("r"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    runs = rows.groupBy("conv_id", "run").agg(F.first("r").alias("role"), F.when(F.first("r") == "user", F.min("turn")).otherwise(F.max("turn")).alias("turn"), F.when(F.first("r") == "user", F.min_by("text", "turn")).otherwise(F.max_by("text", "turn")).alias("text"))
    whole = Window.partitionBy("conv_id")
    runs = runs.withColumn("first", F.min(F.when(F.col("role") == "user", F.col("run"))).over(whole)).withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("run"))).over(whole))
    runs = runs.filter("run >= first AND run <= last")
    return tail(runs.select("conv_id", "turn", "role", "text"), n).drop("from_end")


def summary(turns: DataFrame) -> DataFrame:
    user, bot = F.col("role") == "user", F.col("role") == "assistant"
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("messages"),
        F.substring(F.min_by("text", F.when(user, F.col("turn"))), 1, 30).alias("title"),
        F.substring(F.max_by("text", F.when(bot, F.col("turn"))), 1, 50).alias("preview"),
        F.max("turn").alias("last_turn"),
    )
