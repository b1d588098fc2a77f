"""Writers: the corpus by group, its index, JSON reports, and rewrites of small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import stored


def corpus_sink(rows: DataFrame, path: str, group: str = "source_group") -> None:
    """Parquet by group; rows of a group that are written by one task share its files."""
    rows.write.mode("overwrite").partitionBy(group).parquet(path)


def index_sink(docs: DataFrame, path: str, **how) -> stored.Index:
    """The index of docs (doc_id, text), written once; what rankings read instead of the texts."""
    stored.write(docs, path, **how)
    return stored.Index(docs.sparkSession, path)


def report_sink(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls written too."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def without(sessions: DataFrame, gone: DataFrame, key: str = "conv_id") -> DataFrame:
    """Sessions but for those of gone (key); a null key is never gone."""
    return sessions.join(gone.select(key).distinct(), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that of the highest order; of equals a new one."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    whole = F.struct(*[c for c in both.columns])
    return both.groupBy(key).agg(F.max_by(whole, F.struct(order, "_n")).alias("_r")).select("_r.*").drop("_n")


def with_front_matter(body: Column, **fields: Column) -> Column:
    """A note with its fields in front."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.regexp_replace(body, r"(?U)^\s+|\s+$", ""), F.lit("\n"))


def notes_sink(rows: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One row for each note as text files, in a folder for each name."""
    rows.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path, lineSep="\n")


def restated(graph: DataFrame, sources: DataFrame, at: str) -> DataFrame:
    """A graph document (public_sources, stats, ...) with its sources and what counts them put in anew; the rest stays."""
    fresh = sources.agg(F.sort_array(F.collect_list(F.struct(*sources.columns))).alias("s"), F.count("*").alias("n"), F.count_if("readable").alias("r"))  # a graph's sources: one row of it
    stats = F.col("stats").withField("public_sources", F.col("n")).withField("public_sources_readable", F.col("r"))
    return graph.crossJoin(fresh).withColumns({"public_sources": F.col("s"), "stats": stats, "generated_at": F.lit(at)}).drop("s", "n", "r")
