"""Texts cut into chunks at paragraph and sentence ends, and corpora into the chunks of a knowledge base: column expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Chunks
from ..functions import markdown as M
from ..functions.text import bare

UNIT = "array<struct<piece:string,glue:string,starts:boolean>>"


def units(text: Column, settings: Chunks) -> Column:
    """(piece, what joins it to the piece before, whether a chunk must start here).

    A paragraph is a piece; one over `most` characters gives its sentences, the first of which starts a chunk.
    """
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.filter(F.transform(F.split(text, settings.breaks) if settings.breaks else F.array(text), bare), lambda p: p != "")
    unit = lambda piece, glue, starts: F.struct(piece.alias("piece"), F.lit(glue).alias("glue"), starts.alias("starts"))
    sentences = lambda p: F.filter(F.split(p, f"(?<=[{re.escape(settings.ends)}])"), lambda s: s != "")
    each = F.transform(paragraphs, lambda p: F.when(F.length(p) <= settings.most, F.array(unit(p, "\n\n", F.lit(False)))).otherwise(F.transform(sentences(p), lambda s, n: unit(s, "", n == 0))).cast(UNIT))
    return F.flatten(each)


def chunks(text: Column, settings: Chunks = Chunks()) -> Column:
    """Greedy chunks of a text: one ends before a piece that would bring it over `most`, if it has `least` characters by then.

    A last chunk of under half of `least` joins the one before. Null texts and texts without a word give none.
    """
    nothing = F.array().cast("array<string>")
    start = F.struct(nothing.alias("done"), F.lit("").alias("now"))

    def add(held: Column, unit: Column) -> Column:
        size = F.length(held["now"])
        over = (size + F.length(unit["glue"]) + F.length(unit["piece"]) > settings.most) & (size >= settings.least)
        ends = (size > 0) & (unit["starts"] | over)
        done = F.when(ends, F.concat(held["done"], F.array(held["now"]))).otherwise(held["done"])
        return F.struct(done.alias("done"), F.when(ends | (size == 0), unit["piece"]).otherwise(F.concat(held["now"], unit["glue"], unit["piece"])).alias("now"))

    def finish(held: Column) -> Column:
        last, before = bare(held["now"]), F.element_at(held["done"], -1)
        short = (F.size(held["done"]) > 0) & (2 * F.length(last) < settings.least)
        joined = F.concat(F.slice(held["done"], 1, F.size(held["done"]) - 1), F.array(F.concat(before, F.lit("\n\n"), last)))
        return F.when(last == "", held["done"]).when(short, joined).otherwise(F.concat(held["done"], F.array(last)))

    return F.aggregate(units(text, settings), start, add, finish)


def chunked(docs: DataFrame, settings: Chunks = Chunks()) -> DataFrame:
    """(doc_id, chunk_index, content, content_length) of documents (doc_id, text), null ids too; null texts give no row. No shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), chunks(F.col("text"), settings).alias("c")).select("doc_id", F.posexplode("c").alias("chunk_index", "content"))
    return rows.withColumn("content_length", F.length("content"))


def knowledge(files: DataFrame, settings: Chunks = Chunks()) -> DataFrame:
    """The chunks of corpus files (name, body): files to subfiles, these to sections, these to chunks, in one pass without a shuffle.

    (name, subfile_index, chunk_index, subfile, chunk_title, section_title, learning_use, medical_safety, content, content_length,
    keywords). Subfiles without a word are left out and not numbered; a file without any, or a null body, gives no row.
    """
    content = lambda part: F.regexp_replace(M.body(part), r"(?ms)\A(.*?)^文件：[^\n]+\n+", "$1")  # noqa: E731  the first such line
    fields = M.front_matter(F.coalesce("body", F.lit("")))
    stated = lambda name, other: F.coalesce(F.nullif(F.try_element_at(fields, F.lit(name)), F.lit("")), F.lit(other)).alias(name)
    parts = F.filter(M.subfiles(F.coalesce("body", F.lit(""))), lambda p: bare(content(p)) != "")
    # what is exploded is a column by then: a generator would take the names off the structs within
    rows = files.select("name", stated("learning_use", "learning_research"), stated("medical_safety", "learning_only"), parts.alias("parts"))
    rows = rows.select("name", "learning_use", "medical_safety", F.posexplode("parts").alias("subfile_index", "part"))
    rows = rows.withColumns({
        "title": M.heading(F.col("part"), F.concat(F.lit("子文件"), (F.col("subfile_index") + 1).cast("string"))),
        "path": bare(F.regexp_extract("part", r"(?m)^文件：(.+)$", 1)), "sections": M.sections(content(F.col("part"))),
    })
    cut = F.transform("sections", lambda s: F.transform(chunks(s["content"], settings), lambda c: F.struct(s["title"].alias("section_title"), c.alias("content"))))
    rows = rows.withColumn("cut", F.flatten(cut)).select("*", F.posexplode("cut").alias("chunk_index", "c")).select("*", "c.*")
    led = F.concat(F.when(F.col("section_title") != "", F.concat(F.lit("# "), "section_title", F.lit("\n"))).otherwise(""), "content")
    return rows.select(
        "name", "subfile_index", "chunk_index", F.coalesce(F.nullif("path", F.lit("")), "title").alias("subfile"), F.coalesce(F.nullif("section_title", F.lit("")), "title").alias("chunk_title"), "section_title",
        "learning_use", "medical_safety", "content", F.length("content").alias("content_length"), M.keywords(led).alias("keywords"),
    )
