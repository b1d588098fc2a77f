"""The corpus pipeline: documents to token ids in five stages, each on all that the one before kept.

1. language: documents that language ID rejects go.
2. near_duplicates: the document with the smallest id of each component of near copies (five words, similarity 0.8) stays.
3. substrings: bytes under a string of REPEATED bytes that occurs again go; documents without a word left go.
4. mixing: sources are mixed to their target weights; a row for each document and epoch that gives words.
5. tokens: SentencePiece ids and their round trip.

All but the last return the columns of documents, other columns included whatever their names. No stage is expressible in SQL
as a whole, so ORACLE_SQL is None; tests/llm/test_pipeline.py compares each stage and run() with brute force on a small table.

In every stage ids may be null or repeated, and an empty table gives an empty table. Null and empty texts have no language and
go in the first stage; in the others they would be one class of copies (2), be left out (3, 4) and have no ids (5). A text of
any length is held whole by one task, in a step of its own. Repeated rows are copies: one stays in stage 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellate.llm import base, language, mixing, nearcopies, segmentation, substrings

ORACLE_SQL = None
#: Passages of over 50 words that occur again go: 50 words of six bytes with their space (op7's own query asks for 400).
REPEATED = 300


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are far from every language's centroids, or have no letter. The model learns from docs itself.

    Rows without a language don't teach; with none at all every document goes. Equal scores go to the language first by code point.
    """
    model = language.train(docs, F.coalesce(base.fold("doc_id", 3) != 1, F.lit(True)))
    return language.accepted(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near copies: that of the least id, then of the least hash of its text.

    Candidates are found by op3's SimHash trie, beyond its 3 bits by min-hashes, and compared exactly.
    A row without an id stays if no row with one is like it; different texts with one id both stay.
    """
    return nearcopies.representatives(docs)


def cut_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated strings of REPEATED bytes out of the texts, every occurrence; drop documents that have no word left.

    What a cut leaves of a character goes too. Texts under REPEATED bytes are left as they are.
    """
    kept = substrings.cut_documents(docs, REPEATED)
    return kept.filter(F.col("text").rlike(base.WORD))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to target weights, block by block. A null source is a source; the same rows give the same mix."""
    return mixing.mixed(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether decoding gives the text back. Equal texts have equal ids."""
    return segmentation.encoded(docs, segmentation.model_bytes())


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_each),
    ("substrings", cut_repeated_substrings),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = base.written(docs, f"stage-{name}")
    return docs
