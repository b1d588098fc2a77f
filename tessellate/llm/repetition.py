"""Quality rules with suffix-array repetition.

The words of each text are numbered and sorted as suffixes (prefix doubling over a whole step of texts at once; a text's
number leads the sort key, so matches never cross texts). The longest-common-prefix array gives, for each suffix, the
deepest LCP interval that holds it: its value is the longest substring at that place that occurs elsewhere in the text.
The spans of all maximal repeats of min_words or more are united; the rule limits the covered share of the words and the
longest repeat.

Null, empty and blank texts have no words and fail the base rule. Repeated rows are judged one by one. Other columns are
not read, so they can't clash. Ids may be null or repeated; an empty table gives an empty table. Memory: about 100 bytes for each word of a step of base.STEP_BYTES (or of one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

MIN_WORDS = 10
MAX_COVERED = 0.3
MAX_LONGEST = 100
SYMBOLS = b"#*$%&|<>"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


def repeat_lengths(tokens: np.ndarray, texts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the most tokens from there on that also occur, as a sequence, elsewhere in the same text.

    tokens: numbers; texts: number of the text of each position, ascending; ends: for each position, where its text ends.
    """
    n = len(tokens)
    if n < 2:
        return np.zeros(n, np.int64)
    key = texts.astype(np.int64) * (int(tokens.max()) + 1) + tokens
    suffixes = np.argsort(key, kind="stable")
    ordered = key[suffixes]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    slot = np.arange(n)
    rank = np.empty(n, np.int32)
    rank[suffixes] = np.maximum.accumulate(np.where(fresh, slot, 0))
    ranks, length = [rank], 1
    while True:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = suffixes[slots]
        after = at + length
        second = np.where(after < ends[at], rank[np.minimum(after, n - 1)].astype(np.int64), -1)
        first = rank[at].astype(np.int64)
        order = np.argsort(first * (n + 1) + second + 1, kind="stable")
        at, first, second = at[order], first[order], second[order]
        suffixes[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        fresh[slots] = new
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        ranks.append(rank)
        length *= 2
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(texts[a] == texts[b])
    for level in range(len(ranks) - 1, -1, -1):
        p, q = a[live] + common[live], b[live] + common[live]
        inside = (p < ends[a[live]]) & (q < ends[b[live]])
        same = inside & (ranks[level][np.minimum(p, n - 1)] == ranks[level][np.minimum(q, n - 1)])
        common[live] += np.where(same, 1 << level, 0)
    around = np.zeros(n + 1, np.int64)
    around[1:n] = common
    longest = np.empty(n, np.int64)
    longest[suffixes] = np.maximum(around[:-1], around[1:])
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions the united spans of repeats of at least `least` tokens cover."""
    change = np.zeros(len(longest) + 1, np.int64)
    starts = np.flatnonzero(longest >= least)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + longest[starts], -1)
    return np.cumsum(change[:-1]) > 0


def measure(data: np.ndarray, at: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    texts = base.pieces(data, at)
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    known: dict[bytes, int] = {}
    tokens = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, int(counts.sum()))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(texts)), counts)
    longest = repeat_lengths(tokens, owner, np.repeat(bounds[1:], counts))
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    space = np.zeros(256, bool)
    space[list(b" \t\n\r\x0b\x0c")] = True
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, owner, longest)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "n_words": counts,
        "word_chars": base.per_text((data & 0xC0 != 0x80) & ~space[data], at),
        "n_symbols": base.per_text(table[data], at),
        "n_dup_lines": np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, len(lines)),
        "n_repeat_words": base.per_text(covered(longest, 3), bounds),
        "covered_words": base.per_text(covered(longest, min_words), bounds),
        "longest_repeat": top,
    }


def repetition(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per row of docs (doc_id, text): word and repetition figures, base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            found = measure(*base.utf8(part.column(1)), min_words)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(v, pa.int64()) for v in found.values())], ["doc_id", *found])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("covered_words") <= F.lit(max_covered) * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(base.documents(spark, sf_dir)).drop("longest_repeat")


# Windows of 3, 10 and 101 words by their hashes: repeats of as many words and more cover what the windows cover.
SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
a AS (SELECT doc_id, n, i, w, CASE WHEN i <= n - 2 THEN hash(w, lead(w, 1) OVER o, lead(w, 2) OVER o) END AS h3, CASE WHEN i <= n - {MIN_WORDS - 1} THEN hash({", ".join(f"lead(w, {j}) OVER o" for j in range(MIN_WORDS))}) END AS h10 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, CASE WHEN i <= n - {MAX_LONGEST} THEN hash({", ".join(f"lead(h10, {j}) OVER o" for j in range(0, MAX_LONGEST, MIN_WORDS))}, lead(w, {MAX_LONGEST}) OVER o) END AS h101 FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, h3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h3) > 1 AS r3, h10 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h10) > 1 AS r10, h101 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h101) > 1 AS r101 FROM b),
e AS (SELECT doc_id, max(CASE WHEN r3 THEN i END) OVER l3 AS s3, max(CASE WHEN r10 THEN i END) OVER l10 AS s10, r101 FROM c
  WINDOW l3 AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), l10 AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
f AS (SELECT doc_id, count(s3) AS n_repeat_words, count(s10) AS covered_words, bool_or(r101) AS long FROM e GROUP BY 1),
g AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(covered_words, 0) AS BIGINT) AS covered_words, coalesce(long, false) AS long FROM d LEFT JOIN f USING (doc_id)),
h AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM g)
SELECT * EXCLUDE (long), NOT base_failed AND covered_words <= CAST({MAX_COVERED} AS DOUBLE) * n_words AND NOT long AS kept FROM h"""
