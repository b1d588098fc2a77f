"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and of their beginnings. Counterfactuals of each labelled training text:

- for each group of identity terms that its sentences name, the text with all those terms swapped for the others of the group, by
  every step around it;
- if they name none, copies with one neutral mention put in, a term of each group.

Features are presence in the whole text, so swapping a term in each of its sentences is a mapping of the distinct words; it is
made before beginnings are taken, so these are swapped too. The loss adds PENALTY times the mean square of the change of the
score (in logits) over the swaps, and the same over the mentions, so that naming a group moves no score. Changes that are
equal are held once, with their count. Words are chosen by chi-square (CHI or more, WORDS at most) on a bounded sample of SAMPLE labelled rows (the least by
hash of the id); scoring looks every distinct word of the whole text up in the table of weights.

Null and empty texts score the intercept. Labels that are null are left out; with several labels for a document the largest
counts; with no labels every score is 0.5. Rows without an id are scored but not learnt from; ids may repeat. Repeated rows get
equal scores. An empty table gives no rows. Other columns are not read. A text of any length is a step of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

SAMPLE = 20_000
WORDS = 1024
#: Least chi-square of a word against the label: below it a word more likely fits wrong labels than marks insults.
CHI = 20.0
STEMS = (4, 5, 6, 7)
LEAST = 3
PENALTY = 5.0
RIDGE = 3e-6
#: Weight of a toxic row against another: they are about a tenth.
TOXIC = 8.0
#: Identity terms in groups; a term is swapped for the others of its group.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives", "refugees"), ("old", "young"), ("disabled", "abled"), ("trans", "cis"),
)
TERMS = {term for group in IDENTITIES for term in group}
TOKEN = re.compile(r"[^\W\d_]+")


def named(text: str | None) -> set[str]:
    """Distinct words in lower case."""
    return set(TOKEN.findall((text or "").lower()))


def with_beginnings(found: set[str]) -> set[str]:
    """Words and, marked by a caret, the beginnings of longer ones: insults are inflected."""
    return found | {f"^{w[:n]}" for w in found for n in STEMS if len(w) >= n}


def words(text: str | None) -> set[str]:
    return with_beginnings(named(text))


def swaps(found: set[str]) -> list[set[str]]:
    """The words with the terms of each group they name swapped, by every step around the group."""
    out = []
    for group in IDENTITIES:
        if found & set(group):
            for step in range(1, len(group)):
                other = {term: group[(i + step) % len(group)] for i, term in enumerate(group)}
                out.append({other.get(w, w) for w in found})
    return out


def mentions(found: set[str], nth: int) -> list[set[str]]:
    """The words with a mention of a term of each group put in; nth picks the terms."""
    return [found | {group[nth % len(group)]} for group in IDENTITIES]


def labelled(docs: DataFrame, marks: DataFrame, column: str, usable: Column, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most limit labelled rows: the label side is bounded before it is broadcast."""
    y = marks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).filter(usable & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(y), "doc_id")


def train(sample: DataFrame, penalty: float = PENALTY) -> dict:
    """Learn from rows (doc_id, text, y)."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(["\n".join(sorted(named(t))) for t in part.column(1).to_pylist()], pa.string())], ["doc_id", "y", "words"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(tokens, "doc_id long, y int, words string")
    chosen = _choose(rows)
    vocabulary = {w: i for i, w in enumerate(chosen)}

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda found: {vocabulary[w] for w in with_beginnings(found) & vocabulary.keys()}
        for batch in batches:
            own, changes, kinds = [], [], []
            for doc_id, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                found = set(line.split("\n"))
                x = at(found)
                kind = bool(found & TERMS)
                others = map(at, swaps(found) if kind else mentions(found, doc_id))
                # a feature that goes is written as its complement
                changes.append([sorted([*(y - x), *(~i for i in x - y)]) for y in others])
                own.append(sorted(x))
                kinds.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(kinds), pa.array(changes, pa.list_(pa.list_(pa.int32())))], ["doc_id", "y", "x", "kind", "changes"])

    data = rows.mapInArrow(indices, "doc_id long, y int, x array<int>, kind boolean, changes array<array<int>>")
    data = sorted(data.collect(), key=lambda r: (r.doc_id, r.y, r.x)) if chosen else []
    x = np.zeros((len(data), len(chosen)), np.float32)
    seen: Counter = Counter()
    for i, r in enumerate(data):
        x[i, r.x] = 1
        seen.update((r.kind, tuple(c)) for c in r.changes if c)
    total = {kind: sum(n for (k, _), n in seen.items() if k == kind) for kind in (True, False)}
    change, share = np.zeros((len(seen), len(chosen)), np.float32), np.zeros(len(seen))
    for i, ((kind, places), n) in enumerate(sorted(seen.items())):
        share[i] = n / total[kind]
        for at in places:
            change[i, at if at >= 0 else ~at] = 1 if at >= 0 else -1
    pairs = {"swaps": total[True], "mentions": total[False]}
    return {"vocabulary": vocabulary, "pairs": pairs, **fit(x, np.array([r.y for r in data], np.float32), change, share, penalty)}


def _choose(rows: DataFrame) -> list[str]:
    """The WORDS words that go with the label most, by chi-square, of those with CHI or more, and all identity terms."""
    own = F.filter(F.split("words", "\n"), lambda w: w != "")
    stems = F.flatten(F.transform(own, lambda w: F.concat(*(F.when(F.length(w) >= n, F.array(F.concat(F.lit("^"), F.substring(w, 1, n)))).otherwise(F.array().cast("array<string>")) for n in STEMS))))
    exploded = rows.select("y", F.explode(F.array_distinct(F.concat(own, stems))).alias("w"))
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    n, p = float(total.n), float(total.p or 0)
    table = exploded.groupBy("w").agg(F.count("*").cast("double").alias("d"), F.sum("y").cast("double").alias("a")).filter(F.col("d") >= LEAST)
    top = table.withColumn("chi", F.expr(f"pow(a * {n}D - d * {p}D, 2) * {n}D / (d * greatest({n}D - d, 1D) * greatest({p * (n - p)}D, 1D))")).filter((F.col("chi") >= CHI) & (F.col("a") * n > F.col("d") * p)).orderBy(F.desc("chi"), "w").limit(WORDS)
    return sorted({r.w for r in top.select("w").collect()} | TERMS)


def fit(x: np.ndarray, y: np.ndarray, change: np.ndarray, share: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> dict:
    """Minimise weighted log loss + RIDGE |w|^2 + penalty * sum of share * (change . w)^2 by Adam with a falling step; no weight is
    under 0, as no word speaks for a text that insults."""
    w, b = np.zeros(x.shape[1], np.float64), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = np.where(y > 0, TOXIC, 1.0)
    weight /= max(weight.sum(), 1)
    for t in range(1, rounds + 1 if len(y) else 1):
        error = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30))) - y
        error *= weight
        grad = np.append(x.T @ error.astype(np.float32) + 2 * RIDGE * w, error.sum())
        if len(change):
            grad[:-1] += 2 * penalty * (change.T @ (share * (change @ w)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return {"w": w, "b": float(b)}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row. No shuffle."""
    weight = dict(zip(sorted(model["vocabulary"], key=model["vocabulary"].get), model["w"].tolist()))
    b = model["b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weight.keys()
        for part in base.steps(batches):
            z = [b + sum(weight[w] for w in sorted(known & words(t))) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op10_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    held = F.coalesce(base.fold("doc_id", 3) == 1, F.lit(False))
    model = train(labelled(docs, base.labels(spark, sf_dir), "toxic", ~held, SAMPLE))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
