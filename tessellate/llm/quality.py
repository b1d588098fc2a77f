"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few shape figures. Cyclic boosting visits them in turn with a small step; each visit fits a shallow tree
to the gradients on the figure's bins and adds it to the figure's lookup table. Then the pairs that lower the loss most get
tables over two coarser bins, boosted the same way. A score is the logistic of the intercept plus one table entry for each
figure and pair: additions over binned columns.

Training takes SAMPLE labelled rows at most (the least by hash of the id). Null and empty texts have figures of zero and are
scored like any other. Null labels are left out; with no labels every score is 0.5. Repeated rows get equal scores. Ids may be
null (never labelled) or repeated, an empty table gives an empty table, a text of any length is a step of its own, and no other
column is read. Ties between pairs and splits go to the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .toxicity import labelled

SAMPLE = 20_000
BINS, COARSE = 32, 8
PAIRS = 6
ROUNDS, STEP = 150, 0.1
FIGURES = ("log_words", "word_length", "symbols", "upper", "digits", "marks", "exclaims", "repeated_lines", "distinct_words", "distinct_triples", "line_length", "letters", "pipes", "longest_word")


def figures(column: pa.Array) -> np.ndarray:
    data, at = base.utf8(column)
    n = np.maximum(np.diff(at), 1)
    share = lambda chars: base.per_text(np.isin(data, np.frombuffer(chars, np.uint8)), at) / n
    upper = base.per_text((data >= 65) & (data <= 90), at)
    letters = upper + base.per_text((data >= 97) & (data <= 122), at) + base.per_text(data >= 128, at)
    out = np.zeros((len(n), len(FIGURES)), np.float32)
    for i, text in enumerate(base.pieces(data, at)):
        w = text.split()
        lines = [x for x in text.split(b"\n") if x]
        k = len(w)
        if k:
            out[i, [0, 1, 7, 8, 9, 10, 13]] = np.log1p(k), sum(map(len, w)) / k, 1 - len(set(lines)) / len(lines), len(set(w)) / k**0.9, len(set(zip(w, w[1:], w[2:]))) / max(1, k - 2), np.log1p(len(text) / len(lines)), np.log1p(max(map(len, w)))
    for at_, values in ((2, share(b"#*$%&|<>")), (3, upper / np.maximum(letters, 1)), (4, share(b"0123456789")), (5, share(b".,;:?")), (6, share(b"!")), (11, letters / n), (12, share(b"|"))):
        out[:, at_] = values
    return out


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T)], 1) if len(cuts) else np.zeros((len(x), 0), int)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[int, float]:
    """Best place to cut bins in two, and the gain over not cutting."""
    if len(g) < 2:
        return 0, 0.0
    left, mass = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left**2 / (mass + ridge) + (g.sum() - left) ** 2 / (h.sum() - mass + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(gain.argmax())
    return at + 1, float(gain[at])


def tree(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> np.ndarray:
    """Values by bin of a tree of depth two."""
    out = np.zeros(len(g))
    middle, _ = _cut(g, h, ridge)
    for a, b in ((0, middle), (middle, len(g))):
        inner, _ = _cut(g[a:b], h[a:b], ridge)
        for c, d in ((a, a + inner), (a + inner, b)):
            if d > c:
                out[c:d] = -g[c:d].sum() / (h[c:d].sum() + ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> tuple[np.ndarray, float]:
    """Values over two bins of the best tree that cuts the first and then, in each part, the second; and its gain."""
    best = (-1.0, 0, ())
    for middle in range(1, len(g)) or (len(g),):  # every first cut: the gain of an interaction shows in the second cuts only
        parts = [(a, b, *_cut(g[a:b].sum(0), h[a:b].sum(0), ridge)) for a, b in ((0, middle), (middle, len(g))) if b > a]
        gain = sum(p[3] + g[p[0] : p[1]].sum() ** 2 / (h[p[0] : p[1]].sum() + ridge) for p in parts) - g.sum() ** 2 / (h.sum() + ridge)
        best = max(best, (gain, middle, tuple(parts)))
    out = np.zeros(g.shape)
    for a, b, inner, _ in best[2]:
        for c, d in ((0, inner), (inner, g.shape[1])):
            out[a:b, c:d] = -g[a:b, c:d].sum() / (h[a:b, c:d].sum() + ridge)
    return out, best[0]


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    if not len(y):
        return {"b": 0.0, "cuts": [], "coarse": [], "tables": [], "pairs": {}}
    cuts, coarse = edges(x, BINS), edges(x, COARSE)
    at, rough = binned(x, cuts), binned(x, coarse)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b = float(np.log(rate / (1 - rate)))
    z = np.full(len(y), b)
    tables = [np.zeros(len(c) + 1) for c in cuts]

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for i, table in enumerate(tables):
            g, h = slopes()
            step = STEP * tree(np.bincount(at[:, i], g, len(table)), np.bincount(at[:, i], h, len(table)))
            table += step
            z += step[at[:, i]]
    g, h = slopes()
    shape = [len(c) + 1 for c in coarse]
    code = {(i, j): rough[:, i] * shape[j] + rough[:, j] for i, j in combinations(range(len(cuts)), 2)}
    grid = lambda k, v: np.bincount(code[k], v, shape[k[0]] * shape[k[1]]).reshape(shape[k[0]], shape[k[1]])
    chosen = sorted(code, key=lambda k: (-pair_tree(grid(k, g), grid(k, h))[1], k))[:PAIRS]
    pairs = {k: np.zeros((shape[k[0]], shape[k[1]])) for k in chosen}
    for _ in range(ROUNDS // 3):
        for k, table in pairs.items():
            g, h = slopes()
            step = STEP * pair_tree(grid(k, g), grid(k, h))[0]
            table += step
            z += step.ravel()[code[k]]
    return {"b": b, "cuts": cuts, "coarse": coarse, "tables": tables, "pairs": pairs}


def score(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.full(len(x), model["b"])
    at, rough = binned(x, model["cuts"]), binned(x, model["coarse"])
    for i, table in enumerate(model["tables"]):
        z += table[at[:, i]]
    for (i, j), table in model["pairs"].items():
        z += table[rough[:, i], rough[:, j]]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(sample: DataFrame) -> dict:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([v.tobytes() for v in figures(part.column(1))], pa.binary())], ["doc_id", "y", "x"])

    rows = sorted((r.doc_id, r.y, bytes(r.x)) for r in sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x binary").collect())
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, len(FIGURES))
    return fit(x, np.array([r[1] for r in rows], float))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(figures(part.column(1)), model))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    held = F.coalesce(base.fold("doc_id", 5) == 0, F.lit(False))
    model = train(labelled(docs, base.labels(spark, sf_dir), "quality", ~held, SAMPLE))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
