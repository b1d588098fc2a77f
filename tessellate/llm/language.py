"""Language ID by nearest centroid.

Texts are lower-cased; runs of letters count, any other ASCII is a space. Byte bigrams and trigrams hash to DIM dimensions;
their vector is log(1 + count) times inverse document frequency, normalised. Document frequencies come from every training
row; spherical k-means gives up to CENTROIDS centroids for each language on a bounded sample: of the language's distinct rows (id
and text) the SAMPLE that are least by hash, or all if it has fewer. The nearest centroid by cosine names the language. A text is
rejected if its cosine is under the language's limit: REJECT times the REJECT_AT quantile of the sample's cosines to their own
nearest centroid.

Each language is clustered in a task of its own; the driver holds its centroids (64 KB a language) and no sample. Texts that
are null, empty or have no letter are `und`, score 0, rejected. Training rows without a language are left out; with no training
rows every text is `und`. Ids may be null or repeated. Ties go to the language first in code point order. Repeated rows get
equal results. Extra columns of docs are kept; the three new ones take names that docs doesn't have (a `_` in front). A text of
any length is a step of its own. Memory: some 50 KB for each of the ROWS texts of a step besides the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import base

DIM = 4096
CENTROIDS = 4
SAMPLE = 400
REJECT, REJECT_AT = 0.5, 0.005
#: Texts that are looked at together.
ROWS = 128
LETTER = r"\p{L}"


def _table() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    for c in (*range(97, 123), *range(128, 256)):
        out[c] = c
    return out


def grams(column: pa.Array) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams, one float32 row for each text."""
    data, at = base.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    n = len(at) - 1
    out = np.zeros((n, DIM), np.float32)
    if len(data) < 3:
        return out
    c = _table()[data].astype(np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    for size in (2, 3):
        m = len(c) - size + 1
        code = np.full(m, size, np.uint32)
        for j in range(size):
            code = code * np.uint32(257) + c[j : j + m]
        code *= np.uint32(0x9E3779B1)
        code >>= np.uint32(32 - 12)
        inside = (owner[:m] == owner[size - 1 :]) & ~((c[:m] == 32) & (c[1 : m + 1] == 32))
        out += np.bincount(owner[:m][inside] * DIM + code[inside], minlength=n * DIM).reshape(n, DIM)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start."""
    centres = [x.sum(0)]
    centres[0] = centres[0] / max(np.linalg.norm(centres[0]), 1e-9)
    while len(centres) < min(k, len(x)):
        centres.append(x[np.stack([x @ c for c in centres]).max(0).argmin()])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = x[own == i].sum(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def train(docs: DataFrame, usable: Column) -> dict:
    """Learn from the rows of docs (doc_id, text, lang) for which usable holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(usable & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM, np.int64)
        for part in base.steps(batches, rows=ROWS):
            total += (grams(part.column(0)) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM)), pa.array(total)], ["dim", "n"])

    df = np.zeros(DIM)
    for r in rows.select("text").mapInArrow(seen, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df[r.dim] = r.n
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    idf = (np.log((1 + sum(counts.values())) / (1 + df)) + 1).astype(np.float32)
    if not counts:
        return {"langs": [], "idf": idf, "centres": np.zeros((0, DIM), np.float32), "owner": np.zeros(0, int), "limit": np.zeros(0)}
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text", F.lit(5)))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = hashed.select("lang", "h").distinct().withColumn("n", least).filter(F.col("n") <= SAMPLE).select("lang", "h")
    drawn = hashed.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])  # SAMPLE rows a language

    def clustered(table: pa.Table) -> pa.Table:
        text = table.sort_by("h").column("text").combine_chunks()
        x = np.concatenate([vectors(grams(text.slice(i, ROWS)), idf) for i in range(0, len(text), ROWS)])
        c = cluster(x, CENTROIDS)
        limit = REJECT * float(np.quantile((x @ c.T).max(1), REJECT_AT))
        return pa.table({"lang": [table.column("lang")[0].as_py()], "centres": pa.array([c.tobytes()], pa.binary()), "limit": [limit]})

    found = sorted((r.lang.encode(), bytes(r.centres), r.limit) for r in drawn.select("lang", "text", "h").groupBy("lang").applyInArrow(clustered, "lang string, centres binary, limit double").collect())
    langs = [lang.decode() for lang, *_ in found]
    centres = [np.frombuffer(c, np.float32).reshape(-1, DIM) for _, c, _ in found]
    return {"langs": langs, "idf": idf, "centres": np.concatenate(centres), "owner": np.repeat(np.arange(len(langs)), list(map(len, centres))), "limit": np.array([x for *_, x in found])}


def identify(docs: DataFrame, model: dict, prefix: str = "") -> DataFrame:
    """docs and, for each row, {prefix}lang_pred, {prefix}score, {prefix}rejected (with more `_` if docs has such). No shuffle."""
    names = docs.columns
    new = base.fresh(names, f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected")
    text = names.index("text")
    langs = np.array(["und", *model["langs"]], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centres, owner, limit = model["idf"], model["centres"], model["owner"], np.append(0, model["limit"])
        for part in base.steps(batches, rows=ROWS):
            column = part.column(text)
            lettered = pc.fill_null(pc.match_substring_regex(column, LETTER), False).to_numpy(zero_copy_only=False)
            if len(centres):
                near = vectors(grams(column), idf) @ centres.T
                best = near.argmax(1)
                score = np.clip(near[np.arange(len(best)), best], 0, 1).astype(float)
                lang = owner[best] + 1
            else:
                score, lang = np.zeros(len(part)), np.zeros(len(part), int)
            score, lang = np.where(lettered, score, 0.0), np.where(lettered, lang, 0)
            rejected = (lang == 0) | (score < limit[lang])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs[lang], pa.string()), pa.array(score), pa.array(rejected)], [*names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{new[0]}` string, `{new[1]}` double, `{new[2]}` boolean"
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that are not rejected, with its columns, whatever their names."""
    rejected = base.fresh(docs.columns, "lang_pred", "score", "rejected")[2]
    return identify(docs, model).filter(~F.col(rejected)).select(*docs.columns)


def op5_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    held = F.coalesce(base.fold("doc_id", 3) == 1, F.lit(False))
    model = train(docs, ~held)
    out = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
