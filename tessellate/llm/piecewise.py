"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes marks boundaries: a place is one at block size 3 * 2**k if the hash plus one is a
multiple of it. k is the least level with at most 64 boundaries, so a signature has at most 65 characters, each from the
polynomial hash of one chunk's own bytes in order. A fingerprint is "k:signature:signature at k + 1". Two fingerprints compare
by edit distance wherever they have a signature at the same block size; signatures of five characters or more must share five
in a row.

Null and empty texts have the fingerprint "0::" and equal fingerprints are alike to 1. A null id counts as the least; equal
ids are ordered by a hash of their texts, then by text. A single document is its own neighbour; an empty table gives no rows.
Other columns are not read. A text of any length is a step of its own. Memory: a step of base.STEP_BYTES and base.STEP_ROWS.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

WINDOW = 7
MOST = 64
SHARED = 5
#: A chunk's hash: a number for each byte times powers of an odd number, modulo 2**64.
_random = np.random.default_rng(20240611)
BYTES = _random.integers(0, 2**64, 256, dtype=np.uint64)
ODD = int(_random.integers(2**61, 2**62)) * 2 + 1
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rolling(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the seven bytes that end at each place; the first six places of a text depend on their own byte only."""
    n = len(data)
    wide = data.astype(np.uint32)
    total, shifted = wide * np.uint32(WINDOW), wide.copy()
    for j in range(1, min(WINDOW, n)):
        total[j:] += wide[: n - j] * np.uint32(WINDOW - j)
        shifted[j:] ^= wide[: n - j] << np.uint32(5 * j)
        total[j:] += wide[: n - j]
    total += wide
    total += shifted
    heads = base.concat_ranges(at[:-1], np.minimum(np.diff(at), WINDOW - 1))
    total[heads] = wide[heads] * np.uint32(0x9E3779B1) | np.uint32(1)
    return total


def signatures(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """For each text its level k and its signatures at k and k + 1."""
    n = len(at) - 1
    if not len(data):
        return np.zeros(n, np.int64), [b""] * n, [b""] * n
    rolled = rolling(data, at)
    marked = rolled + np.uint32(1)
    head = np.zeros(len(data), bool)
    head[base.concat_ranges(at[:-1], np.minimum(np.diff(at), WINDOW - 1))] = True
    places = np.flatnonzero((marked % np.uint32(3) == 0) & ~head & (marked != 0))
    third = (marked[places] // np.uint32(3)).astype(np.int64)
    level = np.log2((third & -third).astype(np.float64)).astype(np.int64)
    owner = np.searchsorted(at, places, "right") - 1
    counts = np.bincount(owner * 34 + level, minlength=n * 34).reshape(n, 34)
    above = counts[:, ::-1].cumsum(1)[:, ::-1]  # boundaries at level k or over
    k = (above > MOST).sum(1)
    del rolled, marked
    value = BYTES[data] * base.powers(ODD, len(data))
    back = pow(ODD, -1, 2**64)
    out = []
    for plus in (0, 1):
        cut = level >= k[owner] + plus
        starts = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], places[cut] + 1]))
        starts = starts[starts < len(data)]
        sums = np.add.reduceat(value, starts) * base.power_of(back, starts)
        letters = LETTERS[base.mix64(sums) >> np.uint64(58)].tobytes()
        edge = np.searchsorted(starts, at).tolist()
        out.append([letters[s:e] for s, e in zip(edge, edge[1:])])
    return k, *out


def grams(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    wide = x.astype(np.int64)
    g = np.zeros((len(x), x.shape[1] - SHARED + 1), np.int64)
    for j in range(SHARED):
        g = g * 256 + wide[:, j : x.shape[1] - SHARED + 1 + j]
    g[np.arange(g.shape[1])[None, :] > (size - SHARED)[:, None]] = -1
    return g


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """1 - edit distance / longer length for pairs of signatures; 0 if one is empty or no five characters in a row are shared."""
    if len(a) > 2048:
        return np.concatenate([likeness(a[i : i + 2048], b[i : i + 2048]) for i in range(0, len(a), 2048)])
    if not a:
        return np.zeros(0)
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    width = max(int(la.max()), int(lb.max()), SHARED)
    x = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in a), np.uint8).reshape(-1, width)
    y = np.frombuffer(b"".join(s.ljust(width, b"\1") for s in b), np.uint8).reshape(-1, width)
    gx, gy = grams(x, la), grams(y, lb)
    shared = np.zeros(len(a), bool)
    for i in range(gx.shape[1]):
        shared |= ((gx[:, i : i + 1] == gy) & (gx[:, i : i + 1] >= 0)).any(1)
    open_ = (la > 0) & (lb > 0) & (shared | (np.minimum(la, lb) < SHARED))
    out = np.zeros(len(a))
    rows = np.flatnonzero(open_)
    if not len(rows):
        return out
    x, y, la, lb = x[rows], y[rows], la[rows], lb[rows]
    ramp = np.arange(width + 1, dtype=np.int16)
    prev = np.repeat(ramp[None, :], len(rows), 0)
    distance = np.where(la == 0, lb, 0)
    for i in range(width):
        now = np.empty_like(prev)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (x[:, i : i + 1] != y))
        now -= ramp
        np.minimum.accumulate(now, axis=1, out=now)
        now += ramp
        ends = np.flatnonzero(la == i + 1)
        distance[ends] = now[ends, lb[ends]]
        prev = now
    out[rows] = 1 - distance / np.maximum(la, lb)
    return out


def compare(one: tuple, other: tuple) -> np.ndarray:
    """Likeness of fingerprints given as (k, signatures at k, signatures at k + 1)."""
    (ka, a1, a2), (kb, b1, b2) = one, other
    n = len(ka)
    same = np.fromiter((x == y and v == w for x, y, v, w in zip(a1, b1, a2, b2)), bool, n) & (ka == kb)
    best = same.astype(float)
    for rows, x, y in ((ka == kb, a1, b1), (ka == kb, a2, b2), (ka == kb + 1, a1, b2), (kb == ka + 1, a2, b1)):
        rows = np.flatnonzero(rows & ~same)
        best[rows] = np.maximum(best[rows], likeness([x[i] for i in rows], [y[i] for i in rows]))
    return best


def shown(fingerprints: tuple) -> list[str]:
    return [f"{k}:{a.decode()}:{b.decode()}" for k, a, b in zip(fingerprints[0].tolist(), *fingerprints[1:])]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])


def pair_rows(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (id, bucket, peek, text) in order. A row for each that has its successor in the list."""
    texts = [r[3] for r in rows]
    prints = signatures(*joined(texts))
    heads = [i for i in range(len(rows) - 1) if not rows[i][2] and rows[i][1] == rows[i + 1][1]]
    pick = lambda p, at: (p[0][at], [p[1][i] for i in at], [p[2][i] for i in at])
    edited = []
    for i in heads:
        quarter = len(texts[i]) // 4
        edited.append(texts[i][: len(texts[i]) - quarter] + texts[i + 1][:quarter])
    own, new = pick(prints, heads), signatures(*joined(edited))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][0] for i in heads], pa.int64()),
            pa.array([len(texts[i]) for i in heads], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array(shown(own), pa.string()),
            pa.array(shown(new), pa.string()),
            pa.array(compare(own, new), pa.float64()),
            pa.array(compare(own, pick(prints, [i + 1 for i in heads])), pa.float64()),
        ],
        [x.split()[0] for x in SCHEMA.split(", ")],
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shown(signatures(*base.utf8(part.column(1)))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edges_of(cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Cut places as pairs of key and hash, in order: m cuts at one key part its rows evenly by hash."""
    keys, counts = np.unique(np.array(cuts, np.int64), return_counts=True)
    key = np.repeat(keys, counts)
    nth = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = [(-(2**63) + 2**64 * int(i) // int(m)) if m > 1 else -(2**63) for i, m in zip(nth, np.repeat(counts, counts))]
    return key, np.array(hashes, np.int64)


def bucket_of(cuts: tuple[np.ndarray, np.ndarray], k: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many cuts are at or before each (k, h)."""
    at = np.concatenate([cuts[0], k])
    by = np.lexsort((np.concatenate([np.zeros(len(cuts[0]), np.int8), np.ones(len(k), np.int8)]), np.concatenate([cuts[1], h]), at))
    before = np.cumsum(by < len(cuts[0]))
    out = np.empty(len(at), np.int64)
    out[by] = before
    return out[len(cuts[0]) :]


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document in ascending doc_id.

    Ids are cut into buckets at approximate quantiles, a few for each shuffle partition; an id with many rows is cut further, by
    the hash of their texts. Texts move once, sorted in their bucket, and the first text of each bucket also goes to the bucket
    before. Only bucket edges reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64("text").alias("h"))
    parts = base.partitions(spark)
    n = 4 * parts
    cuts = edges_of(rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).first()[0] or [])

    @F.arrow_udf("int")
    def bucket(k: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(bucket_of(cuts, k.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)), pa.int32())

    placed = rows.withColumn("b", bucket("k", "h"))
    edges = sorted((r.b, *r.first) for r in placed.groupBy("b").agg(F.min(F.struct("k", "h")).alias("first")).collect())
    # the first row of each bucket goes to the bucket before too; of rows with equal first keys all do, and only one counts
    firsts: list[dict | None] = [None] * (edges[-1][0] + 1 if edges else 0)
    for i, (b, k, h) in enumerate(edges):
        firsts[b] = {"k": k, "h": h, "before": edges[i - 1][0]}
    first = F.get(F.from_json(F.lit(json.dumps(firsts)), "array<struct<k: bigint, h: bigint, before: int>>"), F.col("b"))
    goes = F.when((first["k"] == F.col("k")) & (first["h"] == F.col("h")), F.array(F.struct("b", F.lit(0).alias("peek")), F.struct(first["before"].alias("b"), F.lit(1).alias("peek")))).otherwise(F.array(F.struct("b", F.lit(0).alias("peek"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for part in base.steps(batches, "text"):
            for row, n in zip(zip(*(part.column(i).to_pylist() for i in range(4))), pc.binary_length(part.column(3)).to_pylist()):
                if row[2] and held and held[-1][2] and held[-1][1] == row[1]:
                    continue  # only the first of the rows that peek into a bucket counts
                held.append(row)
                size += n
                if (size > base.STEP_BYTES or len(held) > base.STEP_ROWS) and len(held) > 1:
                    yield pair_rows(held)
                    held, size = held[-1:], n
        if len(held) > 1:
            yield pair_rows(held)

    spread = placed.select("doc_id", "text", "k", "h", F.explode(goes).alias("to"))
    dealt = spread.select("doc_id", "to.b", "to.peek", "text", "k", "h").repartition(parts, "b").sortWithinPartitions("b", "peek", "k", "h", "text")
    return dealt.select("doc_id", "b", "peek", "text").mapInArrow(run, SCHEMA)


def op2_piecewise_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(base.documents(spark, sf_dir))
