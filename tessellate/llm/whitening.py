"""Whitening of embeddings with a tiled covariance.

Vectors become long vectors x; the fit list holds each distinct x once. Its rows are cut into row blocks, the columns of a row
block into column blocks of `tile` dimensions. Each pair of column blocks is a tile key: the two blocks of a row block meet
under (row block, tile key) in a shuffle, are centred and multiplied there, and the products are summed per tile, by task first.
What leaves the executors is the covariance alone, dimensions x dimensions numbers however many rows there are; it is
decomposed on the driver, and every row is projected where it is read.

Rows whose vector is null or holds null, NaN or infinite entries are left out, and so are those that don't have the commonest
length (of equally common lengths the longest counts) and empty vectors. Ids may be null or repeated; repeated rows get equal
results. A component whose eigenvalue is under FLAT of the variance in all can't be scaled to one and is left out, so equal
vectors, or one, give no rows, and neither does an empty table. Only the two named columns are read. deviation is null where
it doesn't fit a long. A row block has ROWS rows, a task holds one, or the two column blocks of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

TILE = 16
ROWS = 2048
COMPONENTS = 16
FLAT = 1e-12
SCALE, SHIFT = 64, 1_000_000


def whole_numbers(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x): the vectors as longs, rows that can't take part left out."""
    entries = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), entries.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    common = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1)
    return rows.join(F.broadcast(common.select("size")), F.size("x") == F.col("size"), "left_semi")  # one row


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def column_sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Rows of the fit list, and its sum per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, np.int64)
        for batch in blocks(batches):
            x = matrix(batch.column(0))
            n, total = n + len(x), x.sum(0) + (total if len(total) else 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), n)), pa.array(total)], ["dim", "n", "s"])

    found = sorted(fit.mapInArrow(run, "dim int, n long, s long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    return (found[0].n if found else 0), np.array([r.s for r in found], np.int64)


def tile_sums(fit: DataFrame, mean: np.ndarray, tile: int = TILE, rows: int = ROWS) -> np.ndarray:
    """Sums of products of centred columns over the rows of fit (x), by tiles."""
    dims = len(mean)
    starts = list(range(0, dims, tile))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each row block, tile key and side of it: the column block. Blocks are numbered within the task's partition."""
        part, number = TaskContext.get().partitionId(), 0
        for batch in blocks(batches, rows):
            x = matrix(batch.column(0))
            cut = [np.ascontiguousarray(x[:, s : s + tile].T).tobytes() for s in starts]
            keys = [(i, j, side) for i in range(len(starts)) for j in range(i, len(starts)) for side in ([i] if i == j else [i, j])]
            out = [[(part << 32) + number] * len(keys), [k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [cut[k[2]] for k in keys]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["block", "i", "j", "side", "data"])
            number += 1

    def multiplied(pair: pa.Table) -> pa.Table:
        i, j = pair.column("i")[0].as_py(), pair.column("j")[0].as_py()
        got = {}
        for side, data in zip(pair.column("side").to_pylist(), pair.column("data").to_pylist()):
            middle = mean[starts[side] : starts[side] + tile]
            got[side] = np.frombuffer(data, np.int64).reshape(len(middle), -1) - middle[:, None]
        product = got[i] @ got[j].T
        a, b = np.indices(product.shape, dtype=np.int32)
        return pa.table({"a": a.ravel() + np.int32(starts[i]), "b": b.ravel() + np.int32(starts[j]), "v": product.ravel()})

    products = fit.mapInArrow(dealt, "block long, i int, j int, side int, data binary").groupBy("block", "i", "j").applyInArrow(multiplied, "a int, b int, v double")
    out = np.zeros((dims, dims))
    for r in products.groupBy("a", "b").agg(F.sum("v").alias("v")).collect():  # dimensions x dimensions numbers
        out[r.a, r.b] = out[r.b, r.a] = r.v
    return out


def projected(x: np.ndarray, model: dict) -> np.ndarray:
    return (x - model["mean"]) @ model["axes"]


def identity_error(fit: DataFrame, model: dict) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, minus the identity."""
    k = model["axes"].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in blocks(batches):
            w = projected(matrix(batch.column(0)), model)
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        a, b = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()), pa.array(b.ravel()), pa.array(total.ravel())], ["a", "b", "v"])

    total = np.zeros((k + 1, k))
    for r in fit.mapInArrow(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect():
        total[r.a, r.b] = r.v
    mean = total[k] / model["n"]
    return float(np.abs(total[:k] / model["n"] - np.outer(mean, mean) - np.eye(k)).max())


def fitted(fit: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> dict:
    """Mean, scaled axes and shares of variance of the fit list (x), which is read three times; axes are none without variance."""
    n, total = column_sums(fit)
    model = {"n": n, "sums": total, "mean": total / max(n, 1), "axes": np.zeros((len(total), 0)), "explained": np.zeros(0), "error": 0.0}
    if n == 0:
        return model
    cov = tile_sums(fit, model["mean"], tile) / n
    e, v = np.linalg.eigh(cov)
    top = np.argsort(-e, kind="stable")[:components]
    top = top[e[top] > FLAT * max(np.trace(cov), 1e-300)]
    model |= {"axes": v[:, top] / np.sqrt(e[top]), "explained": e[top] / np.trace(cov) if len(top) else np.zeros(0)}
    if len(top):
        model["error"] = identity_error(fit, model)
    return model


def deviations(x: np.ndarray, model: dict) -> pa.Array:
    """Sums of (n * x - S) ** 2, exact; null where a long can't hold it."""
    n, total = model["n"], model["sums"]
    about = (n**2 * (x - model["mean"]) ** 2).sum(1)
    fits = (about < 9.2e18) & (np.abs(x.astype(float)).max(1) * n < 9.2e18) & (np.abs(total.astype(float)).max(initial=0) < 9.2e18)
    with np.errstate(over="ignore"):
        exact = ((x * n - total) ** 2).sum(1)
    return pa.array(exact, pa.int64(), mask=~fits)


def whitened(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """A row for each remaining row of vectors and component: its whitened coordinate, and figures of the fit."""
    rows = base.written(whole_numbers(vectors, vector, key), "whitening-rows")
    fit = base.written(rows.select("x").distinct(), "whitening-fit")
    model = fitted(fit, components, tile)
    base.drop(fit)
    k = model["axes"].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            x = matrix(batch.column(1))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            values = projected(x, model).ravel()
            fixed = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(values), model["n"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), *map(pa.array, fixed), deviations(x, model).take(each), pa.array(values), pa.array(np.tile(model["explained"], len(x))), pa.array(np.full(len(values), model["error"]))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
