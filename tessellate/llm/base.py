"""What the operators of this subpackage share: shared-folder tables, text buffers and batching."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text and rows that one step of a Python task holds at once (a longer text is a step of its own).
STEP_BYTES = 1 << 20
STEP_ROWS = 2048
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets one; any other raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not kept.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessellate-"))
            kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get()
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors.

    What the write shuffled is dropped when it ends, as nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `written` gave, once all that reads them is itself written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like those given that are not taken (case aside)."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo parts (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def key_of(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes that together name a row of docs; null and empty texts are one."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(doc_id, text), F.hash(text, doc_id)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after another, and n + 1 offsets into them. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with as many rows at most, whose texts have about limit bytes at most."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(sizes):
            before = sizes[start - 1] if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(sizes, before + limit, "right"))))
            yield batch.slice(start, end - start)
            start = end


def pieces(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    ends = at.tolist()
    return [raw[s:e] for s, e in zip(ends, ends[1:])]


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between the offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(odd: int, n: int) -> np.ndarray:
    """odd**0 ... odd**(n - 1), modulo 2**64."""
    out = np.empty(n, np.uint64)
    out[:1] = 1
    size, step = 1, odd % 2**64
    while size < n:
        take = min(size, n - size)
        out[size : size + take] = out[:take] * np.uint64(step)
        size, step = size * 2, step * step % 2**64
    return out


def power_of(odd: int, at: np.ndarray) -> np.ndarray:
    """odd to each of the given powers, modulo 2**64."""
    out, step, left = np.ones(len(at), np.uint64), odd % 2**64, at.copy()
    while left.any():
        out[left & 1 == 1] *= np.uint64(step)
        left >>= 1
        step = step * step % 2**64
    return out


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] of them), then those of starts[1], and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(first - starts, lengths)
