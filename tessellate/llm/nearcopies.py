"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of LEAST or more.

Candidates come from op3's trie: each class of texts gets a SimHash fingerprint of its set, the trie joins those that differ in
3 bits or fewer, and what these links connect is one bucket. At 0.8 two fingerprints differ in about ten bits, a budget at which
a trie prunes next to nothing. So what lies beyond 3 bits comes from min-hashes: BANDS keys of ROWS minima each, and texts with
a key alike are a bucket too (at 0.8 a pair shares none with probability 0.0004). Within a bucket the sets themselves are
compared, so no pair below LEAST is ever linked. Texts with equal sets are one class and compared once. A bucket of over HOT
classes is dealt in pairs of its parts, so that any two of its classes still meet: a bucket of n classes costs up to n * n / HOT
rows. Components of the links are the groups of near copies.

Words are split at ASCII white space and ASCII letters lowered. A text of five words or fewer is one shingle; null texts and texts without a
word are one class. Rows with a null doc_id take part like any other, repeated rows are one class, an empty table has no rows. A
text of any length is a step of its own, its set is held whole by the tasks that compare it. Other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, simhash
from .components import components

SHINGLE = 5
LEAST = 0.8
BANDS = 20
ROWS = 5
#: A bucket over this size is dealt in parts.
HOT = 128

_SEEDS = base.mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(2, BANDS, ROWS)
FLIP, TIMES = _SEEDS[0], _SEEDS[1] | np.uint64(1)
ROW = "doc_id long, th long, c long, fp long"


def shingles(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    digest, out = xxhash.xxh64_intdigest, []
    for text in texts:
        words = text.lower().split()
        line = b" ".join(words)
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = [s - 1 for s in starts[size:]] + [len(line)] * bool(words)
        out.append(np.array(sorted({digest(line[s:e], 42) for s, e in zip(starts, ends)}), np.uint64))
    return out


def classes_of(sets: list[np.ndarray]) -> np.ndarray:
    """int64 names of the sets; 0 for an empty one."""
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) if len(s) else 0 for s in sets], np.uint64).view(np.int64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS int64 keys of each set, none of which may be empty."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    if not len(sets):
        return out.view(np.int64)
    h = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for row in range(ROWS):
            key = base.mix64(key ^ np.minimum.reduceat((h ^ FLIP[band, row]) * TIMES[band, row], first))
        out[:, band] = key
    return out.view(np.int64)


def linked(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges that connect what the pairs of sets with a Jaccard similarity of least or more connect."""
    sizes = np.array(list(map(len, sets)), np.int64)
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    out, left = [], np.arange(len(sets))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            own = np.zeros(len(known), np.int64)
            own[codes[first[i] : first[i] + sizes[i]]] = 1
            shared = np.add.reduceat(own[codes], first)[left]
            near = shared >= least * (sizes[i] + sizes[left] - shared) - 1e-9
            out += [(int(i), int(j)) for j in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return out


def _source(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _rows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, th, c, fp, keys) of every row: hash of the text, class, fingerprint of the set, band keys. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            sets = shingles(base.pieces(*base.utf8(part.column(2))), size)
            keys = band_keys([s for s in sets if len(s)])
            at = np.cumsum([0, *(BANDS * bool(len(s)) for s in sets)]).astype(np.int32)
            fp = simhash.voted(np.concatenate(sets), np.array(list(map(len, sets)), np.int64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(classes_of(sets)), pa.array(fp), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))], ["doc_id", "th", "c", "fp", "keys"])

    return _source(docs).mapInArrow(run, f"{ROW}, keys array<long>")


def _met_in_trie(classes: DataFrame) -> DataFrame:
    """classes (c, fp, keys, ...) with one key more, before the others: the component of the trie's links that a fingerprint is in.

    The class of empty sets gets none.
    """
    found = components(simhash.links(classes.select("fp").distinct()), "near-trie")
    key = F.when(F.col("c") != 0, F.xxhash64(F.lit("trie"), F.coalesce("component", "fp")))
    return classes.join(found, classes.fp == found.node, "left").withColumn("keys", F.concat(F.array_compact(F.array(key)), "keys")).drop("node", "component")


def _members(classes: DataFrame, hot: int) -> DataFrame:
    """(key, c): the classes that are compared with each other; buckets of the same classes are taken once.

    No bucket is collected: its classes are known as a set by their number and two sums of their hashes.
    """
    pairs = classes.select("c", F.explode("keys").alias("key"))
    same = [F.count("*").alias("n"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("x")]
    sizes = pairs.groupBy("key").agg(*same).filter("n > 1")
    buckets = base.written(sizes.groupBy("n", "s", "x").agg(F.min("key").alias("b")).select("b", F.ceil(F.col("n") / hot).cast("long").alias("g")), "near-buckets")
    dealt = pairs.join(buckets, pairs.key == buckets.b).select("b", "g", "c").withColumn("m", F.expr("pmod(xxhash64(c), g)"))
    parts = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))).filter("g = 1 OR j <> m")
    return parts.select(F.xxhash64("b", F.least("m", "j"), F.greatest("m", "j")).alias("key"), "c")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(c, s): the shingle sets of the wanted rows (doc_id, th), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            sets = shingles(base.pieces(*base.utf8(part.column(0))), size)
            yield pa.RecordBatch.from_arrays([pa.array(classes_of(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["c", "s"])

    key = (F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("no"), "th")
    texts = _source(docs).select(*key, "text").join(wanted.select(*key), ["i", "no", "th"], "left_semi")
    return texts.select("text").mapInArrow(run, "c long, s binary").dropDuplicates(["c"])


def _links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between classes that are near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            edges = linked([np.frombuffer(s, np.uint64) for s in held.values()], least) if len(held) > 1 else []
            names = list(held)
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in edges], pa.int64()), pa.array([names[y] for _, y in edges], pa.int64())], ["a", "b"])

        now, held = None, {}
        for batch in batches:
            for key, c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key != now:
                    yield flush()
                    now, held = key, {}
                held[c] = s.as_py()
        yield flush()

    dealt = members.join(sets, "c").select("key", "c", "s").repartition(base.partitions(members.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, size: int = SHINGLE, least: float = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id, th, c, component): of each class of texts one row, that with the least id (null last), then hash of the text."""
    rows = base.written(_rows(docs, size), "near-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th", "fp", "keys")).alias("r")
    firsts = base.written(rows.groupBy("c").agg(first).select("r.doc_id", "r.th", "c", "r.fp", "r.keys"), "near-firsts")
    base.drop(rows)
    classes = base.written(_met_in_trie(firsts), "near-classes")
    base.drop(firsts)
    members = base.written(_members(classes, hot), "near-members")
    sets = base.written(_sets(docs, classes.join(members.select("c").distinct(), "c", "left_semi"), size), "near-sets")
    found = components(_links(members, sets, least), "near-links")
    base.drop(members, sets)
    return classes.join(found, classes.c == found.node, "left").select("doc_id", "th", "c", F.coalesce("component", "c").alias("component"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the one with the least id (null last), then hash of the text.

    Documents of different text that share an id both stay if they are no near copies; rows with equal id and text stay once.
    """
    key = base.fresh(docs.columns, "_t_no", "_t_id", "_t_th")
    no, own, th = key
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias(no), F.coalesce("doc_id", F.lit(0)).alias(own), F.col("th").alias(th))).alias("k")
    keepers = near_copies(docs).groupBy("component").agg(keeper).select("k.*")
    doc_id = F.col("doc_id").cast("long")
    named = docs.select("*", doc_id.isNull().alias(no), F.coalesce(doc_id, F.lit(0)).alias(own), F.xxhash64(F.col("text").cast("string")).alias(th))
    return named.join(keepers, key, "left_semi").dropDuplicates(key).select(*docs.columns)
