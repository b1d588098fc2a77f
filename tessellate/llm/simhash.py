"""SimHash near-duplicates by a binary trie self-join.

Every document gets a 64-bit fingerprint from its word shingles. Equal fingerprints are one class. Class representatives
are dealt to 4 groups each, one for each 16-bit block of the fingerprint with that block's value: two fingerprints that
differ in 3 bits or fewer have at least one block alike. Each group has a binary trie, and each trie is joined with itself: pairs of nodes are traversed together, the bits in which their
paths differ are added up, and a pair is dropped as soon as they exceed the budget. Groups of over HOT members are cut
further, again without loss: the other 48 bits make 4 sub-blocks of 12, one of which must be alike too (and once more, 4 of
9 of the remaining 36). Links within a group are kept as a spanning forest, so what leaves a group is linear in its size.
Components are those of the classes, whether or not their rows have ids; component_id is the least id in one.

Null and empty texts have fingerprint 0 and link to each other like any other class. Repeated rows share a class; a row with a
null doc_id links like any other, and has a null component_id only where no row of its component has an id. An empty table
gives no rows. Other columns are not read. A text of any length is a step of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .components import components

SHINGLE = 3
BUDGET = 3
#: A group over this size is cut into sub-blocks.
HOT = 2_000
#: Node pairs that the self-join holds at once.
PAIRS = 1 << 20
#: A pair of nodes with as many pairs of leaves at most is settled leaf by leaf.
BUCKET = 16

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.translate(LOWER).split()
        if not words:
            counts.append(0)
            continue
        line = b" ".join(words)
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        if len(words) <= size:
            hashes.append(digest(line, 42))
            counts.append(1)
            continue
        ends = [s - 1 for s in starts[size:]]
        ends.append(len(line))
        hashes.extend([digest(line[s:e], 42) for s, e in zip(starts, ends)])
        counts.append(len(ends))
    return voted(np.array(hashes, np.uint64), np.array(counts, np.int64))


def voted(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """uint64 fingerprints of n[0], n[1], ... hashes in turn: a bit is one if it is in over half of them; 0 for none."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        first = (np.cumsum(n) - n)[full]
        for bit in range(64):
            ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), first)
            out[full] |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            fp = simhash(base.pieces(*base.utf8(part.column(1))), size)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def trie_links(values: np.ndarray, bounds: np.ndarray | None = None, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of places in values whose fingerprints differ in at most budget bits.

    values: uint64, sorted and distinct between each two bounds: one trie each, all joined with themselves side by side.
    A trie node is a range of values with a common path. Pairs of nodes go down one bit at a time, those with the same bit
    at no cost, those with different bits at a cost of one; pairs over the budget are pruned. Small pairs are settled by the
    differing bits of their leaves. Held pairs are bounded: what exceeds PAIRS waits on a stack.
    """
    bounds = np.array([0, len(values)]) if bounds is None else bounds
    roots = np.stack([bounds[:-1], bounds[1:]] * 2, 1)[np.diff(bounds) > 1]
    stack = [(0, roots, np.zeros(len(roots), np.int64))]
    while stack:
        depth, nodes, spent = stack.pop()
        if len(nodes) > PAIRS:
            half = len(nodes) // 2
            stack += [(depth, nodes[:half], spent[:half]), (depth, nodes[half:], spent[half:])]
            continue
        wide = nodes[:, 3] - nodes[:, 2]
        count = (nodes[:, 1] - nodes[:, 0]) * wide
        small = (count <= BUCKET) | (depth == 64)
        if small.any():
            k = base.concat_ranges(np.zeros(int(small.sum()), np.int64), count[small])
            of = np.repeat(np.flatnonzero(small), count[small])
            i, j = nodes[of, 0] + k // wide[of], nodes[of, 2] + k % wide[of]
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            nodes, spent = nodes[~small], spent[~small]
        if not len(nodes):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        own = nodes[:, 0] == nodes[:, 2]
        middle = [_split(values, nodes[:, c], nodes[:, c + 1], bit) for c in (0, 2)]
        left, right = (nodes[:, 0], middle[0]), (middle[0], nodes[:, 1])
        left2, right2 = (nodes[:, 2], middle[1]), (middle[1], nodes[:, 3])
        below, cost = [], []
        for a, b, extra, keep in ((left, left2, 0, None), (right, right2, 0, None), (left, right2, 1, None), (right, left2, 1, ~own)):
            some = (a[1] > a[0]) & (b[1] > b[0]) & (spent + extra <= budget)
            if keep is not None:
                some &= keep
            below.append(np.stack([a[0], a[1], b[0], b[1]], 1)[some])
            cost.append(spent[some] + extra)
        stack.append((depth + 1, np.concatenate(below), np.concatenate(cost)))


def _split(values: np.ndarray, start: np.ndarray, end: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where in each sorted range with a common path the given bit turns to one."""
    lo, hi = start.copy(), end.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (values[np.minimum(mid, len(values) - 1)] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def forest(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, root) that connect what trie_links connects: root is the least place of its component."""
    root = np.arange(len(values))
    for i, j in trie_links(values, bounds):
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (root[root] != root).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(len(values)))
    return moved, root[moved]


def _block(fp: Column, start: int, width: int) -> Column:
    """width bits of fp from bit start on, counted from the lowest."""
    return F.shiftrightunsigned(fp, start).bitwiseAND((1 << width) - 1)


def _dealt(classes: DataFrame, hot: int) -> DataFrame:
    """(fp, key): each class in all groups in which a partner of it may be."""
    keyed = classes.select("fp", F.explode(F.array(*(F.struct(F.lit(b).alias("b"), F.array(F.lit(b).cast("long"), _block(F.col("fp"), 16 * b, 16)).alias("key")) for b in range(4)))).alias("x")).select("fp", "x.b", "x.key")
    cool = None
    for depth, width in ((1, 12), (2, 9)):
        sizes = base.written(keyed.groupBy("key").count().filter(F.col("count") > hot).select("key"), "simhash-hot")
        if sizes.isEmpty():
            break
        large = keyed.join(sizes, "key", "left_semi")
        rest = keyed.join(sizes, "key", "left_anti")
        cool = rest if cool is None else cool.unionByName(rest)
        # the bits outside the blocks taken so far, lowest first, in 4 blocks of width
        parts = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), _spare(depth, width, i).alias("v")) for i in range(4)))
        keyed = large.withColumn("s", F.explode(parts)).select("fp", "b", F.concat("key", F.array("s.i", "s.v")).alias("key"))
    return (keyed if cool is None else cool.unionByName(keyed)).select("fp", F.xxhash64("key").alias("key"), F.col("b"))


def _spare(depth: int, width: int, i: int) -> Column:
    """The i-th block of width bits of what is left of fp when the blocks named in key are taken out."""
    rest = F.col("fp")
    low = F.col("b") * 16
    rest = _without(rest, low, 16)
    if depth == 2:
        rest = _without(rest, F.element_at("key", 3).cast("int") * 12, 12)
    return F.shiftrightunsigned(rest, i * width).bitwiseAND((1 << width) - 1)


def _without(value: Column, start: Column, width: int) -> Column:
    """value without the width bits from bit start on; what is above moves down."""
    start = start.cast("int")
    low = value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), start) - F.lit(1).cast("long"))
    high = F.when(start + width >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", value, start + width))
    return low.bitwiseOR(F.call_function("shiftleft", high, start))


def links(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """Forest edges (a, b) between fingerprints. classes: fp, distinct."""
    parts = base.partitions(classes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(keys, fps):
            key, fp = np.concatenate(keys), np.concatenate(fps).view(np.uint64)
            fp = fp[np.lexsort((fp, key))]  # keys come in order already
            bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            i, j = forest(fp, bounds)
            return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], ["a", "b"])

        keys: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # the last group may go on in the next batch
            cut = int(np.searchsorted(np.cumsum(k[::-1] != k[-1]), 1)) if len(k) else 0
            cut = len(k) - cut
            if cut:
                yield flush([*keys, k[:cut]], [*fps, f[:cut]])
                keys, fps = [], []
            keys.append(k[cut:])
            fps.append(f[cut:])
        if keys and sum(map(len, keys)):
            yield flush(keys, fps)

    dealt = _dealt(classes.select("fp"), hot).select("key", "fp").repartition(parts, "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id (the smallest doc_id reachable, itself included)."""
    rows = base.written(fingerprints(docs, size), "simhash")
    classes = base.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = components(links(classes.select("fp"), hot), "simhash-links")
    # written, so that both sides of the join are plain exchanges, which split where a component is large
    whole = base.written(classes.join(found, classes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "least"), "simhash-components")
    ids = base.written(whole.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-ids")
    named = whole.join(ids, "component").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """What the pipeline keeps."""
    from . import nearcopies  # it takes its candidates from here

    return nearcopies.representatives(docs)


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(base.documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
