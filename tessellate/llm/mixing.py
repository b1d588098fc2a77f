"""Mixing sources to target weights.

The words of each source, its documents in a pseudorandom order, are packed into blocks of block_words, the last of which may
be partial. A source's target is reached by slots: slot t is place t mod n of epoch t div n, where n is the source's number of
blocks; a keyed permutation for that source and epoch (a Feistel network with cycle walking) maps places to full blocks, and
the partial block is the last place. The last slot is cut so that the words taken are the target, rounded. So no block is taken
twice in one epoch, nor more than `most` times in all. Every output shard draws its number of slots from each source
(multinomial, seeded by the shard); the draws are then levelled so that their totals are the sources' slots. A source's slots
are dealt to the shards in order, so the draw decides which shard holds which slot. Slots and documents meet by block number.

packed gives the output itself: a row for each slot of each shard with the block's words. mixed gives the mix as documents, and
taken counts how often each document's words are taken; these two don't depend on the draw, as it only deals slots to shards.

Null and empty texts have size 0 and are never taken; a null source is a source (the last). Repeated rows and ids are separate
rows. An empty table gives an empty mix. Columns besides doc_id, text, source and n_chars are kept by mixed, whatever their
names, and not read by the others. A text of any length is a step of its own. The driver holds one row for each source and
shards x sources counts. The result depends on the rows, parameters and seed alone, not on partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import base

BLOCK_WORDS = 256
SHARDS = 64
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 17
#: Documents of a source that are numbered together, about.
ORDERED = 1 << 16


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Share the sum of sizes by weight; none gets over most times its size, the excess is shared again."""
    share = [weights[i % len(weights)] for i in range(len(sizes))]
    capped: dict[int, float] = {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        left = sum(sizes) - sum(capped.values())
        weight = sum(share[i] for i in open_)
        over = [i for i in open_ if left * share[i] / weight > most * sizes[i]]
        if not over:
            return [capped[i] if i in capped else left * share[i] / weight for i in range(len(sizes))]
        capped |= {i: float(most * sizes[i]) for i in over}


def draw(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts by shard and source: multinomial draws, levelled so that each source's total is as given."""
    total = int(slots.sum())
    out = np.zeros((shards, len(slots)), np.int64)
    if not total:
        return out
    room = np.full(shards, total // shards)
    room[: total % shards] += 1
    for k in range(shards):
        out[k] = np.random.default_rng([seed, k]).multinomial(room[k], slots / total)
    while (excess := out.sum(0) - slots).any():
        a, b = int(excess.argmax()), int(excess.argmin())
        need = int(min(excess[a], -excess[b]))
        for k in range(shards):
            move = min(int(out[k, a]), -(-need // (shards - k)))
            out[k, a] -= move
            out[k, b] += move
            need -= move
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1, at the given places."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = base.mix64(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (base.mix64(right + k) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _slots_of(size: int, target: float, most: int, block_words: int) -> dict:
    """How a source reaches its target: full blocks, all blocks, slots, and words of the last slot if it is cut (else 0)."""
    words = min(round(target), most * size)
    blocks = -(-size // block_words)
    epochs, rest = divmod(words, size) if size else (0, 0)
    more = -(-rest // block_words)
    return {"full": size // block_words, "blocks": blocks, "slots": epochs * blocks + more, "cut": rest - (more - 1) * block_words if more else 0}


def _plan(docs: DataFrame, weights, most: int, block_words: int, seed: int) -> tuple[DataFrame, list[dict]]:
    """Documents with their place in their source, and one entry for each source in order."""
    spark = docs.sparkSession
    r, q = base.key_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), r.alias("r"), q.alias("q"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(base.WORD)), F.lit(0)).cast("long").alias("size"))
    rows = base.written(rows, "mix-sizes")
    found = sorted(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect(), key=lambda x: (x.source is None, (x.source or "").encode()))
    sources = [{"source": x.source, "s": i, "source_size": x["size"], "target": t, **_slots_of(x["size"], t, most, block_words)} for i, (x, t) in enumerate(zip(found, targets([x["size"] for x in found], weights, most)))]
    buckets = max(64, 1 << (sum(x.docs for x in found) // ORDERED).bit_length())
    known = spark.createDataFrame([(x["source"], x["s"], x["source_size"], float(x["target"])) for x in sources], "source string, s int, source_size long, target double")
    rows = rows.join(known, rows.source.eqNullSafe(known.source)).select("doc_id", "r", "q", "size", "s", "source_size", "target", F.pmod(F.xxhash64("r", F.lit(seed)), F.lit(buckets)).cast("int").alias("bucket"))
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("z"))
    before = sums.select("s", "bucket", (F.sum("z").over(Window.partitionBy("s").orderBy("bucket")) - F.col("z")).alias("before"))
    within = F.sum("size").over(Window.partitionBy("s", "bucket").orderBy("r", "q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("within", within).join(before, ["s", "bucket"]).withColumn("start", F.col("before") + F.col("within"))
    return placed.select("doc_id", "r", "q", "size", "s", "source_size", "target", "start"), sources


def slots(spark: SparkSession, sources: list[dict], shards: int = SHARDS, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(shard, s, slot, epoch, block, words): which block of which source fills each slot of each shard, and how many words of it."""
    counts = draw(np.array([x["slots"] for x in sources], np.int64), shards, seed) if sources else np.zeros((0, 0), np.int64)
    starts = np.cumsum(counts, 0) - counts
    chunk = 1 << 16
    spans = [(k, s, int(starts[k, s]), int(counts[k, s])) for k, s in np.argwhere(counts).tolist()]
    plans = [(x["full"], x["blocks"], x["slots"], x["cut"], x["source_size"]) for x in sources]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, s, start, n in zip(*(c.to_pylist() for c in batch.columns)):
                full, blocks, total, cut, size = plans[s]
                t = np.arange(start, start + n, dtype=np.int64)
                epoch, block = t // blocks, t % blocks
                for e in np.unique(epoch).tolist():
                    own = (epoch == e) & (block < full)
                    block[own] = permuted(block[own], full, (seed << 40) + (s << 8) + e)
                words = np.where(block < full, block_words, size - full * block_words)
                if cut:
                    words[t == total - 1] = cut
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, s, np.int32)), pa.array(t), pa.array(epoch.astype(np.int32)), pa.array(block), pa.array(words.astype(np.int32))], ["shard", "s", "slot", "epoch", "block", "words"])

    table = spark.createDataFrame(spans, T.StructType([T.StructField(c, t()) for c, t in (("shard", T.IntegerType), ("s", T.IntegerType), ("start", T.LongType), ("n", T.LongType))]))
    table = table.withColumn("c", F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})")))
    table = table.select("shard", "s", (F.col("start") + F.col("c") * chunk).alias("start"), F.least(F.lit(chunk).cast("long"), F.col("n") - F.col("c") * chunk).alias("n"))
    return table.repartition(base.partitions(spark)).mapInArrow(fill, "shard int, s int, slot long, epoch int, block long, words int")


def _blocks(placed: DataFrame, block_words: int) -> DataFrame:
    return placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))


def _overlap(block_words: int, words: str) -> str:
    """How many of the first `words` words of the block are the document's."""
    return f"greatest(0L, least(start + size, block * {block_words} + {words}) - greatest(start, block * {block_words}))"


def taken(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words, repeats counted)."""
    placed, sources = _plan(docs, weights, most, block_words, seed)
    # a block's slots are whole but for one at most, which holds fewer words
    chosen = slots(docs.sparkSession, sources, shards, seed, block_words).groupBy("s", "block", "words").agg(F.count("*").alias("n"))
    times = chosen.groupBy("s", "block").agg(F.collect_list(F.struct("words", "n")).alias("uses"))  # two entries at most
    key = ["doc_id", "r", "q", "size", "s", "source_size", "target", "start"]
    got = _blocks(placed, block_words).join(times.hint("merge"), ["s", "block"], "left")  # grows with the input: never broadcast
    used = f"aggregate(uses, 0L, (sum, use) -> sum + use.n * {_overlap(block_words, 'use.words')})"
    got = got.withColumn("w", F.expr(used)).groupBy(*key).agg(F.coalesce(F.sum("w"), F.lit(0).cast("long")).alias("taken"))
    empty = placed.filter("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
    return got.unionByName(empty).select("doc_id", "size", "source_size", "target", "taken")


def _spans(docs: DataFrame, fields: list[str], weights, most: int, block_words: int, shards: int, seed: int) -> tuple[DataFrame, list[str], list[dict]]:
    """Rows of docs that give words, the names of docs, and last an array of (first, n, and fields of the slot) of what they give."""
    placed, sources = _plan(docs, weights, most, block_words, seed)
    chosen = slots(docs.sparkSession, sources, shards, seed, block_words).select("s", "block", "words", *fields)
    parts = _blocks(placed, block_words).join(chosen.hint("merge"), ["s", "block"]).withColumn("n", F.expr(_overlap(block_words, "words"))).filter("n > 0")
    span = F.struct(F.expr(f"cast(greatest(start, block * {block_words}) - start as int)").alias("first"), F.col("n").cast("int").alias("n"), *([*fields, "s", "block", "start"] if "slot" in fields else fields))
    # rows that are equal, id included, have equal keys: the k-th of them gets the spans of the k-th start
    spans = parts.groupBy("r", "q", "start").agg(F.collect_list(span).alias("spans"))
    names = docs.columns
    r, q, k, x, got = base.fresh(names, "r", "q", "k", "x", "spans")
    spans = spans.groupBy("r", "q").agg(F.sort_array(F.collect_list(F.struct("start", "spans"))).alias("all"))
    spans = spans.select(F.col("r").alias(r), F.col("q").alias(q), F.posexplode("all").alias(k, x)).select(r, q, k, F.col(f"{x}.spans").alias(got))
    keyed = docs.select("*", *(h.alias(c) for h, c in zip(base.key_of(docs), (r, q))))
    keyed = keyed.withColumn(k, F.row_number().over(Window.partitionBy(r, q).orderBy(r)) - 1)
    return keyed.join(spans.hint("shuffle_hash"), [r, q, k]).select(*[F.col(f"`{c}`") for c in names], got), names, sources


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: one row for each document and epoch that takes words of it, with the words it takes as text.

    Columns are those of docs; text is cut to the blocks taken and n_chars, if there, counted anew.
    """
    joined, names, _ = _spans(docs, ["epoch"], weights, most, block_words, shards, seed)
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            rows, out = [], []
            for i, (t, spans) in enumerate(zip(part.column(text).to_pylist(), part.column(len(names)).to_pylist())):
                for piece in cut_text(t, spans):
                    rows.append(i)
                    out.append(piece)
            got = part.select(list(range(len(names)))).take(pa.array(rows, pa.int64()))
            columns = list(got.columns)
            columns[text] = pa.array(out, got.schema.field("text").type)
            if chars >= 0:
                columns[chars] = pa.array([len(x) for x in out], pa.int64()).cast(got.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, schema)


def packed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The output shards: (shard, source, slot, epoch, block, n_words, doc_ids, text), one row for each slot.

    text has the block's words, documents in their order in the block, parted by a blank line; doc_ids are theirs.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    joined, names, _ = _spans(own, ["shard", "slot", "epoch"], weights, most, block_words, shards, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            rows, out = [], []
            for i, (t, spans) in enumerate(zip(part.column(1).to_pylist(), part.column(3).to_pylist())):
                words = [(m.start(), m.end()) for m in re.finditer(base.WORD, t)]
                for x in spans:
                    rows.append(i)
                    out.append(x | {"text": t[words[x["first"]][0] : words[x["first"] + x["n"] - 1][1]]})
            got = part.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [got.column(0), got.column(2), *(pa.array([x[c] for x in out], t) for c, t in (("shard", pa.int32()), ("s", pa.int32()), ("slot", pa.int64()), ("epoch", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("text", pa.string())))],
                ["doc_id", "source", "shard", "s", "slot", "epoch", "block", "start", "n", "text"],
            )

    pieces = joined.mapInArrow(run, "doc_id long, source string, shard int, s int, slot long, epoch int, block long, start long, n int, text string")
    # a slot has block_words pieces at most
    whole = pieces.groupBy("shard", "s", "slot", "epoch", "block").agg(F.first("source").alias("source"), F.sum("n").alias("n_words"), F.sort_array(F.collect_list(F.struct("start", "doc_id", "text"))).alias("p"))
    return whole.select("shard", "source", "slot", "epoch", "block", "n_words", F.transform("p", lambda p: p["doc_id"]).alias("doc_ids"), F.array_join(F.transform("p", lambda p: p["text"]), "\n\n").alias("text"))


def cut_text(text: str, spans: list[dict]) -> list[str]:
    """For each epoch the words of its spans, neighbouring spans together, as they stand in the text."""
    words = [(m.start(), m.end()) for m in re.finditer(base.WORD, text)]
    out = []
    for epoch in sorted({x["epoch"] for x in spans}):
        pieces, last = [], -1
        for x in sorted((x for x in spans if x["epoch"] == epoch), key=lambda x: x["first"]):
            if x["first"] == last:
                pieces[-1][1] = x["first"] + x["n"]
            else:
                pieces.append([x["first"], x["first"] + x["n"]])
            last = x["first"] + x["n"]
        out.append("\n".join(text[words[a][0] : words[b - 1][1]] for a, b in pieces))
    return out


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(base.documents(spark, sf_dir))
