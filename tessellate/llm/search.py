"""Ranked lexical search over a clustered index, exact.

Order. Recursive graph bisection: a set of documents is halved so that the terms' logarithmic gaps in either half are short,
by swaps of the documents that gain most, and so on in each half. It is fitted on a sample of documents (at most SAMPLE rows,
terms hashed to FEATURES), and what it leaves at each node is a weight for each feature; every document, of the sample or not,
goes down the same bisections to its leaf. Leaves are dealt in parts of about PART_BYTES of text, so a leaf that holds a third
of all rows is many parts. Documents get new numbers: leaf, part, place.

Index. A block is a run of consecutive documents of a part, BLOCK_BYTES of text at most (or one longer text). One row holds
its ids, lengths, and for each term two hashes, the documents that hold it, how often, and the most that any of them scores.

Search. The bound of a block for a query is the sum of its terms' most, so no document of it scores more. Each query visits the
blocks of the highest bound first, and the next ones while their bound reaches its last score among the best; no other block
can hold a better document, nor an equal one with a smaller doc_id. Visits go in rounds of eight times as many blocks. Within a
block new numbers are mapped back to doc_id before ties are cut. Queries are answered in batches of at most BATCH_TERMS terms
(or one query): only a batch's terms travel to the tasks.

Terms are runs of ASCII letters, digits and anything beyond ASCII; only A-Z are lowered. They are known by two 64-bit hashes.
Null and empty texts have no terms, count for nothing and are never found; queries without a term, or with none that a document
holds, have no rows. Each row is a document: repeated rows are ranked each, ties go by doc_id, null ids last. Rows of one
query id are one query. No other column is read. docs is read four times and must give the same rows in the same order (a table
does). A block takes some 60 bytes for each of its bytes of text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

SAMPLE = 4096
FEATURES = 1 << 14
DEPTH = 5
SWAPS = 12
PART_BYTES = 1 << 20
BLOCK_BYTES = 2 << 20
#: What a document counts for beside its bytes where parts are dealt.
ROW_BYTES = 1000
BATCH_TERMS = 50_000
#: Blocks that a query visits first, times as many in each later round.
FIRST, TIMES = 8, 8
#: Visits (query, block) that are broadcast; more meet their blocks by a shuffle.
BROADCAST_ROWS = 500_000

#: Bytes of terms, lowered; 0 parts terms.
LOWER = np.zeros(256, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    LOWER[_c] = _c
LOWER[65:91] = LOWER[97:123]
LONG = 64
_WEIGHTS = base.mix64(np.arange(1, 2 * LONG + 1, dtype=np.uint64)).reshape(2, LONG) | np.uint64(1)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all terms in order: number of the text and two hashes; and the offsets of the texts."""
    data, at = base.utf8(column)
    low = LOWER[data]
    inside = low != 0
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    edge[firsts] = inside[firsts]
    starts, places = np.flatnonzero(edge), np.flatnonzero(inside)
    owner = np.searchsorted(at, starts, "right") - 1
    if not len(starts):
        return owner, np.zeros(0, np.uint64), np.zeros(0, np.uint64), at
    number = np.cumsum(edge)[places] - 1
    offset = places - starts[number]
    heads = np.flatnonzero(offset == 0)
    lengths = np.diff(np.append(heads, len(places)))
    values, offset = low[places].astype(np.uint64), np.minimum(offset, LONG - 1)
    a, b = (base.mix64(np.add.reduceat(values * w[offset], heads) + lengths.astype(np.uint64)) for w in _WEIGHTS)
    for i in np.flatnonzero(lengths > LONG):
        word = low[starts[i] : starts[i] + lengths[i]].tobytes()
        a[i], b[i] = xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(word, 2)
    return owner, a, b, at


def features(owner: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of each text: number of the text, feature."""
    key = np.unique(owner * FEATURES + (a >> np.uint64(64 - 14)).astype(np.int64))
    return key // FEATURES, key % FEATURES


def _gaps(n1: int, n2: int, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Cost of the gaps of terms with d1 and d2 documents in halves of n1 and n2."""
    return d1 * np.log2(n1 / (d1 + 1.0)) + d2 * np.log2(n2 / (d2 + 1.0))


def bisected(owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """Weights of features: documents of a positive sum belong to the second half."""
    second = np.arange(n) >= n // 2
    n1, n2 = n // 2, n - n // 2
    for _ in range(SWAPS):
        d2 = np.bincount(feature, second[owner], FEATURES)
        d1 = np.bincount(feature, minlength=FEATURES) - d2
        now = _gaps(n1, n2, d1, d2)
        out, back = now - _gaps(n1, n2, np.maximum(d1 - 1, 0), d2 + 1), now - _gaps(n1, n2, d1 + 1, np.maximum(d2 - 1, 0))
        gain = np.bincount(owner, np.where(second[owner], back[feature], out[feature]), n)
        left, right = (x[np.argsort(-gain[x], kind="stable")] for x in (np.flatnonzero(~second), np.flatnonzero(second)))
        pairs = min(len(left), len(right))
        swap = gain[left[:pairs]] + gain[right[:pairs]] > 1e-9
        if not swap.any():
            break
        second[left[:pairs][swap]], second[right[:pairs][swap]] = True, False
    d2 = np.bincount(feature, second[owner], FEATURES)
    d1 = np.bincount(feature, minlength=FEATURES) - d2
    return (_gaps(n1, n2, d1 + 1, d2) - _gaps(n1, n2, d1, d2 + 1)).astype(np.float32)


def fitted(owner: np.ndarray, feature: np.ndarray, n: int, depth: int = DEPTH) -> dict:
    """Weights and limits of the nodes of a tree of bisections; the children of node i are 2 * i + 1 and 2 * i + 2."""
    nodes = (1 << depth) - 1
    model = {"weights": np.zeros((nodes, FEATURES), np.float32), "limits": np.zeros(nodes, np.float32), "depth": depth}
    node = np.zeros(n, np.int64)
    for i in range(nodes):
        own = np.flatnonzero(node == i)
        if len(own) >= 2:
            number = np.full(n, -1)
            number[own] = np.arange(len(own))
            mine = number[owner] >= 0
            o, f = number[owner[mine]], feature[mine]
            model["weights"][i] = bisected(o, f, len(own))
            score = np.bincount(o, model["weights"][i][f], len(own))
            model["limits"][i] = np.median(score)
            node[own] = 2 * i + 1 + (score > model["limits"][i])
        else:
            node[own] = 2 * i + 1
    return model


def leaves(model: dict, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    node = np.zeros(n, np.int64)
    for _ in range(model["depth"]):
        score = np.bincount(owner, model["weights"][node[owner], feature], n)
        node = 2 * node + 1 + (score > model["limits"][node])
    return node - ((1 << model["depth"]) - 1)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def totals(docs: DataFrame) -> tuple[int, int, int, int]:
    """Documents with a term, terms of all, rows, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(4, np.int64)
        for part in base.steps(batches):
            owner, _, _, at = terms(part.column(1))
            out += (len(np.unique(owner)), len(owner), part.num_rows, at[-1])
        yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 1]) for i in range(4)], list("nlrb"))

    row = _source(docs).mapInArrow(run, "n long, l long, r long, b long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "nlrb")).first()
    return tuple(row)


def ordering(docs: DataFrame, rows: int, size: int, sample: int = SAMPLE, depth: int = DEPTH, part_bytes: int = PART_BYTES) -> dict:
    """The bisections, and in how many parts each leaf is dealt; rows and size: rows and bytes of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            owner, a, _, at = terms(part.column(1))
            owner, feature = features(owner, a)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(at)), lists], ["bytes", "f"])

    drawn = _source(docs).filter(F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(13)), 1) / F.lit(2.0**63) < min(1.0, 1.2 * sample / max(rows, 1)))
    found = drawn.mapInArrow(run, "bytes long, f array<int>").limit(sample).toArrow()  # at most `sample` rows of FEATURES numbers
    n, lists = found.num_rows, found.column("f").combine_chunks()
    owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())) if n else np.zeros(0, np.int64)
    feature = lists.flatten().to_numpy().astype(np.int64)
    model = fitted(owner, feature, n, depth)
    weight = np.bincount(leaves(model, owner, feature, n), found.column("bytes").to_numpy() + ROW_BYTES, 1 << depth) if n else np.ones(1 << depth)
    share = weight / max(weight.sum(), 1)
    return model | {"parts": np.maximum(1, np.ceil(share * (size + ROW_BYTES * rows) / part_bytes)).astype(np.int64)}


INDEX = "leaf int, block long, docs int, ids binary, known binary, m binary, a binary, b binary, df binary, most binary, at binary, tf binary"


def block_of(ids: pa.Array, column: pa.Array, n_all: int, l_all: int) -> list:
    """The columns of INDEX from docs on, for the documents of a block."""
    n = len(column)
    owner, a, b, _ = terms(column)
    m = 10 + (90 * np.bincount(owner, minlength=n).astype(np.int64) * n_all) // max(l_all, 1)
    order = np.lexsort((b, a))
    owner, a, b = owner[order], a[order], b[order]
    new_term = np.ones(len(a), bool)
    new_term[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new = new_term.copy()
    new[1:] |= owner[1:] != owner[:-1]
    posts = np.flatnonzero(new)
    tf = np.diff(np.append(posts, len(a)))
    at = owner[posts]
    heads = np.flatnonzero(new_term[posts])
    most = np.maximum.reduceat(impact(tf, m[at]), heads) if len(heads) else np.zeros(0, np.int64)
    df = np.diff(np.append(heads, len(posts)))
    firsts = np.flatnonzero(new_term)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    arrays = [ids.fill_null(0).to_numpy(), known, m, a[firsts], b[firsts], df.astype(np.int32), most.astype(np.int32), at.astype(np.int32), tf.astype(np.int32)]
    return [n, *(x.tobytes() for x in arrays)]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def index(docs: DataFrame, sample: int = SAMPLE, depth: int = DEPTH, part_bytes: int = PART_BYTES, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The blocks of docs (doc_id, text) as a table in the shared folder, by leaf; and N."""
    spark = docs.sparkSession
    n_all, l_all, rows, size = totals(docs)
    model = ordering(docs, rows, size, sample, depth, part_bytes)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for part in base.steps(batches):
            owner, a, _, _ = terms(part.column(1))
            leaf = leaves(model, *features(owner, a), part.num_rows)
            at = (task << 40) + seen + np.arange(part.num_rows)
            seen += part.num_rows
            dealt = (base.mix64(at.astype(np.uint64)) >> np.uint64(1)).astype(np.int64) % model["parts"][leaf]
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(dealt), pa.array(at), *part.columns], ["leaf", "part", "at", "doc_id", "text"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number = None, 0
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held)
                row = [now[0], (now[0] << 52) + (now[1] << 20) + number, *block_of(table.column("doc_id").combine_chunks(), table.column("text").combine_chunks(), n_all, l_all)]
                kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 9]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [f.split(" ")[0] for f in INDEX.split(", ")])
                held.clear()

        size = 0
        for batch in batches:
            leaf, dealt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(leaf) != 0) | (np.diff(dealt) != 0)) + 1), len(leaf)]
            for s, e in zip(cuts, cuts[1:]):
                for piece in base.steps([batch.slice(s, e - s)], "text", block_bytes // 4):
                    key, more = (int(leaf[s]), int(dealt[s])), piece.column(4).nbytes
                    if key != now or size + more > block_bytes:
                        yield from flush()
                        now, number, size = key, number + 1 if key == now else 0, 0
                    held.append(piece)
                    size += more
        yield from flush()

    dealt = _source(docs).mapInArrow(routed, "leaf int, part long, at long, doc_id long, text string")
    placed = dealt.repartition(base.partitions(spark), "leaf", "part").sortWithinPartitions("leaf", "part", "at")
    path = f"{base.shared_folder(spark)}/lexical-index-{uuid.uuid4().hex}"
    # rows are large: the writer looks at its size after each
    small_steps = {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
    placed.mapInArrow(built, INDEX).write.options(**small_steps).partitionBy("leaf").parquet(path)
    blocks = spark.read.schema(INDEX).parquet(path)
    blocks.written_to = path
    return blocks, n_all


def asked(queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, a, b): the distinct terms of each query; an item without an id is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            owner, a, b, _ = terms(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["item", "a", "b"])

    rows = queries.select(F.col(key).cast("long").alias("item"), F.col(text).cast("string").alias("text")).filter("item IS NOT NULL")
    return rows.mapInArrow(run, "item long, a long, b long").distinct()


def located(a: np.ndarray, b: np.ndarray, qa: np.ndarray, qb: np.ndarray) -> np.ndarray:
    """Places of the terms (qa, qb) among a block's, -1 for those that it lacks."""
    at = np.minimum(np.searchsorted(a, qa), max(len(a) - 1, 0))
    if not len(a):
        return np.full(len(qa), -1)
    for i in np.flatnonzero((a[at] == qa) & (b[at] != qb)):  # two terms with one first hash
        while at[i] + 1 < len(a) and a[at[i] + 1] == qa[i] and b[at[i]] != qb[i]:
            at[i] += 1
    return np.where((a[at] == qa) & (b[at] == qb), at, -1)


def _terms_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["a"], np.uint64), np.frombuffer(row["b"], np.uint64)


def weights(blocks: DataFrame, qa: np.ndarray, qb: np.ndarray, n_all: int) -> np.ndarray:
    """The weight of each term, by the documents of all blocks that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(qa), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                at = located(*_terms_of(row), qa, qb)
                total[at >= 0] += np.frombuffer(row["df"], np.int32)[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["t", "df"])

    df = np.zeros(len(qa), np.int64)
    for r in blocks.select("a", "b", "df").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():  # terms of one batch
        df[r.t] = r.df
    return np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)


def answered(blocks: DataFrame, n_all: int, items: list[int], lists: list[np.ndarray], qa: np.ndarray, qb: np.ndarray, limit: int) -> DataFrame:
    """(item, score, id, known, rank) of the best `limit` documents of a batch of queries; lists: the numbers of each query's terms."""
    spark = blocks.sparkSession
    w = weights(blocks, qa, qb, n_all)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = located(*_terms_of(row), qa, qb)
                most = np.where(at >= 0, np.append(np.frombuffer(row["most"], np.int32), 0)[at], 0) * w
                bound = np.array([most[own].sum() for own in lists], np.int64)
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["leaf"], np.int32)), pa.array(np.full(len(some), row["block"])), pa.array(some.astype(np.int32)), pa.array(bound[some])], ["leaf", "block", "q", "bound"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = located(*_terms_of(row), qa, qb)
                df, post, tf = (np.frombuffer(row[c], np.int32) for c in ("df", "at", "tf"))
                ids, known, m = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["m"], np.int64)
                heads = np.cumsum(df) - df
                gains: dict[int, np.ndarray] = {}
                out = []
                for q in row["visits"]:
                    score = np.zeros(row["docs"], np.int64)
                    for t in lists[q]:
                        if at[t] >= 0:
                            own = slice(heads[at[t]], heads[at[t]] + df[at[t]])
                            if t not in gains:
                                gains[t] = w[t] * impact(tf[own], m[post[own]])
                            score[post[own]] += gains[t]  # a document is in a term's list once
                    best = np.lexsort((ids, ~known, -score))[:limit]
                    out += [(q, score[i], ids[i], known[i]) for i in best[score[best] > 0]]
                q, score, doc, there = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, pa.int64()), pa.array(there, pa.bool_())], ["q", "score", "id", "known"])

    bounds = base.written(blocks.select("leaf", "block", "a", "b", "most").mapInArrow(bounded, "leaf int, block long, q int, bound long"), "search-bounds")
    by_bound = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("known"), "id")
    state, top, k = None, None, FIRST
    while True:
        open_ = bounds
        if state is not None:  # what comes after the last visit, and can still be among the best
            open_ = bounds.join(F.broadcast(state), "q", "left").filter("(last IS NULL OR bound < last OR bound = last AND block > last_block) AND (least IS NULL OR bound >= least)").drop("last", "last_block", "least")
        visits = base.written(open_.withColumn("place", F.row_number().over(by_bound)).filter(F.col("place") <= k).drop("place"), "search-visits")
        n = visits.count()
        if n == 0 and top is not None:
            base.drop(visits, bounds)
            break
        each = visits.groupBy("leaf", "block").agg(F.collect_set("q").alias("visits"))  # queries of one batch
        met = blocks.join(F.broadcast(each) if n <= BROADCAST_ROWS else each, ["leaf", "block"])
        found = met.select("docs", "ids", "known", "m", "a", "b", "df", "at", "tf", "visits").mapInArrow(scored, "q int, score long, id long, known boolean")
        both = found if top is None else found.unionByName(top.drop("rank"))
        old, top = top, base.written(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit), "search-top")
        seen = visits.groupBy("q").agg(F.min(F.struct("bound", -F.col("block"))).alias("v")).select("q", F.col("v.bound").alias("last"), (-F.col("v.col2")).alias("last_block"))
        least = top.filter(F.col("rank") == limit).select("q", F.col("score").alias("least"))
        state_new = seen.join(least, "q", "full")
        if state is not None:  # queries that visited nothing this time are done, and stay so
            state_new = state_new.unionByName(state.join(seen, "q", "left_anti")).groupBy("q").agg(F.min("last").alias("last"), F.max("last_block").alias("last_block"), F.max("least").alias("least"))
        before, state = state, base.written(state_new, "search-state")  # a row for each query of a batch
        base.drop(*(x for x in (old, before, visits) if x is not None))
        k *= TIMES
    names = spark.createDataFrame([(i, item) for i, item in enumerate(items)], "q int, item long")
    return top.join(F.broadcast(names), "q").select("item", "score", F.when(F.col("known"), F.col("id")).alias("doc_id"), "rank")


def search(docs: DataFrame, queries: DataFrame, limit: int = 10, key: str = "item_id", text: str = "text", batch_terms: int = BATCH_TERMS, **settings) -> DataFrame:
    """(item_id, rank, doc_id, score): for each query its `limit` best documents; settings go to index()."""
    spark = docs.sparkSession
    blocks, n_all = index(docs, **settings)
    wanted = base.written(asked(queries, key, text), "search-asked")
    sizes = wanted.groupBy("item").agg(F.count("*").alias("n"))
    # batches by the running number of terms, first within slices of queries, so that no window holds all of them
    slices = max(1, math.ceil(wanted.count() / batch_terms))
    running = F.sum("n").over(Window.partitionBy("s").orderBy("item"))
    dealt = sizes.withColumn("s", F.pmod(F.xxhash64("item"), F.lit(slices))).withColumn("part", F.floor((running - 1) / batch_terms))
    batches = base.written(wanted.join(dealt.select("item", "s", "part"), "item"), "search-batches")
    out = None
    for s, part in sorted(map(tuple, batches.select("s", "part").distinct().collect())):
        got = batches.filter((F.col("s") == s) & (F.col("part") == part)).select("item", "a", "b").toArrow()  # at most batch_terms rows, or twice as many, or one query
        pairs = np.unique(np.stack([got.column(c).to_numpy().view(np.uint64) for c in "ab"], 1), axis=0, return_inverse=True)
        items, own = np.unique(got.column("item").to_numpy(), return_inverse=True)
        number = pairs[1].ravel()
        lists = [number[own == i] for i in range(len(items))]
        found = answered(blocks, n_all, items.tolist(), lists, pairs[0][:, 0].copy(), pairs[0][:, 1].copy(), limit)
        out = found if out is None else out.unionByName(found)
    base.drop(blocks, wanted, batches)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_clustered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(base.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
SQL = f"""WITH d AS (SELECT doc_id, {_SPLIT} AS t FROM documents), c AS (SELECT count(*) AS n_all, CAST(sum(len(t)) AS BIGINT) AS l_all FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark), a AS (SELECT DISTINCT term FROM q),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) JOIN a USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n_all),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
