"""Exact substring dedup: bytes under any string of a given length (LENGTH bytes) that starts at two places or more.

Anchors. In each window of LENGTH bytes the least-hashed 8-byte gram among its first SPAN starts (leftmost of equals) is
the window's anchor. It depends on the window's content alone, so equal windows have equal anchors at equal offsets, and
all windows of an anchor hold the LENGTH - SPAN + 1 bytes after it (its core). An anchor's context is the union of its
windows. Anchors are about 50 bytes apart.

Steps, all counts with map-side combining:
1. anchors whose core hash occurs twice or more stay; the others have no repeated window.
2. a context that occurs twice is covered whole. This settles copies and the inside of shared passages. Contexts are one if
   core and context hash are: 64 bits each, of two independent polynomials over bytes of both.
3. contexts that occur once, but whose core is repeated, lie at the edges of matches. Their windows, and those of one
   context of each repeated class with the same core, are sorted as suffixes in each step of a task: merge sort whose
   comparisons find the common extension by binary search over prefix polynomial hashes. Neighbours in the sorted order with
   LENGTH bytes in common are one class, verified byte by byte. One row leaves a task's step for each class and member;
   classes of different tasks meet by two independent hashes besides the core's.
4. each text is cut at the united spans.

Two lengths at once (op7's query: strings of LENGTH bytes, and passages of PASSAGE bytes, some 50 words): steps 1 to 3 take the smaller
one over all texts, then the greater one over the runs of its spans that are long enough. No string of the greater length that
occurs twice lies elsewhere, as all its parts occur twice too. Of runs that are equal one is looked at, and all are covered whole.

Null and empty texts and those under LENGTH bytes lose nothing of their own. Repeated rows are copies of each other and
lose all they hold. A row is known by 96 bits of two hashes of its id and text, so ids may be null or repeated. Other columns
are not read; cut_documents keeps them, whatever their names. An empty table gives no rows. A text of any length is a step of
its own. Matches never cross texts; the result doesn't depend on order or partitioning.

Tables of a step are deleted as soon as what reads them is written; the spans stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

LENGTH = 400
#: Passages of over 50 words: 50 words of six bytes with their space.
PASSAGE = 300
#: Starts among which an anchor is chosen; under 128 and under the length.
SPAN = 100
#: Window starts that are looked at together; a longer text is looked at in parts.
PART = 1 << 19
#: Suffixes that are sorted together. Groups (a core and a place in it) are sorted whole, in as many goes as this asks for.
SORTED = 1 << 17
#: Bytes of text in a step of the pass that looks at every window.
STEP = 1 << 19

_random = np.random.default_rng(20240607)
BYTES1, BYTES2 = (_random.integers(0, 2**64, 256, dtype=np.uint64) for _ in range(2))
ODD1, ODD2 = (int(x) * 2 + 1 for x in _random.integers(2**61, 2**62, 2))


class Prefix:
    """Polynomial hashes of all substrings of one buffer, modulo 2**64."""

    def __init__(self, data: np.ndarray, table: np.ndarray, odd: int):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * base.powers(odd, n), out=self.total[1:]) if n else None
        self.back = base.powers(pow(odd, -1, 2**64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.back[start]


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, core hash, context hash) of each anchor; places count within the buffer."""
    size = np.diff(at)
    out = []
    long = np.flatnonzero(size >= length)
    starts = at[:-1][long]
    counts = size[long] - length + 1
    begin = 0
    while begin < len(long):
        if counts[begin] > PART:  # one long text, in parts
            for p in range(0, int(counts[begin]), PART):
                n = min(PART, int(counts[begin]) - p)
                out.append(_anchors(data, long[begin : begin + 1], starts[begin : begin + 1] + p, np.array([n]), length))
            begin += 1
            continue
        end = begin + 1
        while end < len(long) and starts[end] + counts[end] - starts[begin] <= PART:
            end += 1
        out.append(_anchors(data, long[begin:end], starts[begin:end], counts[begin:end], length))
        begin = end
    if not out:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchors(data: np.ndarray, texts: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    low, high = int(starts[0]), int(starts[-1] + counts[-1]) + length - 1
    part = data[low:high]
    n = len(part)
    gram = np.zeros(n, np.uint64)
    for j in range(8):
        gram[: n - j] |= part[j:].astype(np.uint64) << np.uint64(8 * j)
    value = base.mix64(gram)
    value &= np.uint64(0xFFFFFFFFFF000000)
    value |= np.arange(n, dtype=np.uint64)
    blocks = -(-n // SPAN) + 1
    padded = np.full(blocks * SPAN, np.uint64(2**64 - 1))
    padded[:n] = value
    padded = padded.reshape(blocks, SPAN)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    where = base.concat_ranges(starts - low, counts)
    anchor = (np.minimum(behind[where], ahead[where + SPAN - 1]) & np.uint64(0xFFFFFF)).astype(np.int64)
    owner = np.repeat(texts, counts)
    new = np.ones(len(where), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(where)) - 1
    first, last, anchor, owner = where[begins], where[ends], anchor[begins], owner[begins]
    core = base.mix64(Prefix(part, BYTES1, ODD1).of(anchor, anchor + length - SPAN + 1))
    context = base.mix64(Prefix(part, BYTES2, ODD2).of(first, last + length) + (last - first).astype(np.uint64))
    return owner, anchor + low, first + low, last + low, core, context


def common_extension(prefix: Prefix, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes, up to most, the suffixes at a and b have in common: binary search over prefix hashes."""
    low = np.where(prefix.of(a, a + most) == prefix.of(b, b + most), most, 0)
    high = np.where(low == most, most, most - 1)
    while (open_ := low < high).any():
        rows = np.flatnonzero(open_)
        mid = (low[rows] + high[rows] + 1) >> 1
        same = prefix.of(a[rows], a[rows] + mid) == prefix.of(b[rows], b[rows] + mid)
        low[rows] = np.where(same, mid, low[rows])
        high[rows] = np.where(same, high[rows], mid - 1)
    return low


def sort_suffixes(data: np.ndarray, prefix: Prefix, suffixes: np.ndarray, bounds: np.ndarray, most: int) -> np.ndarray:
    """The suffixes between each two bounds in the order of their first most bytes, by bottom-up merge sort.

    All runs of all groups merge at once: each suffix finds its rank in the neighbouring run by binary search, and each
    comparison finds the common extension of two suffixes from prefix hashes, then looks at the next byte.
    """
    order = suffixes.copy()
    size = np.diff(bounds)
    run = 1
    while run < (size.max() if len(size) else 0):
        groups = np.flatnonzero(size > run)
        slots = base.concat_ranges(bounds[:-1][groups], size[groups])
        inner = slots - np.repeat(bounds[:-1][groups], size[groups])
        origin = slots - inner
        stop = origin + np.repeat(size[groups], size[groups])
        pair = origin + inner // (2 * run) * (2 * run)
        right = inner // run % 2 == 1
        middle = np.minimum(pair + run, stop)
        low = np.where(right, pair, middle)
        high = np.where(right, middle, np.minimum(pair + 2 * run, stop))
        first_other = low.copy()
        own = order[slots]
        while (open_ := low < high).any():
            rows = np.flatnonzero(open_)
            mid = (low[rows] + high[rows]) >> 1
            x, y = order[mid], own[rows]
            same = common_extension(prefix, x, y, most)
            at = np.minimum(same, most - 1)
            before = np.where(same == most, right[rows], data[x + at] < data[y + at])  # of equals, the left run goes first
            low[rows] = np.where(before, mid + 1, low[rows])
            high[rows] = np.where(before, high[rows], mid)
        mine = slots - np.where(right, middle, pair)
        merged = order.copy()
        merged[pair + mine + (low - first_other)] = own
        order = merged
        run *= 2
    return order


def window_classes(data: np.ndarray, starts: np.ndarray, core: np.ndarray, offset: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal windows of one buffer: (index into starts in sorted order, class's first hash, second hash)."""
    by = np.lexsort((starts, offset, core))
    core, offset, starts = core[by], offset[by], starts[by]
    new = np.ones(len(by), bool)
    new[1:] = (core[1:] != core[:-1]) | (offset[1:] != offset[:-1])
    heads = np.append(np.flatnonzero(new), len(by))
    one, two = Prefix(data, BYTES1, ODD1), Prefix(data, BYTES2, ODD2)
    number = np.zeros(len(data) + 1, np.int32)
    number[starts] = by  # a start has one anchor, so one number
    order = np.empty(len(by), np.int64)
    same = np.zeros(len(by), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    begin = 0
    while begin < len(heads) - 1:
        end = max(begin + 1, int(np.searchsorted(heads, heads[begin] + SORTED, "right")) - 1)
        low, high = heads[begin], heads[end]
        part = sort_suffixes(data, one, starts[low:high], heads[begin : end + 1] - low, length)
        rows = np.flatnonzero(~new[low:high])
        rows = rows[common_extension(one, part[rows - 1], part[rows], length) == length]
        for i in range(0, len(rows), 8192):  # verification against collisions of the hash
            r = rows[i : i + 8192]
            same[low + r] = (view[part[r - 1]] == view[part[r]]).all(1)
        order[low:high] = part
        begin = end
    heads = np.flatnonzero(~same)
    spread = np.repeat(heads, np.diff(np.append(heads, len(order))))
    lead = order[spread]
    salt = base.mix64(core + offset.astype(np.uint64))
    return number[order], base.mix64(one.of(lead, lead + length) ^ salt), base.mix64(two.of(lead, lead + length) + salt)


MARKS = "array<struct<at:long,core:long,whole:boolean,windows:boolean>>"
#: Bits of a mark below its anchor's place.
PLACE = 14


def _pack(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Anchor and how far before it its first and last windows start, in one long."""
    return (anchor << PLACE) | ((anchor - first) << 7) | (anchor - last)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    anchor = at >> PLACE
    return anchor, anchor - (at >> 7 & 127), anchor - (at & 127)


def _fields(marks: pa.Array) -> tuple[np.ndarray, ...]:
    """(row of each element, at, core, whole, windows)."""
    if isinstance(marks, pa.ChunkedArray):
        marks = marks.combine_chunks()
    lengths = marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = marks.flatten()
    return np.repeat(np.arange(len(marks)), lengths), *(flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(rows with their key r, q; (r, q, marks, starts)): contexts covered whole, and starts of other repeated windows."""
    r, q = base.key_of(docs)
    rows = docs.select(r.alias("r"), q.alias("q"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows, _spans(rows.select("r", "q", "text"), length)


def _spans(rows: DataFrame, length: int, sift: bool = True) -> DataFrame:
    """(r, q, marks, starts) of rows (r, q, text). sift: step 1, which changes no result and spares little where most cores are repeated."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            data, at = base.utf8(part.column(2))
            owner, anchor, first, last, core, context = anchors(data, at, length)
            start = at[:-1][owner]
            own = part.select([0, 1]).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(_pack(anchor - start, first - start, last - start)), pa.array(core.view(np.int64)), pa.array(context.view(np.int64))], ["r", "q", "at", "core", "context"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches, limit=STEP):
            data, at = base.utf8(part.column(2))
            row, packed, core, whole, ask = _fields(part.column(3))
            ask = ask.astype(bool)
            row, packed, core, whole = row[ask], packed[ask], core[ask], whole[ask].astype(bool)
            if not len(row):
                continue
            anchor, first, last = _unpack(packed)
            count = last - first + 1
            inner = base.concat_ranges(first, count)
            owner = np.repeat(row, count)
            of, one, two = window_classes(data, inner + at[:-1][owner], np.repeat(core, count).view(np.uint64), np.repeat(anchor, count) - inner, length)
            own = part.select([0, 1]).take(pa.array(owner[of]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(inner[of].astype(np.int32)), pa.array(np.where(np.repeat(whole, count)[of], 2, 1).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["r", "q", "s", "n", "one", "two"])

    found = base.written(rows.mapInArrow(find, "r long, q int, at long, core long, context long"), "anchors")
    # counts are written before they are joined: both sides of the join are then plain exchanges, which split where skewed
    repeated = found
    if sift:
        cores = base.written(found.groupBy("core").count().filter("count > 1").select("core"), "cores")
        repeated = base.written(found.join(cores, "core").select("r", "q", "at", "core", "context"), "anchors-repeated")
        base.drop(found, cores)
    place = F.struct("r", "q", "at")
    classes = base.written(repeated.groupBy("core", "context").agg(F.count("*").alias("n"), F.min(place).alias("one")), "classes")
    kinds = base.written(classes.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "kinds")
    contexts = base.written(classes.join(kinds, "core", "left"), "contexts")
    base.drop(classes, kinds)
    single = F.col("n") == 1
    marked = repeated.join(contexts, ["core", "context"])
    marked = marked.select("r", "q", F.struct("at", "core", (~single).alias("whole"), (F.col("kinds").isNotNull() & (single | (place == F.col("one")))).alias("windows")).alias("mark")).filter("mark.whole OR mark.windows")
    marks = base.written(marked.groupBy("r", "q").agg(F.collect_set("mark").alias("marks")), "anchors-marked")  # rows that are equal have one set
    base.drop(repeated, contexts)
    asked = rows.join(marks.filter("exists(marks, m -> m.windows)").select("r", "q", F.expr("filter(marks, m -> m.windows)").alias("marks")).hint("shuffle_hash"), ["r", "q"])
    seen = base.written(asked.mapInArrow(windows, "r long, q int, s int, n int, one long, two long"), "windows")
    twice = base.written(seen.groupBy("one", "two").agg(F.sum("n").alias("m")).filter("m > 1").select("one", "two"), "windows-repeated")
    starts = seen.filter("n = 1").join(twice, ["one", "two"]).groupBy("r", "q").agg(F.collect_list("s").alias("starts"))
    spans = base.written(marks.select("r", "q", F.expr("transform(filter(marks, m -> m.whole), m -> m.at)").alias("marks")).join(starts, ["r", "q"], "full"), "spans")
    base.drop(marks, seen, twice)
    return spans


def _longer(rows: DataFrame, spans: DataFrame, passage: int, length: int) -> DataFrame:
    """(r, q, marks, starts) for a length, of rows (r, q, text) whose spans for a smaller one are known."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            data, at = base.utf8(part.column(2))
            gone = _gone(data, at, part.column(3), part.column(4), passage)
            first, end = np.flatnonzero(_edges(gone, at)), np.flatnonzero(_edges(gone[::-1], len(data) - at[::-1])[::-1]) + 1
            long = end - first >= length
            first, end = first[long], end[long]
            owner = np.searchsorted(at, first, "right") - 1
            raw = data.tobytes()
            texts = pa.array([raw[s:e] for s, e in zip(first.tolist(), end.tolist())], pa.binary()).view(pa.string())  # may begin within a character
            own = part.select([0, 1]).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(first - at[owner]), texts], ["r", "q", "b", "text"])

    some = spans.filter("coalesce(size(marks), 0) > 0 OR starts IS NOT NULL")
    found = rows.join(some.hint("shuffle_hash"), ["r", "q"]).select("r", "q", "text", "marks", "starts").mapInArrow(runs, "r long, q int, b long, text string")
    parts = base.written(found.select(F.xxhash64("text").alias("pr"), F.hash("text").alias("pq"), "*", F.octet_length("text").alias("size")), "passages")
    kinds = base.written(parts.groupBy("pr", "pq").agg(F.count("*").alias("n"), F.min(F.struct("r", "q", "b")).alias("one")), "passage-kinds")
    texts = base.written(parts.join(kinds.select("one.*").hint("shuffle_hash"), ["r", "q", "b"]).select(F.col("pr").alias("r"), F.col("pq").alias("q"), "text"), "passage-texts")
    inner = _spans(texts, length, sift=False)
    each = kinds.join(inner.select(F.col("r").alias("pr"), F.col("q").alias("pq"), "marks", "starts"), ["pr", "pq"], "left").select("pr", "pq", "n", "marks", "starts")
    placed = parts.select("pr", "pq", "r", "q", "b", "size").join(each, ["pr", "pq"])
    marks = F.expr(f"CASE WHEN n = 1 THEN transform(marks, m -> m + (b << {PLACE})) END")
    whole = f"array_append(sequence(0, size - {length}, {length}), size - {length})"
    starts = F.expr(f"transform(CASE WHEN n > 1 THEN {whole} ELSE starts END, s -> cast(s + b AS int))")
    out = base.written(placed.select("r", "q", marks.alias("marks"), starts.alias("starts")).groupBy("r", "q").agg(*(F.flatten(F.collect_set(c)).alias(c) for c in ("marks", "starts"))), "spans-longer")  # rows that are equal have the same parts
    base.drop(parts, kinds, texts, inner)
    return out


def _gone(data: np.ndarray, at: np.ndarray, marks: pa.Array, starts: pa.Array, length: int) -> np.ndarray:
    """Which bytes go, by whole contexts and starts of single windows."""
    change = np.zeros(len(data) + 1, np.int32)
    for column, shape in ((marks, _unpack), (starts, lambda s: (None, s, s))):
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        _, first, last = shape(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        start = np.repeat(at[:-1], lengths)
        np.add.at(change, start + first, 1)
        np.add.at(change, start + last + length, -1)
    return np.cumsum(change[:-1]) > 0


def _edges(gone: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which bytes begin a run of those that go; a run ends with its text."""
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    heads = at[:-1][np.diff(at) > 0]
    edge[heads] = gone[heads]
    return edge


def _kept(data: np.ndarray, at: np.ndarray, gone: np.ndarray) -> list[bytes]:
    return base.pieces(data[~gone], np.concatenate([[0], np.cumsum(base.per_text(~gone, at))]))


def cut_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the bytes under repeated strings cut out of text (what is no longer UTF-8 at a cut is left out too) and, if
    there, n_chars counted anew."""
    _, spans = repeated_spans(docs, length)
    names, schema = docs.columns, docs.schema
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    r, q, marks, starts = base.fresh(names, "r", "q", "marks", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            data, at = base.utf8(part.column(text))
            gone = _gone(data, at, part.column(len(names)), part.column(len(names) + 1), length)
            kept = [x.decode("utf-8", "ignore") for x in _kept(data, at, gone)]
            columns = list(part.columns[: len(names)])
            columns[text] = pa.array(kept, pa.string())
            if chars >= 0:
                columns[chars] = pa.array([len(x) for x in kept], pa.int64()).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    marked = spans.select(F.col("r").alias(r), F.col("q").alias(q), F.col("marks").alias(marks), F.col("starts").alias(starts))
    keyed = docs.select("*", *(h.alias(c) for h, c in zip(base.key_of(docs), (r, q))))
    placed = keyed.join(marked.hint("shuffle_hash"), [r, q], "left")
    return placed.select(*[F.col(f"`{c}`") for c in names], marks, starts).mapInArrow(run, schema)


def cut(docs: DataFrame, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """One row per row of docs: r, q, doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what is kept, without what a cut leaves
    of a character), kept (its bytes). With a passage (a smaller length) also n_in_passages (bytes under strings of that length that occur
    again) and text_without_passages."""
    rows, spans = repeated_spans(docs, passage or length)
    schema = "r long, q int, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, kept binary"
    if passage:
        longer = _longer(rows.select("r", "q", "text"), spans, passage, length)
        spans = spans.withColumnsRenamed({"marks": "passage_marks", "starts": "passage_starts"}).join(longer, ["r", "q"], "left")
        schema += ", n_in_passages long, text_without_passages string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            data, at = base.utf8(part.column(3))
            gone = _gone(data, at, part.column(4), part.column(5), length)
            kept = _kept(data, at, gone)
            columns = [*part.columns[:3], pa.array(np.diff(at)), pa.array(base.per_text(gone, at)), pa.array(base.per_text(_edges(gone, at), at)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()), pa.array(kept, pa.binary())]
            names = ["r", "q", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "kept"]
            if passage:
                gone = _gone(data, at, part.column(6), part.column(7), passage)
                columns += [pa.array(base.per_text(gone, at)), pa.array([x.decode("utf-8", "ignore") for x in _kept(data, at, gone)], pa.string())]
                names += ["n_in_passages", "text_without_passages"]
            yield pa.RecordBatch.from_arrays(columns, names)

    placed = rows.join(spans.hint("shuffle_hash"), ["r", "q"], "left")
    more = ["passage_marks", "passage_starts"] if passage else []
    return placed.select("r", "q", "doc_id", "text", "marks", "starts", *more).mapInArrow(run, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(base.documents(spark, sf_dir), passage=PASSAGE).drop("r", "q", "kept")
