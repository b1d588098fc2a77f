"""Line runs and tiled whitening against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.llm import lines, whitening

DOCS = "doc_id long, text string"
SPACE = " \t\n\x0b\x0c\r"


def by_hand(rows, long=lines.LONG, least=lines.LEAST):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(-1 if i is None else i)
    out = []
    for i, text in rows:
        split = (text or "").split("\n")
        gone = [len(key(x)) >= long and len(holders[key(x)]) >= least and (-1 if i is None else i) != max(holders[key(x)]) for x in split]
        out.append((i, len(split), sum(gone), "\n".join(x for x, g in zip(split, gone) if not g)))
    return sorted(out, key=repr)


def held(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    known = ["The same line, found again and again", "  the SAME line, found again and again\t", "ÀÉ ñandú line with other letters İ", "àé ñandú line with other letters İ", "short", "exactly twenty chars", "nineteen characters", "", "   ", "a" * 5000, "cr at its end, with a key as long\r"]
    out = [(i, "\n".join(rng.choice(known) if rng.random() < 0.7 else f"only here {rng.random()} {i}" for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    return [*out, (None, known[0]), (None, None), (7, out[7][1]), (7, known[2]), (100, None), (101, ""), (102, "\n\n"), (103, "\n".join([known[0]] * 3000)), (104, known[9])]


def test_lines_equal_brute_force_whatever_the_batches(spark, texts):
    docs = spark.createDataFrame(texts, DOCS).withColumns({"h": F.lit(1), "last": F.lit("x"), "lines": F.lit(0), "key": F.lit(2)}).repartition(3)
    for n in (1, 3, 4):
        assert held(lines.deduplicated(docs, n=n)) == by_hand(texts)
    assert held(lines.deduplicated(docs, long=5, least=2)) == by_hand(texts, 5, 2)


def test_lines_of_odd_tables(spark):
    for rows in ([], [(None, "a line of twenty characters")] * 4, [(5, "a line of twenty characters")] * 3 + [(6, "A LINE of twenty characters ")]):
        assert held(lines.deduplicated(spark.createDataFrame(rows, DOCS))) == by_hand(rows)


def test_runs_are_compacted_and_settled_keys_join_no_later_run(spark):
    runs = lines.Runs(spark)
    sizes = []
    for top in (40, 30, 20, 10):
        batch = spark.createDataFrame([(top - i, f"a line that every document holds\nline of document {top - i} alone") for i in range(5)], DOCS)
        runs.add(batch)
        sizes.append([r and r.count() for r in runs.levels])
    assert sizes == [[6], [None, 11], [5, 11], [None, None, 21]]
    assert [r["last"] for r in runs.repeated().collect()] == [40]


def test_line_batches_hold_each_row_once(spark):
    for ids in ([], [None, None], [3] * 9, [*range(50), None, 7, 7]):
        docs = spark.createDataFrame([(i, "x") for i in ids], DOCS)
        got = [[r.doc_id for r in b.collect()] for b in lines.batches(docs)]
        assert sorted(map(repr, sum(got, []))) == sorted(map(repr, ids))
        known = [[i for i in b if i is not None] for b in got]
        known = [b for b in known if b]
        assert all(min(a) > max(b) for a, b in zip(known, known[1:]))


def vectors(n=300, dims=21):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(n, 6)) @ rng.normal(size=(6, dims)) + 0.2 * rng.normal(size=(n, dims))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(None, rows[3][1]), (5, rows[5][1]), (5, rows[6][1]), (900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [math.nan] + [0.0] * (dims - 1)), (904, [0.0] * (dims - 1) + [math.inf]), (905, [None] + [0.0] * (dims - 1))]
    return rows + odd + [(1000 + i, rows[9][1]) for i in range(120)]


def test_whitening_equals_numpy(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit("clash"), "component": F.lit(1), "dim": F.lit(1)}).repartition(5)
    got = whitening.whitened(frame, tile=8).toPandas()
    kept = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000) for i, v in rows if v and len(v) == 21 and None not in v and np.isfinite(v).all()]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, total = len(fit), fit.sum(0)
    cov = np.cov((fit - total / n).T, bias=True)
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)[:16]
    assert len(got) == 16 * len(kept) and set(got.n) == {n} and got.identity_error.max() < 1e-8 and got.identity_error.nunique() == 1
    for c, at in enumerate(order, 1):
        own = got[got.component == c]
        assert np.allclose(own.explained, e[at] / np.trace(cov), rtol=1e-9)
        want = defaultdict(list)
        for i, x in kept:
            want[i].append(((x - total / n) @ v[:, at]) / math.sqrt(e[at]))
        have = defaultdict(list)
        for i, w in zip(own.vec_id, own.whitened):
            have[None if i != i else int(i)].append(w)
        sign = np.sign(want[0][0] * have[0][0])
        assert all(np.allclose(sorted(sign * np.array(have[i])), sorted(want[i]), atol=1e-7) for i in want)
    deviation = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, total)) for i, x in kept if i is not None and i != 5}
    found = got[got.vec_id.notna() & (got.vec_id != 5)].groupby("vec_id").deviation.unique()
    assert {int(i): [int(x) for x in u] for i, u in found.items()} == {i: [d] for i, d in deviation.items()}


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(9)]):
        assert whitening.whitened(make(rows)).collect() == []
    flat = whitening.whitened(make([(i, [float(i), 3.0, 2.0 * i]) for i in range(8)])).toPandas()
    assert set(flat.component) == {1} and np.allclose(flat.explained, 1) and flat.identity_error.max() < 1e-9
    wide = whitening.whitened(make([(0, [1e15, 0.0]), (1, [-1e15, 1.0]), (2, [0.0, 5.0])])).toPandas()
    assert wide.deviation.isna().any()


def test_tiles_give_the_same_sums_whatever_their_size(spark):
    x = np.random.default_rng(2).integers(-50, 50, (90, 10))
    fit = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(3)
    mean = x.mean(0)
    for tile, rows in ((10, 2048), (3, 7), (1, 50)):
        assert np.allclose(whitening.tile_sums(fit, mean, tile, rows), (x - mean).T @ (x - mean))


def test_query_digest_is_of_the_kept_lines(spark):
    rows = [(i, "shared by all of these texts\nown line") for i in range(3)]
    out = lines.deduplicated(spark.createDataFrame(rows, DOCS)).withColumn("kept_sha256", F.sha2("kept", 256))
    assert {r.doc_id: r.kept_sha256 for r in out.collect()}[0] == hashlib.sha256(b"own line").hexdigest()
