"""More operators against slow versions made by hand, on odd rows too."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.llm import base, components, piecewise, quality, repetition, simhash


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def signature(raw, k):
    """Chunks of a text at block size 3 * 2**k and the letter of each, byte by byte."""
    out, h, power = b"", 0, 1
    for i, b in enumerate(raw):
        h = (h + int(piecewise.BYTES[b]) * power) % 2**64
        power = power * piecewise.ODD % 2**64
        rolled = roll(raw, i)
        boundary = i >= piecewise.WINDOW - 1 and (rolled + 1) % 2**32 and (rolled + 1) % 2**32 % (3 * 2**k) == 0
        if boundary or i == len(raw) - 1:
            out += bytes([piecewise.LETTERS[int(base.mix64(np.array([h], np.uint64))[0]) >> 58]])
            h, power = 0, 1
    return out


def roll(raw, i):
    """Sum, weighted sum and shifted exclusive or of the seven bytes that end at i."""
    window = raw[max(0, i - 6) : i + 1][::-1]
    shifted = 0
    for j, b in enumerate(window):
        shifted ^= (b << (5 * j)) % 2**32
    return (sum(window) + sum(b * (piecewise.WINDOW - j) for j, b in enumerate(window)) + shifted) % 2**32


def test_signatures_by_hand():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice((0, 3, 7, 40, 900, 5000)))).encode() for _ in range(25)]
    data, at = piecewise.joined([t.decode() for t in texts])
    levels, first, second = piecewise.signatures(data, at)
    for i, raw in enumerate(texts):
        counts = [len(signature(raw, k)) for k in range(int(levels[i]) + 1)]
        assert first[i] == signature(raw, int(levels[i])) and second[i] == signature(raw, int(levels[i]) + 1)
        assert counts[-1] <= 65 and all(c > 65 - 1 for c in counts[:-1])


def test_neighbours_with_null_and_repeated_ids(spark):
    import xxhash

    rows = [(None, f"x{i % 50} " * (i % 40)) for i in range(300)] + [(i, "t %d " % i * 20) for i in range(200)] + [(7, "")] * 30 + [(7, None)] * 20 + [(9, "same text")] * 40
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    order = sorted((-(2**63) if d is None else d, signed(t or ""), t or "") for d, t in rows)
    want = []
    for i, (k, _, t) in enumerate(order):
        after = order[(i + 1) % len(order)][2]
        quarter = len(t) // 4
        want.append((k, len(t), hashlib.sha256((t[: len(t) - quarter] + after[:quarter]).encode()).hexdigest()))
    got = piecewise.with_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    alone = piecewise.with_neighbours(spark.createDataFrame([(5, "one text alone")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(5, 1.0)]


def test_links_go_through_rows_without_an_id(spark, monkeypatch):
    chain = [(1, 0b0), (None, 0b111), (3, 0b111111), (None, 0xFFFF0000FFFF0000 - 2**64), (None, 0xFFFF0000FFFF0001 - 2**64)]
    table = spark.createDataFrame(chain, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, size: docs)
    got = simhash.near_duplicates(table).collect()
    assert sorted((r.component_id or 0) for r in got) == [0, 0, 1, 1, 1]
    assert all(r.component_id == 1 for r in got if 0 <= r.fp < 64)


def test_components_equal_all_pairs(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(200)]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            words = list(words)
            words[rng.randrange(200)] = "other"
            texts.append(" ".join(words))
    texts += ["", None, texts[3], texts[9]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(None if i % 9 == 4 else ids[i], t) for i, t in enumerate(texts)]
    prints = simhash.simhash([(t or "").encode() for t in texts])
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    reach = np.linalg.matrix_power(near.astype(float), 64) > 0
    want = sorted(str((rows[i][0], int(prints[i].view(np.int64)), min((rows[j][0] for j in np.flatnonzero(reach[i]) if rows[j][0] is not None), default=None))) for i in range(len(rows)))
    assert (near.sum(1) > 1).sum() > 20
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.fp, r.component_id)) for r in got) == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (100, 101), (101, 100)], "a long, b long")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100}


def test_scores_of_the_additive_model_by_hand(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ABC.,!|1 \n") for _ in range(rng.randrange(400))) for _ in range(200)] + ["", None, " \n"]
    rows = [(i, t, int("!" in (t or "")[:20])) for i, t in enumerate(texts)]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    got = {r.doc_id: r.score for r in quality.scored(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()}
    import pyarrow as pa

    for i, text, _ in rows:
        x = quality.figures(pa.array([text], pa.string()))[0]
        place = lambda cuts, v: sum(c <= v for c in cuts)
        z = model["b"] + sum(t[place(c, v)] for t, c, v in zip(model["tables"], model["cuts"], x))
        z += sum(t[place(model["coarse"][a], x[a]), place(model["coarse"][b], x[b])] for (a, b), t in model["pairs"].items())
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_figures_by_hand():
    import pyarrow as pa

    text = "Two words|Two words!\nx 12\nx 12\n"
    f = dict(zip(quality.FIGURES, quality.figures(pa.array([text], pa.string()))[0].tolist()))
    assert f["log_words"] == pytest.approx(np.log1p(7)) and f["repeated_lines"] == pytest.approx(1 / 3) and f["pipes"] == pytest.approx(1 / len(text)) and f["exclaims"] == pytest.approx(1 / len(text))
    assert f["upper"] == pytest.approx(2 / 18) and f["longest_word"] == pytest.approx(np.log1p(9)) and f["distinct_words"] == pytest.approx(5 / 7**0.9)


def test_a_long_text_and_an_empty_step(spark):
    long = "word " * 400_000  # 2 MB, over a step
    rows = spark.createDataFrame([(1, long), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.repetition(rows).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[2].n_words, got[3].kept) == (400_000, 400_000, 0, False)
    assert {r.doc_id: r.fingerprint for r in piecewise.fingerprints(rows).select("doc_id", F.substring("fingerprint", 1, 3).alias("fingerprint")).collect()}[2] == "0::"


def test_sql_states_the_repetition_query(spark):
    from pathlib import Path

    from tessellate.llm import catalog

    duckdb = pytest.importorskip("duckdb")
    tables = Path("/root/testdata/sf0.001")
    if not tables.exists():
        pytest.skip("no tables")
    made = duckdb.connect()
    for name in ("documents", "benchmark"):
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    for name, sql in catalog.SQL.items():
        got, want = catalog.QUERIES[name](spark, str(tables)).toPandas(), made.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None))
