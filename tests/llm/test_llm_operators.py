"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessellate.llm import base, components, language, licences, mixing, piecewise, quality, repetition, segmentation, simhash, substrings, toxicity

WORD = re.compile(base.WORD)
SCHEMA = "doc_id long, text string, lang string, source string"
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "x", "en", "b"), (4, "x", "en", "b"), (None, "no id", "en", "b"), (5, "word " * 30_000, "en", "b"), (6, "ñandú éèê 漢字 \U0001f600 ▁▁ a  b", "es", "c")]
TABLES = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, clashing extra columns."""
    return spark.createDataFrame(ODD, SCHEMA).withColumn("r", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("score", F.lit(0.5)).withColumn("n_words", F.lit(3))


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    shared = ["".join(rng.choice("abcd efé\n") for _ in range(n)) for n in (380, 420, 700, 1500)]
    out = []
    for _ in range(60):
        t = ""
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            t += "".join(rng.choice("abcd efé\n") for _ in range(rng.randrange(300))) + p[rng.randrange(90) :]
        out.append(t)
    return [*out, "a" * 3000, "ab" * 900, "a" * 399, "a" * 400, None, "", out[7], out[7], out[9][:-3] + "x"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def test_every_operator_takes_odd_rows_and_empty_tables(spark, odd):
    marks = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (9, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    model = segmentation.model_bytes()
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        tox = toxicity.train(toxicity.labelled(docs, marks, "toxic", F.lit(True), 100))
        gam = quality.train(toxicity.labelled(docs, marks, "quality", F.lit(True), 100))
        lid = language.train(docs, F.lit(True))
        for out in (
            repetition.repetition(docs), piecewise.with_neighbours(docs), piecewise.fingerprints(docs), simhash.near_duplicates(docs), licences.licences(docs), language.identify(docs.select("doc_id", "text"), lid),
            quality.scored(docs, gam), substrings.cut(docs), segmentation.encoded(docs, model), mixing.taken(docs), toxicity.scored(docs, tox),
        ):
            assert len(out.collect()) == n
        assert substrings.cut_documents(docs).columns == docs.columns
        assert mixing.mixed(docs).columns == docs.columns
        assert simhash.representatives(docs).columns == docs.columns


def test_repetition(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(80))) for _ in range(40)]
    got = {r.doc_id: r for r in repetition.repetition(frame(spark, texts), min_words=5).collect()}
    for i, text in enumerate(texts):
        w = text.split()

        def cover(n, w=w):
            seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            return len({j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)})

        longest = max((n for n in range(1, len(w)) if cover(n)), default=0)
        assert (got[i].n_words, got[i].n_repeat_words, got[i].covered_words, got[i].longest_repeat) == (len(w), cover(3), cover(5), longest)


def test_fingerprints(spark, prose):
    got = sorted(piecewise.with_neighbours(frame(spark, prose)).collect())
    texts = [t or "" for t in prose]
    for i, r in enumerate(got):
        other, quarter = texts[(i + 1) % len(texts)], len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - quarter] + other[:quarter]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert r.edited_fingerprint == piecewise.shown(piecewise.signatures(*piecewise.joined([edited])))[0]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[66].fingerprint == got[67].fingerprint and got[66].near_next == 1


def test_likeness_is_edit_distance():
    rng = random.Random(1)

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for _ in range(200):
        a = bytes(rng.choice(b"ABC") for _ in range(rng.randrange(1, 30)))
        b = bytes(x for x in a if rng.random() < 0.8) or b"A"
        score = piecewise.likeness([a], [b])[0]
        shared = min(len(a), len(b)) < 5 or any(a[i : i + 5] in b for i in range(len(a) - 4))
        assert score == pytest.approx(1 - levenshtein(a, b) / max(len(a), len(b)) if shared else 0)


def test_simhash_links(spark):
    rng = np.random.default_rng(1)
    values = []
    for c in rng.integers(0, 2**63, 40, dtype=np.uint64):
        for _ in range(15):
            x = int(c)
            for _ in range(rng.integers(0, 5)):
                x ^= 1 << int(rng.integers(0, 64))
            values.append(x)
    v = np.unique(np.array(values, np.uint64))
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    assert {(int(a), int(b)) for i, j in simhash.trie_links(v) for a, b in zip(i, j)} == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    least = np.arange(len(v))
    while True:
        new = np.array([least[near[i]].min() for i in range(len(v))])
        if (new == least).all():
            break
        least = new
    names = v.view(np.int64).tolist()
    classes = spark.createDataFrame([(x,) for x in names], "fp long")
    for hot in (10_000, 3):  # uncut groups, and groups cut twice over
        found = {r.node: r.component for r in components.components(simhash.links(classes, hot)).collect()}
        of = [found.get(x, x) for x in names]
        assert [of.index(x) for x in of] == least.tolist()


def test_simhash_fingerprint(spark, prose):
    for text, fp in zip(prose, simhash.simhash([(t or "").encode() for t in prose])):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        assert int(fp) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("n", [400, 300])
def test_substrings(spark, prose, n):
    raw = [(t or "").encode() for t in prose]
    seen = Counter(x[i : i + n] for x in raw for i in range(len(x) - n + 1))
    got = {r.doc_id: r for r in substrings.cut(frame(spark, prose), n).collect()}
    for d, x in enumerate(raw):
        gone = np.zeros(len(x) + 2, bool)
        for i in range(len(x) - n + 1):
            if seen[x[i : i + n]] > 1:
                gone[i + 1 : i + n + 1] = True
        kept = bytes(b for b, g in zip(x, gone[1:]) if not g)
        want = (len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == want


def test_suffix_sort():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    raw = data.tobytes()
    suffixes = rng.permutation(2900)
    bounds = np.array([0, 700, 701, 1500, 2900])
    order = substrings.sort_suffixes(data, substrings.Prefix(data, substrings.BYTES1, substrings.ODD1), suffixes, bounds, 100)
    for a, b in zip(bounds, bounds[1:]):
        assert [raw[i : i + 100] for i in order[a:b]] == sorted(raw[i : i + 100] for i in suffixes[a:b])


def test_mixing(spark):
    rng = random.Random(9)
    docs = frame(spark, ["w " * rng.randrange(400) for _ in range(300)])
    rows = mixing.taken(docs, block_words=16).collect()
    assert len(rows) == 300 and all(r.taken <= 3 * r.size for r in rows)
    size = Counter()
    took = Counter()
    for r in rows:
        size[r.doc_id % 3] += r.size
        took[r.doc_id % 3] += r.taken
    want = mixing.targets([size[i] for i in range(3)])
    for i in range(3):
        assert took[i] == pytest.approx(want[i], rel=0.02)
    assert sorted(rows) == sorted(mixing.taken(docs.repartition(7), block_words=16).collect())
    texts = Counter()
    for r in mixing.mixed(docs, block_words=16).collect():
        texts[r.doc_id] += len(r.text.split())
    assert texts == Counter({r.doc_id: r.taken for r in rows if r.taken})


def test_targets():
    assert mixing.targets([100, 100, 100]) == [50, 100, 150]
    assert mixing.targets([600, 5, 5]) == [580, 15, 15]
    assert mixing.targets([]) == [] and mixing.targets([0]) == [0]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 7)) == list(range(n))


@pytest.mark.skipif(not TABLES.exists(), reason="no tables")
def test_encoding_equals_the_library(spark):
    sp = pytest.importorskip("sentencepiece")
    model = segmentation.model_bytes()
    library = sp.SentencePieceProcessor(model_proto=model)
    texts = [r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").filter("doc_id < 60").collect()] + ["a   b  c\n  x ", "  lead", "漢 z"]
    rows = segmentation.encoded(frame(spark, texts), model).collect()
    assert all(r.exact and r.ids == library.encode(texts[r.doc_id]) for r in rows)
    at = model.rindex(b"\x12\x06tok_v0\x18\x02") + 9  # the same pieces as a unigram model
    twin = model[:at] + b"\x01" + model[at + 1 :]
    unigram, pieces = sp.SentencePieceProcessor(model_proto=twin), segmentation.Pieces(twin)
    total = {i: s for s, i in pieces.score.values()}
    words = sorted({w for t in texts for w in t.split() if all(c in pieces.score for c in w)})
    for w, ids in zip(words, pieces.encode(["▁" + w for w in words])):
        assert sum(total[i] for i in ids) >= sum(total[i] for i in unigram.encode(w)) - 1e-2


def test_licence_rules():
    assert licences.matched(licences.identifiers("Text.\nReleased under the MIT License.")) == (["MIT"], [])
    assert licences.matched(licences.identifiers("This work is licensed under the GNU General Public License, version 3.")) == (["GPL-3.0"], [])
    assert licences.matched(licences.identifiers("Licensed under CC BY-NC 4.0.")) == (["CC-BY-NC-4.0"], [])
    assert licences.matched(["mit-grant", "mit-notice", "as-is", "rights"]) == (["MIT"], ["rights"])
    assert licences.matched(["mit-notice", "mit-grant"]) == ([], ["mit-notice", "mit-grant"])
    assert licences.identifiers("My own licence applies.") == ["?"]


def test_identity_terms_move_no_score():
    rng = np.random.default_rng(0)
    n = 2000
    y = rng.random(n) < 0.3
    x = np.stack([y & (rng.random(n) < 0.9), rng.random(n) < np.where(y, 0.6, 0.1), rng.random(n) < 0.2], 1).astype(np.float32)
    change = np.zeros((int(x[:, 1].sum()), 3), np.float32)
    change[:, 1], change[:, 2] = -1, 1
    free, tied = toxicity.fit(x, y.astype(np.float32), change[:0], np.zeros(0)), toxicity.fit(x, y.astype(np.float32), change, np.full(len(change), 1 / len(change)))
    assert abs(tied["w"][1] - tied["w"][2]) < 0.3 * abs(free["w"][1] - free["w"][2])


def test_gam_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.score(x, quality.fit(x, y)) > 0.5) == y).mean() > 0.95


@pytest.mark.skipif(not TABLES.exists(), reason="no tables")
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = language.identify(docs, language.train(docs, base.fold("doc_id", 3) != 1)).filter(base.fold("doc_id", 3) == 1).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert sum(r.rejected for r in rows) / len(rows) < 0.01
