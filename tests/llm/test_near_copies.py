"""Near copies of the pipeline against brute force over five-word sets."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessellate.llm import nearcopies, simhash

SCHEMA = "doc_id long, text string"


def five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    a, b = five(a), five(b)
    return a == b or len(a & b) >= 0.8 * len(a | b)


def groups(texts):
    """The component of each place by comparing all pairs."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(texts[i], texts[j]):
                root = [root[i] if r == root[j] else r for r in root]
    return root


def varied(seed, n=30):
    """Texts, and copies of each with 1 to 16 of 120 words changed: similarities on both sides of 0.8."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
        out.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            for at in rng.sample(range(120), rng.choice((1, 2, 3, 4, 8, 16))):
                copy[at] = "new" + str(rng.randrange(10**6))
            out.append(" ".join(copy))
    return out


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_linked_is_exact():
    texts = varied(1)
    sets = nearcopies.shingles([t.encode() for t in texts])
    root = list(range(len(texts)))
    for i, j in nearcopies.linked(sets):
        root = [root[i] if r == root[j] else r for r in root]
    assert same_partition(root, groups(texts))


def test_near_copies(spark):
    texts = [*varied(2), "x", "x", "one two three", None, "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    want = groups(texts)
    named = {tuple(sorted(nearcopies.shingles([(t or "").encode()])[0].tolist())): w for t, w in zip(texts, want)}
    for hot in (128, 2):
        got = nearcopies.near_copies(docs, hot=hot).collect()
        assert len(got) == len(named)
        assert same_partition([r.component for r in got], [want[r.doc_id] for r in got])


def test_representatives_are_the_least_of_each_component(spark):
    texts = varied(3)
    want = groups(texts)
    kept = {r.doc_id for r in nearcopies.representatives(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert kept == {want.index(c) for c in set(want)}


def test_rows_without_id_and_shared_ids_survive(spark):
    a, b, c, d, e = (varied(s, 1)[0] for s in range(10, 15))
    rows = [(None, a), (None, a), (7, b), (7, c), (None, b), (7, c), (8, c), (None, d), (None, d + " more"), (9, e), (1, None), (None, "")]
    got = [tuple(r) for r in nearcopies.representatives(spark.createDataFrame(rows, SCHEMA)).collect()]
    near_d = [r for r in got if (r[1] or "").startswith(d)]
    assert len(near_d) == 1 and near_d[0][0] is None
    assert sorted((r for r in got if r not in near_d), key=str) == sorted([(None, a), (7, b), (7, c), (9, e), (1, None)], key=str)


def test_candidates_come_from_the_trie(spark, monkeypatch):
    """With no min-hash keys at all, what is found is what the trie's fingerprints, 3 bits or fewer apart, connect."""
    rng, texts = random.Random(4), []
    for _ in range(8):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(1200)]
        texts.append(" ".join(words))
        for n in (1, 1, 2, 60):
            copy = list(words)
            for at in rng.sample(range(1200), n):
                copy[at] = "new" + str(rng.randrange(10**6))
            texts.append(" ".join(copy))
    sets = nearcopies.shingles([t.encode() for t in texts])
    prints = [int(simhash.voted(s, np.array([len(s)]))[0]) for s in sets]
    root = list(range(len(texts)))
    for _ in range(5):  # least place that it reaches over near fingerprints
        root = [min(root[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(texts))]
    for i in range(len(texts)):  # every one that meets another is alike to it here
        assert all(alike(texts[i], texts[j]) for j in range(i) if root[i] == root[j])
    assert 8 < len(set(root)) < len(texts)
    rows = nearcopies._rows
    monkeypatch.setattr(nearcopies, "_rows", lambda docs, size: rows(docs, size).withColumn("keys", F.array().cast("array<long>")))
    got = nearcopies.near_copies(spark.createDataFrame([*enumerate(texts), (99, None)], SCHEMA)).collect()
    assert same_partition([r.component for r in got], [root[r.doc_id] if r.doc_id < 99 else -1 for r in got])
