"""Clustered search against brute force, and its parts one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellate.llm import base, search

TERM = re.compile(search.TERM)
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, limit=10):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_all, l_all = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for q, text in items:
        if q is not None:
            asked.setdefault(q, set()).update(words(text))
    out = []
    for q, own in asked.items():
        found = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(q, r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    topics = [[f"{c}{w}" for w in ("alpha", "beta", "Gamma", "delta", "eta", "zeta", "ñu", "漢字")] for c in "klmnop"]
    rare = [f"r{i}" for i in range(300)]
    docs = []
    for i in range(500):
        topic = rng.choice(topics)
        docs.append((i, " ".join(rng.choice(topic if rng.random() < 0.6 else topics[0] if rng.random() < 0.5 else rare) for _ in range(rng.randrange(1, 60)))))
    docs += [(600 + i, docs[7][1]) for i in range(250)]  # a third are copies
    docs += [(None, docs[8][1]), (None, docs[9][1]), (8, docs[8][1]), (900, None), (901, ""), (902, "?! ..."), (903, "x" * 3000 + " " + "x" * 2999), (904, "kalpha " * 20_000)]
    items = [(i, " ".join(rng.sample(rng.choice(topics), 3) + rng.sample(rare, 2))) for i in range(25)] + [(30, docs[7][1]), (31, None), (32, "..."), (33, "nowhere found"), (34, "X" * 3000), (None, "kalpha"), (1, "kalpha lbeta")]
    return docs, items


def test_search_equals_brute_force(spark, corpus):
    docs, items = corpus
    frame = spark.createDataFrame(docs, DOCS).withColumns({"leaf": F.lit(1), "at": F.lit("x"), "block": F.lit(2)}).repartition(4)
    frame, asked = base.written(frame, "docs"), spark.createDataFrame(items, ITEMS).withColumn("term", F.lit(0))
    want = by_hand(docs, items)
    for settings in ({}, {"part_bytes": 3000, "block_bytes": 2500}, {"depth": 2, "sample": 40, "part_bytes": 5000, "batch_terms": 40}):
        found = search.search(frame, asked, **settings).collect()
        assert sorted(map(tuple, found), key=repr) == want, settings


def test_search_of_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], DOCS)
    for docs, items in ((none, []), (none, [(1, "a")]), (one, []), (one, [(1, None)]), (one, [(1, "c")])):
        assert search.search(base.written(docs, "none"), spark.createDataFrame(items, ITEMS)).collect() == []
    twice = search.search(base.written(one.unionAll(one), "one"), spark.createDataFrame([(5, "A")], ITEMS)).collect()
    assert sorted(map(tuple, twice)) == by_hand([(1, "a b")] * 2, [(5, "A")]) and len(twice) == 2
    both = one.unionAll(spark.createDataFrame([(2, "c d"), (3, "e f")], DOCS))
    assert [tuple(r)[:3] for r in search.search(base.written(both, "both"), spark.createDataFrame([(5, "A")], ITEMS)).collect()] == [(5, 1, 1)]


def test_shuffled_visits_give_the_same(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    frame = base.written(spark.createDataFrame(docs, DOCS).repartition(2), "docs")
    assert sorted(map(tuple, search.search(frame, spark.createDataFrame(items, ITEMS), 3, part_bytes=4000).collect()), key=repr) == by_hand(docs, items, 3)


def test_terms_equal_the_pattern():
    texts = ["A b-c D9", None, "", "漢字,ñ É", "one" + "\x7f" + "two", "z" * 200 + " " + "Z" * 200, "tail"]
    owner, a, b, at = search.terms(pa.array(texts))
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert owner.tolist() == [i for i, _ in want] and len(at) == len(texts) + 1
    ids = {}
    for (_, w), x, y in zip(want, a.tolist(), b.tolist()):
        assert ids.setdefault(w, (x, y)) == (x, y)
    assert len(set(ids.values())) == len(ids)


def test_bisection_parts_topics_and_lessens_gaps():
    rng = np.random.default_rng(1)
    n = 200
    topic = rng.permutation(np.arange(n) % 2)
    owner = np.repeat(np.arange(n), 20)
    feature = rng.integers(0, 60, len(owner)) + 1000 * topic[owner]
    own, f = np.unique(np.stack([owner, feature]), axis=1)
    weight = search.bisected(own, f, n)
    side = np.bincount(own, weight[f], n) > 0
    assert max((side == topic).mean(), (side != topic).mean()) > 0.95

    def cost(second):
        d2 = np.bincount(f, second[own], search.FEATURES)
        d1 = np.bincount(f, minlength=search.FEATURES) - d2
        return search._gaps(n // 2, n - n // 2, d1, d2).sum()

    assert cost(side) < cost(np.arange(n) >= n // 2)


def test_terms_with_one_first_hash_are_told_apart():
    a, b = np.array([3, 5, 5, 5, 9], np.uint64), np.array([1, 1, 2, 3, 1], np.uint64)
    got = search.located(a, b, np.array([5, 5, 5, 9, 3, 4, 10], np.uint64), np.array([3, 1, 4, 1, 2, 1, 1], np.uint64))
    assert got.tolist() == [3, 1, -1, 4, -1, -1, -1]


def test_each_block_bounds_its_documents(spark, corpus):
    docs, _ = corpus
    blocks, n_all = search.index(base.written(spark.createDataFrame(docs, DOCS).repartition(3), "docs"), part_bytes=3000)
    rows = blocks.collect()
    assert sum(r.docs for r in rows) == len(docs) and len({r.block for r in rows}) == len(rows) > 5
    for r in rows:
        df, most, at, tf, m = np.frombuffer(r.df, np.int32), np.frombuffer(r.most, np.int32), np.frombuffer(r.at, np.int32), np.frombuffer(r.tf, np.int32), np.frombuffer(r.m, np.int64)
        gain = search.impact(tf, m[at])
        ends = np.cumsum(df)
        assert [gain[e - d : e].max() for d, e in zip(df, ends)] == most.tolist()
