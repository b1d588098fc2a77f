"""Output shards of the mix against a packing made by hand."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessellate.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def corpus(spark, seed=4, n=90):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(rng.randrange(60))) or None, rng.choice(["a", "b", "b", None])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def packing(spark, rows, block_words, shards):
    """Every slot by hand: documents in the order of their keys, words of a source cut into blocks, slots walked one by one."""
    docs = spark.createDataFrame(rows, SCHEMA)
    keys = {r.doc_id: (r.b, r.r) for r in docs.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("r")).withColumn("b", F.pmod(F.xxhash64("r", F.lit(mixing.SEED)), F.lit(64))).collect()}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    words = {s: [(w, d) for d, t, s2 in sorted(rows, key=lambda x: keys[x[0]]) if s2 == s for w in (t or "").split()] for s in names}
    goals = mixing.targets([len(words[s]) for s in names])
    made = {}
    for i, s in enumerate(names):
        blocks = [words[s][j : j + block_words] for j in range(0, len(words[s]), block_words)]
        full = len(words[s]) // block_words
        left, t, slots = round(goals[i]), 0, []
        while left > 0:
            epoch, place = divmod(t, len(blocks))
            block = int(mixing.permuted(np.array([place]), full, (mixing.SEED << 40) + (i << 8) + epoch)[0]) if place < full else place
            got = blocks[block][:left]
            slots.append((s, t, epoch, block, len(got), tuple(w for w, _ in got)))
            left, t = left - len(got), t + 1
        made[i] = slots
    counts = mixing.draw(np.array([len(made[i]) for i in made]), shards, mixing.SEED)
    out = {}
    for i in made:
        shard_of = np.repeat(np.arange(shards), counts[:, i])
        for x in made[i]:
            out[x[:2]] = (int(shard_of[x[1]]), *x[2:])
    return out


def test_shards_equal_a_packing_by_hand(spark):
    docs, rows = corpus(spark)
    layouts = []
    for shards in (1, 5):
        got = {(r.source, r.slot): (r.shard, r.epoch, r.block, r.n_words, tuple(r.text.split())) for r in mixing.packed(docs.repartition(3), block_words=16, shards=shards).collect()}
        assert got == packing(spark, rows, 16, shards)
        layouts.append({k: v[0] for k, v in got.items()})
    assert layouts[0] != layouts[1]  # the draw decides which shard holds which slot
    took = Counter()
    for r in mixing.packed(docs, block_words=16).collect():
        for w in r.text.split():
            took[int(w[1:].split("x")[0])] += 1
    assert took == Counter({r.doc_id: r.taken for r in mixing.taken(docs, block_words=16).collect() if r.taken})


def test_small_sources_meet_their_targets(spark):
    rows = [(i, " ".join(["w"] * 20), f"s{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    took = defaultdict(int)
    for r in mixing.taken(docs).collect():
        took[r.target] += r.taken
        assert r.taken <= 3 * r.size
    assert took == {100.0: 100, 200.0: 200, 300.0: 300}


def test_clashing_names_and_repeated_rows(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (1, "d e", None), (1, "f g", "t"), (2, "", "t"), (3, None, "t")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("r", "q", "k", "x", "spans", "_r", "_K", "start", "slot", "epoch", "s"):
        docs = docs.withColumn(c, F.lit("mine"))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    out = got.collect()
    assert all(r.r == r["_r"] == r.spans == r.slot == "mine" for r in out)
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in mixing.taken(docs).collect())
    assert mixing.packed(docs.limit(0)).count() == 0
