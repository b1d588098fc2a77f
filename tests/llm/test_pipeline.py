"""Stages of the pipeline, and the whole, against brute force on a small table."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessellate.llm import base, language, mixing, nearcopies, segmentation

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": ["the", "ing", "and", "tion", "wh"], "de": ["sch", "ein", "ung", "der", "ß"]}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    prose = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    out = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        out.append([i, prose(lang, rng.randrange(30, 200)), lang, f"s{i % 3}", 0])
    passage = prose("en", 150)
    for i in range(0, 40, 10):
        out[i][1] = out[i][1] + " " + passage + " " + prose("en", 20)
    for i in (5, 6, 7):
        out[i + 60][1], out[i + 60][2] = out[i][1], out[i][2]
    out[70][1] = out[71][1] + " more"
    out += [[200, "12345 67890 !!!", "en", "s0", 0], [201, "", "en", "s0", 0], [202, None, None, None, 0], [None, prose("de", 60), "de", "s1", 0], [5, prose("en", 40), "en", "s1", 0], [300, "漢字 " * 50, None, "s2", 0]]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s, _ in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def grams(text):
    """Counts of the hashed bigrams and trigrams of a text, one at a time."""
    raw = text.lower().encode()
    table = [c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)]
    c = [table[b] for b in raw]
    out = np.zeros(language.DIM, np.float32)
    for size in (2, 3):
        for i in range(len(c) - size + 1):
            if c[i] == 32 and c[i + 1] == 32:
                continue
            code = size
            for x in c[i : i + size]:
                code = (code * 257 + x) % 2**32
            out[(code * 0x9E3779B1) % 2**32 >> 20] += 1
    return out


def test_language_by_hand(spark, docs, rows):
    model = language.train(docs, base.F.lit(True))
    got = {(r.doc_id, r.text): r for r in language.identify(docs, model, "_t_").collect()}
    for doc_id, text, *_ in rows:
        r = got[doc_id, text]
        if not any(ch.isalpha() for ch in text or ""):
            assert (r["_t_lang_pred"], r["_t_score"], r["_t_rejected"]) == ("und", 0, True)
            continue
        x = np.log1p(grams(text)) * model["idf"]
        near = model["centres"] @ (x / max(np.linalg.norm(x), 1e-9))
        assert r["_t_score"] == pytest.approx(max(0, near.max()), abs=1e-5)
        assert r["_t_lang_pred"] == model["langs"][model["owner"][near.argmax()]]
        assert r["_t_rejected"] == (r["_t_score"] < model["limit"][model["owner"][near.argmax()]])
    kept = corpus_pipeline.keep_known_language(spark, docs, "")
    assert kept.columns == docs.columns
    whole = language.train(docs, base.F.coalesce(base.fold("doc_id", 3) != 1, base.F.lit(True)))
    want = Counter((r.doc_id, r.text) for r in language.identify(docs, whole).collect() if not r.rejected)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    clean = [(d, t) for d, t, lang, *_ in rows if lang and t and t[0].isalpha()]
    assert all(want[x] for x in clean) and not want[300, "漢字 " * 50]


def test_one_language_of_each_size_is_sampled(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 5)
    rows = [(None if i % 2 else 1, f"wort{i} schön", "de") for i in range(300)] + [(i, "one word", "en") for i in range(3)] + [(7, "all alike", "xx")] * 40
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), base.F.lit(True))
    assert model["langs"] == ["de", "en", "xx"] and len(model["limit"]) == 3


def test_near_duplicates(spark, docs, rows):
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    sets = [frozenset(nearcopies.shingles([(t or "").encode()])[0].tolist()) for _, t, *_ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                root = [root[i] if r == root[j] else r for r in root]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    places = [root[next(i for i, x in enumerate(rows) if x[:2] == g)] for g in got]
    assert sorted(places) == sorted(set(root))
    assert all(g[0] == min((rows[i][0] for i in range(len(rows)) if root[i] == p and rows[i][0] is not None), default=None) for g, p in zip(got, places))


def test_substrings(spark, docs, rows):
    raw = [(t or "").encode() for _, t, *_ in rows]
    n = corpus_pipeline.REPEATED
    seen = Counter(x[i : i + n] for x in raw for i in range(len(x) - n + 1))
    want = Counter()
    for (doc_id, *_), x in zip(rows, raw):
        gone = [False] * len(x)
        for i in range(len(x) - n + 1):
            if seen[x[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        text = bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", "ignore")
        if text.split():
            want[doc_id, text, len(text)] += 1
    assert any(len(x[1]) < len(r[1] or "") for r in rows for x in want if x[0] == r[0])
    kept = corpus_pipeline.cut_repeated_substrings(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == want


def test_run(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=segmentation.model_bytes())
    stages = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        stages = base.written(stage(spark, stages, ""), "test")
    before = [(r.doc_id, r.text, r.source) for r in stages.collect()]
    names = sorted({s for *_, s in before}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(t.split()) for _, t, s in before if s == name) for name in names]
    mixed = corpus_pipeline.mix_sources(spark, stages, "")
    assert mixed.columns == docs.columns
    texts = mixed.collect()
    for name, goal in zip(names, mixing.targets(sizes)):
        assert sum(len(r.text.split()) for r in texts if r.source == name) == round(goal)
    assert all(r.n_chars == len(r.text) for r in texts)
    words = {d: t.split() for d, t, _ in before if d is not None and sum(x[0] == d for x in before) == 1}
    assert all(set(r.text.split()) <= set(words[r.doc_id]) for r in texts if r.doc_id in words)
    key = lambda d, ids: (d is None, d or 0, tuple(ids))
    assert sorted(key(r.doc_id, r.ids) for r in out) == sorted(key(r.doc_id, sp.encode(r.text)) for r in texts)
    assert all(r.exact for r in out)


def test_repeated_rows_teach_their_language(spark):
    rng = random.Random(2)
    prose = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(n))
    one, kinds = prose("de", 60), [prose("de", 60) for _ in range(6)]
    english = [(i, prose("en", 60), "en", "s", 0) for i in range(300)]
    for rest in ([(None, one, "xx", "s", 0)] * 3000, [(None, kinds[i % 6], "xx", "s", 0) for i in range(6000)]):
        docs = spark.createDataFrame(english + rest, SCHEMA).repartition(4)
        model = language.train(docs, language.F.lit(True))
        assert model["langs"] == ["en", "xx"]
        found = language.identify(docs, model).groupBy("lang", "lang_pred", "rejected").count().collect()
        assert {(r.lang, r.lang_pred, r["count"]) for r in found if not r.rejected} == {("en", "en", 300), ("xx", "xx", len(rest))}


def test_stages_take_columns_of_the_names_they_use(spark, docs):
    names = ["_t_rejected", "_t_no", "_t_id", "_t_th", "lang_pred", "score", "rejected", "_rejected", "h", "r", "q", "marks", "starts", "x", "k", "spans", "component", "th", "c", "keys", "at", "n"]
    more = docs.select("*", *(language.F.lit(i % 2 == 0).alias(c) for i, c in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:4]:
        got, want = stage(spark, base.written(more, name), ""), stage(spark, base.written(docs, name), "")
        assert got.columns == more.columns, name
        assert sorted(map(repr, got.select(*docs.columns).collect())) == sorted(map(repr, want.collect())), name
