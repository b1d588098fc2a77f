"""Queries on small tables that hold what the given ones don't."""

import hashlib
import random
import re
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessellate import catalog
from tessellate.config import Retrieval
from tessellate.functions import html, markdown, text
from tessellate.llm import catalog as llm
from tessellate.llm import substrings
from tessellate.operators import privacy, ranking, retrieval
from tessellate.streaming import stateful


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_privacy_queries_run_on_documents(spark, tmp_path):
    d = put(spark, tmp_path, "documents", [(1, "a@b.org 12345"), (2, "123456 x"), (3, None)], "doc_id long, text string")
    found = catalog.queries()["privacy_findings"](spark, d)
    assert sorted(map(tuple, found.collect())) == [("email", "high", 1, 1), ("number", "medium", 2, 2)]
    assert tuple(catalog.queries()["privacy_summary"](spark, d).first()) == (1, 2, "blocked")


def test_references_stay_as_written():
    page = "<p>\na&amp<b>x&#38y &copy; &#x41;</b>\n&amp</p>\n<style>p{}</style>&lt&lt;"
    assert html.clean(page) == page.replace("<style>p{}</style>", "")


def test_a_report_counts_all_visitors(spark, tmp_path):
    start = datetime(2024, 1, 20, 3)
    rows = [(i, start, i, "view", 1.0, "{}") for i in range(6000)] + [(6000, start + timedelta(days=4), 1, "view", 1.0, "{}")]
    d = put(spark, tmp_path, "events", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    for name in ("daily_report_text", "reports_due", "daily_reports_sent"):
        text = {str(r.day): r.text for r in catalog.queries()[name](spark, d).collect()}
        assert "国内站：UV 6000 · PV 6000" in text["2024-01-20"], name


def test_a_window_goes_on_over_midnight(spark, tmp_path):
    midnight = datetime(2024, 1, 1, 16)  # local
    rows = [(i, midnight + timedelta(seconds=s), 1) for i, s in enumerate((-60, -59, -1, 0, 0, 58, 59, 86_400))]
    d = put(spark, tmp_path, "events", rows, "event_id long, ts timestamp_ntz, user_id long")
    got = catalog.queries()["sliding_rate_limit"](spark, d).orderBy("event_id").collect()
    assert [(r.in_window, r.in_day) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 1), (4, 2), (4, 3), (4, 4), (1, 1)]


def test_a_third_that_starts_with_a_line_end_is_one_paragraph(spark, tmp_path):
    # sentences of ten characters; the last third starts with a line end, after the heading that the query puts there
    third = "Sentences. " * 300
    text = third + third[:-1] + "x" + "\n" + third[:-1]
    d = put(spark, tmp_path, "documents", [(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    got = catalog.queries()["knowledge_chunks"](spark, d).filter("subfile_index = 1").orderBy("chunk_index").collect()
    # the heading and its blank line are in the first chunk with the sentences after them, not a chunk of their own
    assert [r.chunk_index for r in got] == list(range(len(got))) and all(r.content_length >= 1200 for r in got[:-1])


def test_a_stream_of_many_users_has_few_states(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, 3) + timedelta(milliseconds=i), i % 600) for i in range(1200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    got, query = stateful.run(stateful.sliding_stream(stateful.source(spark, str(tmp_path / "in")), buckets=8), str(tmp_path / "out"))
    assert got.filter("in_day = 2 AND in_window = 2").count() == 600
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 4 * 8


def test_query_tokens_are_not_carried_through_windows(spark):
    queries = spark.createDataFrame([(1, "alpha beta gamma"), (2, "b beta x")], "query_id long, query string")
    own = ranking.Lexicon(tokens=text.words, topics={})
    asked = ranking.parsed(queries, own)
    chunks = spark.createDataFrame([(1, "g", "alphabet", "beta b", "alpha beta gamma"), (2, "g", None, None, "beta")], "chunk_id long, source_group string, chunk_title string, section_title string, content string")
    marks = ranking._marks(chunks, asked, own)
    assert {r.chunk_id: sorted(r.title_tokens) for r in marks.collect()} == {1: ["alpha", "beta"], 2: []}
    rows = marks.crossJoin(asked).withColumns({"bm25": F.lit(20.0), "matched_terms": F.lit(3)})
    got = ranking._gated(rows, 5, Retrieval())
    assert not {"primary", "extra"} & set(got.columns)
    assert {(r.query_id, r.chunk_id): r.raw for r in got.collect()} == {(1, 1): 30.0, (1, 2): 20.0, (2, 1): 26.0, (2, 2): 20.0}


def test_an_excerpt_that_ends_with_a_line_end_stays_whole(spark):
    line = "a.b" * 59 + "cd\n"
    got = spark.createDataFrame([(line + "more",)], "t string").select(markdown.sentence_cut(F.col("t"), 180, ".!?").alias("t")).first().t
    assert len(line) == 180 and got == line + "…"


def test_of_a_large_vocabulary_only_rare_tokens_are_shuffled(spark, monkeypatch):
    rows = [(i, f"all all two{i // 2} eight{i // 8} one{'abcdefghijklmnopqrst'[i]}".translate(str.maketrans("0123456789", "abcdefghij"))) for i in range(20)]
    docs = spark.createDataFrame([*rows, (20, None), (21, "")], "doc_id long, text string")
    want = sorted(map(tuple, retrieval.indexed(docs).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 5)
    got = retrieval.indexed(docs)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 60
    # the parts that postings were dealt to by token, all of them
    assert "_part" not in got._jdf.queryExecution().toString()
    for most, cut in ((14, 1), (13, 4), (4, 4), (3, 8), (1, 16), (0, 32)):
        monkeypatch.setattr(retrieval, "BROADCAST_ROWS", most)
        assert retrieval.common_from(got.select("token", "df").distinct()) == cut, most


def test_what_touches_an_address(spark):
    texts = ["\u00bda@b.org", "a@b.org\u2460", "\u00b2a@b.org", "中a@b.org", "e\u0301a@b.org", "a@b.org\u0301", "a@b.org\u200d x", "a@b.org%%%", "%%%a@b.org", "a@b.org.", "a@b.org_", "x@a@b.org"]
    address = re.compile(r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\w.-])")  # as it reads where \w is a letter, number or _
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    want = [len(address.findall(t)) for t in texts]
    assert want == [0, 0, 0, 0, 1, 1, 1, 1, 1, 0, 0, 1]
    got = rows.select(text.private_counts(F.col("body"))["email"].alias("n"), text.transformations(F.col("body"))["email"].alias("m"), text.sanitised(F.col("body")).alias("t")).orderBy("i").collect()
    assert [(r.n, r.m, r.t) for r in got] == [(n, n, address.sub(text.MASK["email"], t)) for n, t in zip(want, texts)]
    assert {r.pattern: r["count"] for r in privacy.findings(rows).collect()}["email"] == {r.pattern: r["count"] for r in privacy.changes(rows).collect()}["email"] == sum(want)


def test_private_use_characters_stay(spark):
    raw = "\ue000 a\ue000AI/b /home/u/AI/x.md /home/u/AI/K/y /home/u/\ue000AI/z /home/u/AI/AI/k /Users/u"
    got = spark.createDataFrame([(raw,)], "t string").select(text.sanitised(F.col("t"), ("AI/K/", "AI/")).alias("a"), text.sanitised(F.col("t")).alias("b")).first()
    assert got.a == "\ue000 a\ue000AI/b x.md y \ue000AI/z AI/k /Users/u"
    assert got.b == "\ue000 a\ue000AI/b AI/x.md AI/K/y \ue000AI/z AI/AI/k /Users/u"


def test_op7_gives_what_is_kept(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(60))  # 409 bytes
    d = put(spark, tmp_path, "documents", [(1, "é one " + passage + " end"), (2, "two " + passage + "\nfin ü"), (3, "three " + passage[:380]), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in llm.QUERIES["op7_substring_dedup"](spark, d).collect()}
    assert {i: r.text for i, r in got.items()} == {1: "é one end", 2: "two\nfin ü", 3: "three " + passage[:380], 4: ""}
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 and len(r.text.encode()) == r.n_bytes - r.n_removed for r in got.values())


def test_op7_finds_passages_of_over_50_words_too(spark, tmp_path):
    # 335 bytes of 56 words after words of each document's own, but for their last "39 ": no string of 400 bytes occurs twice but in the last two
    passage = " ".join(f"w{i:04}" for i in range(56))
    own = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    texts = [f"{own[0]} {passage} end", f"{own[1]} {passage}\nfin", own[2], f"{own[3]} {passage[:290]}", f"{own[4]} {passage * 2}", f"{own[5]} {passage * 2}"]
    d = put(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in llm.QUERIES["op7_substring_dedup"](spark, d).collect()}
    assert [got[i].n_removed for i in range(6)] == [0, 0, 0, 0, 673, 673]
    assert [got[i].n_in_passages for i in range(6)] == [338, 338, 0, 0, 673, 673]
    assert all(passage not in got[i].text_without_passages for i in (0, 1, 4, 5)) and all(got[i].text_without_passages == texts[i] for i in (2, 3))


def test_passages_and_longer_strings_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab é,\n日") for _ in range(1500)) for _ in range(4)]
    texts = []
    for _ in range(60):  # pieces of a few texts, at all lengths about the two
        parts = [rng.choice(base)[(at := rng.randrange(1300)) : at + rng.randrange(20, 420)] for _ in range(rng.randrange(1, 5))]
        texts.append((f" {len(texts)} " if rng.random() < 0.5 else "").join(parts))
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, texts[1]), (70, None), (71, "")]
    raw = [(t or "").encode() for _, t in rows]
    want = {}
    for n in (400, 300):
        seen = Counter(x[i : i + n] for x in raw for i in range(len(x) - n + 1))
        for x in raw:
            gone = {j for i in range(len(x) - n + 1) if seen[x[i : i + n]] > 1 for j in range(i, i + n)}
            want[x, n] = len(gone), sum(j - 1 not in gone for j in gone), bytes(b for j, b in enumerate(x) if j not in gone)
    got = substrings.cut(spark.createDataFrame(rows, "doc_id long, text string"), 400, 300).collect()
    key = lambda x: (x[0] is None, *x)
    shown = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_in_passages, r.text_without_passages) for r in got]
    full = [(i, len(x), *want[x, 400][:2], hashlib.sha256(want[x, 400][2]).hexdigest(), want[x, 300][0], want[x, 300][2].decode("utf-8", "ignore")) for (i, _), x in zip(rows, raw)]
    assert sorted(shown, key=key) == sorted(full, key=key)
    assert sum(r.n_removed > 0 for r in got) and sum(r.n_in_passages > r.n_removed for r in got) and sum(r.n_removed == 0 for r in got)
