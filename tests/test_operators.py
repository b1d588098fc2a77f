"""Cases that the tables don't hold."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessellate.config import Chunks, Limits
from tessellate.functions import text as T
from tessellate.operators import chunking, conversation, feedback, graph, retrieval, traffic
from tessellate.sources import tables
from tessellate.streaming.counters import daily_views


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_han_tokens_keep_repeats(spark):
    assert one(spark, "经方，针灸学", T.han_tokens) == ["经方", "经方", "针灸学", "针灸", "灸学", "针灸学"]
    assert one(spark, "一二三四五 abc", T.han_tokens) == ["一二", "二三", "三四", "四五", "一二三", "二三四", "三四五"]
    assert one(spark, None, T.han_tokens) == []


def test_redaction(spark):
    assert one(spark, "电话 13812345678 与 a.b@c.org", T.redacted) == "电话 [已脱敏手机号] 与 [已脱敏邮箱]"
    assert one(spark, "姓名：　张三丰\r\n病历号 AB-1234", T.redacted) == "姓名：[已脱敏姓名]\n病历号：[已脱敏病历号]"
    assert one(spark, "a@b.com是", T.redacted) == "a@b.com是"  # a letter of any script touches it


def test_clean_path(spark):
    assert one(spark, " graph ", T.clean_path) == "/graph"
    assert len(one(spark, "x" * 300, T.clean_path)) == 201


def test_sliding_edges(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, i, start + timedelta(milliseconds=ms)) for i, ms in enumerate([0, 59_999, 60_000])]
    got = traffic.sliding(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")).orderBy("event_id").collect()
    assert [r.in_window for r in got] == [1, 2, 2]


def test_anchored_window_restarts_at_next_request(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, i, start + timedelta(seconds=s)) for i, s in enumerate([50, 100, 109, 110, 115])]
    got = traffic.anchored(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp"), Limits(anchored_most=2)).orderBy("event_id").collect()
    assert [(r.hit, r.passed) for r in got] == [(1, True), (2, True), (3, False), (1, True), (2, True)]


def test_history(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "bot", "c"), (1, 4, "assistant", "d"), (1, 5, "user", "e"), (2, 0, "system", "x"), (3, 0, "user", " "), (4, 0, "user", "x" * 2001)], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.error for r in conversation.validated(turns).collect()} == {1: "non_alternating", 2: "illegal_role", 3: "empty_content", 4: "content_too_long"}
    assert sorted((r.turn, r.role, r.text) for r in conversation.repaired(turns).collect()) == [(1, "user", "a"), (4, "assistant", "d")]


def test_caps_and_copies(spark):
    hits = spark.createDataFrame([(1, i, "g", t) for i, t in enumerate("aabcdef", 1)] + [(1, 8, None, "z")], "query_id long, rank int, source string, text string")
    got = retrieval.capped(hits, 5, 4).orderBy("position").collect()
    assert [r.text for r in got] == ["a", "b", "c", "d", "z"]


def test_dangling_and_core(spark):
    links = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("a", "x"), ("b", None)], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    assert sorted(map(tuple, graph.dangling(links, nodes).collect()), key=str) == [("a", "a"), ("a", "x"), ("b", None)]
    edges = graph.undirected(links.filter("dst IN ('a', 'b')"))
    assert {r.node: r.degree for r in graph.degree(edges).collect()} == {"a": 1, "b": 1}
    many = spark.createDataFrame([(f"n{i:02}", True) for i in range(25)], "node string, explicit boolean")
    assert graph.core_tier(many, graph.degree(edges)).count() == 25


def test_corpus_source(spark, tmp_path):
    (tmp_path / "one.txt").write_text("甲", encoding="utf-8")
    rows = tables.corpus(spark, str(tmp_path), ["one"])
    assert rows.first().body == "甲"
    try:
        tables.corpus(spark, str(tmp_path), ["one", "two"])
    except ValueError as e:
        assert "two" in str(e)
    else:
        raise AssertionError
    manifest = spark.createDataFrame([("one", 4, "x"), ("two", 1, "x")], "filename string, bytes long, sha256 string")
    assert {r.filename: r.reason for r in tables.violations(rows, manifest).collect()} == {"one": "size", "two": "missing"}


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1, 15, 0)
    rows = spark.createDataFrame([(i, start + timedelta(hours=i), i % 3, "cn") for i in range(30)], "event_id long, ts timestamp, user_id long, event_type string")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = daily_views(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = daily_views(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))


def test_chunks(spark):
    cut = lambda text: one(spark, text, lambda c: chunking.chunks(c, Chunks(least=6, most=10)))
    assert cut("") == cut(" \n\n ") == cut(None) == []
    assert cut("aaa\n\nbbb\n\n\nccc") == ["aaa\n\nbbb", "ccc"]
    assert cut("aaaaaaa\n\nbb") == ["aaaaaaa\n\nbb"]  # the short end joins
    assert cut("ab\n\n一二三四五。六七八九十！末了。") == ["ab", "一二三四五。", "六七八九十！末了。"]
    assert cut("x" * 30) == ["x" * 30]  # no sentence end to cut at
    assert cut("一二三四五六七。八九十。\n\nab") == ["一二三四五六七。", "八九十。\n\nab"]


def test_chunked_table(spark):
    docs = spark.createDataFrame([(1, "a" * 1500 + "\n\n" + "b" * 1500, 0), (2, None, 0), (3, "", 0), (None, "c", 0)], "doc_id int, text string, chunk_index int")
    assert sorted(((r.doc_id or 0, r.chunk_index, r.content_length) for r in chunking.chunked(docs).collect())) == [(0, 0, 1), (1, 0, 1500), (1, 1, 1500)]


def test_knowledge_of_files(spark):
    line = "=" * 80
    body = f'---\nlearning_use: "x"\n---\n文件：a/b.md\n\n---\nk: v\n---\n前言\n## 紫微星\\\n甲乙。\n{line}\n  \n{line}\n文件：only/a/name.md\n\n{line}\n文字\n文件：c.md\n\n说明\n{line}==\nno title here'
    files = spark.createDataFrame([("f", body), ("g", None), ("h", ""), ("i", "# 经方，针灸\n" + "字" * 2500)], "name string, body string")
    got = sorted((r.name, r.subfile_index, r.chunk_index, r.subfile, r.chunk_title, r.section_title, r.learning_use, r.content, tuple(r.keywords)) for r in chunking.knowledge(files).collect())
    assert got[:-1] == [
        ("f", 0, 0, "a/b.md", "紫微星\\", "", "x", "---\nk: v\n---\n前言", ()), ("f", 0, 1, "a/b.md", "紫微星", "紫微星", "x", "## 紫微星\\\n甲乙。", ("紫微星",)),
        ("f", 1, 0, "only/a/name.md", "only/a/name.md", "", "x", "文件：only/a/name.md", ()), ("f", 2, 0, "c.md", "c.md", "", "x", "文字\n说明", ()), ("f", 3, 0, "子文件4", "子文件4", "", "x", "no title here", ()),
    ]
    assert [(g[0], g[2], len(g[7]), g[8]) for g in got[-1:]] == [("i", 0, 2508, ("经方", "针灸"))]


def test_short_page(spark):
    cases = {"https://a.org/x?q=1#/graph": "#/graph", "https://a.org/x#/": "/x", "https://a.org/": "", "https://a.org": "", "#/": "", " #/map ": "#/map", "/p": "/p", "words": "", None: ""}
    assert {k: one(spark, k, T.short_page) for k in cases} == cases


def test_site_of(spark):
    sites = {"cn": ("cloud.test", "=own.test"), "local": ("=localhost",)}
    for url, site in {"https://A.Cloud.test:80/x": "cn", "https://own.test/": "cn", "https://not-own.test": "abroad", "http://localhost:8080/": "local", "": "abroad"}.items():
        assert one(spark, url, lambda c: T.site_of(c, sites, "abroad")) == site


def test_feedback(spark):
    rows = spark.createDataFrame([(1, " \n", None, "p"), (2, "x" * 2001, "bug", "p"), (3, " ok ", "y" * 30, "z" * 600)], "id int, content string, category string, page string")
    got = feedback.checked(rows, ("bug",)).orderBy("id").collect()
    assert [r.error for r in got] == ["content_required", "content_too_long", None]
    assert [r.category for r in got] == ["其他", "bug", "y" * 20]
    assert (got[2].content, len(got[2].page)) == ("ok", 500)


def test_admission(spark):
    rows = spark.createDataFrame([(" CN ", None, " visitor-1 "), ("cn", "x", "short"), ("else", "x", "visitor-1")], "site string, path string, vid string")
    assert [tuple(r) for r in traffic.admitted(rows, ("cn",)).collect()] == [("cn", "/", "visitor-1")]
