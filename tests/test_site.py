"""Requests, pages, graphs and reports on cases that the tables don't hold."""

import json

from pyspark.sql import functions as F

from tessellate.config import Limits
from tessellate.functions import html
from tessellate.functions import text as T
from tessellate.operators import graph, privacy, requests, traffic
from tessellate.sources import sinks, tables
from tessellate.streaming import counters


def test_intake(spark):
    u, a = ("user", "q"), ("assistant", "a")
    cases = [
        (None, " hi ", None), ("s", None, None), (None, " ", None), (None, "x" * 2001, None), (None, None, []), (None, None, [("system", "x")]), (None, None, [(None, "x")]), (None, None, [u, ("assistant", None)]),
        (None, None, [("user", "x" * 2001)]), (None, None, [u, u]), (None, None, [u, a]), (None, None, [u, a] * 6 + [u]),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, session_id string, message string, messages array<struct<role:string,content:string>>")
    got = {r.i: r for r in requests.checked(rows, Limits()).collect()}
    assert [got[i].error for i in range(len(cases))] == [None, "no_message", "empty", "too_long", "empty", "bad_role", "bad_role", "empty_content", "too_long", "not_alternating", "last_not_user", None]
    assert [tuple(m) for m in got[0].messages] == [("user", "hi")] and got[0].session_id == "anon" and got[1].session_id == "s"
    assert len(got[11].messages) == 12 and got[11].messages[0].role == "assistant"
    body = json.loads(requests.checked(rows).filter("i = 0").select(requests.payload(F.col("messages"), "a", F.col("session_id"))).first()[0])
    assert body == {"assistant_id": "a", "user_id": "anon", "stream": False, "messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}]}]}


def test_cleaning_html():
    assert html.clean('<p onclick="x()" class="a">b &amp; c&#39;</p>') == '<p class="a">b &amp; c&#39;</p>'
    assert html.clean("<script>if (a < b) alert('</p>')</script>x<style>p{}</style><IFRAME src='http://a.b'>in<b>side</b></IFRAME>y") == "xy"
    assert html.clean('<a href="JavaScript:alert(1)">l</a><a href="https://a.b/?c=1&amp;d">m</a><img src="mailto:x@y"><img src="http://a.b/c.png"/>') == '<a>l</a><a href="https://a.b/?c=1&amp;d">m</a><img><img src="http://a.b/c.png"/>'
    assert html.clean('<a href="java\nscript:x" style="a" title="t">l</a><object data=x><p>gone</object>z<embed src="http://a">') == '<a title="t">l</a>z'
    assert html.clean("") == "" and html.clean("a <b") in ("a ", "a <b")


def test_markdown():
    text = "# Head\n\n1. one\n2. **two**\n- x `a*b*` y\ntext <b> *em* [l](https://a.b?c&d) [m](javascript:x)\n```\n1. code <\n```"
    assert html.rendered(text).split("\n") == [
        '<div class="heading">Head</div>', "<ol>", "<li>one</li>", "<li><strong>two</strong></li>", "</ol>", "<ul>", "<li>x <code>a*b*</code> y</li>", "</ul>",
        '<p>text &lt;b&gt; <em>em</em> <a href="https://a.b?c&amp;d" target="_blank" rel="noopener">l</a> m</p>', "<pre><code>1. code &lt;</code></pre>",
    ]


def test_udfs_keep_null(spark):
    rows = spark.createDataFrame([(None,), ("<p style='x'>a",)], "t string")
    assert [r[0] for r in rows.select(html.cleaned(F.col("t"))).collect()] == [None, "<p>a"]
    assert [r[0] for r in rows.select(html.from_markdown(F.col("t"))).collect()][0] is None


def test_paragraphs(spark):
    text = "a\n b \n\n  \n- x\n- y\nz\n# h\n> q\nlast\n"
    assert spark.createDataFrame([(text,), (None,), ("",)], "t string").select(T.paragraphs(F.col("t"))).collect() == [(["a\nb", "- x", "- y", "z", "# h", "> q", "last"],), ([],), ([],)]


def test_privacy_report(spark):
    files = spark.createDataFrame([("电话 13812345678 [已脱敏手机号] 姓名：张三丰",), ("看 /home/me/notes/a.md 与 [[b|c]]，协和医院",), (None,)], "body string")
    found = {r.pattern: r for r in privacy.findings(files).collect()}
    assert (found["mobile"]["count"], found["mobile"].files, found["mobile"].severity) == (1, 1, "high")
    assert (found["name_label"]["count"], found["name_label"].severity, found["institution"]["count"], found["local_path"]["count"]) == (1, "medium", 1, 1)
    assert privacy.summary(privacy.findings(files)).first() == (2, 2, "blocked")
    assert privacy.summary(privacy.findings(files.limit(0))).first() == (0, 0, "pass")
    changed = {r.pattern: r["count"] for r in privacy.changes(files).collect()}
    assert changed["wikilink"] == 1 and changed["mobile"] == 1 and changed["email"] == 0


def test_json_readers(spark, tmp_path):
    assert tables.knowledge_base(spark, f"{tmp_path}/none.json").count() == 0 and tables.stored_index(spark, f"{tmp_path}/none.json").count() == 0
    assert {k: v.count() for k, v in tables.site_graph(spark, f"{tmp_path}/none.json").items()} == {"items": 0, "layers": 0, "stats": 0, "public_sources": 0}
    (tmp_path / "kb.json").write_text(json.dumps({"chunks": [{"id": "a", "content": "x", "keywords": ["k"]}, {"id": "b", "section_title": "s"}]}))
    assert [(r.doc, r.id, r.section_title) for r in tables.knowledge_base(spark, f"{tmp_path}/kb.json").orderBy("doc").collect()] == [(0, "a", None), (1, "b", "s")]
    (tmp_path / "index.json").write_text(json.dumps({"total_docs": 2, "doc_lengths": [5, 7], "inverted_index": {"t": [0, 2, 1, 1], "u": [1, 3]}}))
    assert sorted(map(tuple, tables.stored_index(spark, f"{tmp_path}/index.json").collect())) == [("t", 0, 2, 2, 5), ("t", 1, 1, 2, 7), ("u", 1, 3, 1, 7)]
    graph_file = {"layers": ["l"], "stats": {"public_sources": 1}, "nodes": [{"id": "a", "title": "A", "node_links": [{"path": "b"}, {"path": "a"}, {"path": "x"}, {}]}], "articles": [{"id": "b", "sections": {"k": "v"}}], "public_sources": [{"path": "p", "readable": True}, {"path": "q", "readable": False}]}
    (tmp_path / "graph.json").write_text(json.dumps(graph_file))
    found = tables.site_graph(spark, f"{tmp_path}/graph.json")
    assert sorted((r.kind, r.at, r.id) for r in found["items"].collect()) == [("articles", 0, "b"), ("nodes", 0, "a")]
    assert [tuple(r) for r in graph.links(found["items"]).collect()] == [("a", "b")]
    assert graph.consistency(found["public_sources"], found["stats"]).first() == (2, 1, "stats=1, found=2")
    whole = spark.read.json(f"{tmp_path}/graph.json", multiLine=True).withColumn("stats", F.struct(F.lit(1).alias("public_sources"), F.lit(9).alias("other"))).withColumn("generated_at", F.lit("then"))
    again = sinks.restated(whole, found["public_sources"], "now").first()
    assert (again.stats.public_sources, again.stats.public_sources_readable, again.stats.other, again.generated_at, len(again.public_sources)) == (2, 1, 9, "now", 2)


def test_corpus_skips_what_is_not_text(spark, tmp_path):
    (tmp_path / "a.md").write_text("good")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe\x00bad")
    assert [r.name for r in tables.corpus(spark, str(tmp_path), glob="*.md").collect()] == ["a"]


def test_manifest(spark):
    schema = "file_count int, total_bytes long, files array<struct<filename:string,bytes:long,sha256:string>>"
    good, bad = (1, 3, [("a", 3, "0" * 64)]), (2, 4, [("a", 3, "0" * 64), ("a", 3, "x")])
    assert tables.manifest_problems(spark.createDataFrame([good], schema)).count() == 0
    assert {r.problem for r in tables.manifest_problems(spark.createDataFrame([bad], schema)).collect()} == {"total_bytes", "repeated filename", "sha256"}
    assert "no files" in {r.problem for r in tables.manifest_problems(spark.createDataFrame([(0, 0, None)], schema)).collect()}


def test_report_leaves_out_an_unvisited_local_site(spark):
    counts = spark.createDataFrame([("d", "cn", 10, 3), ("d", "overseas", 2, 1), ("e", "local", 1, 1)], "day string, site string, pv long, uv long")
    text = {r.day: r.text.split("\n") for r in traffic.report_text(traffic.by_site(counts, counts)).collect()}
    assert len(text["d"]) == 8 and "UV 4 · PV 12" in text["d"][3] and len(text["e"]) == 9 and "UV 0 · PV 0" in text["e"][3]


def test_page_view_stream(spark, tmp_path):
    lines = [{"type": "pageview", "site": " CN ", "path": "graph", "vid": "visitor-1", "t": 1}, {"type": "other", "site": "cn", "vid": "visitor-1"}, {"type": "pageview", "site": "mars", "vid": "visitor-1"}, {"type": "pageview", "site": "cn", "vid": "short"}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json")
    views = counters.page_views(spark, str(tmp_path), ("cn",))
    run = views.writeStream.format("memory").queryName("views").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    run.awaitTermination(120)
    assert [(r.site, r.path, r.vid) for r in spark.table("views").collect()] == [("cn", "/graph", "visitor-1")]


def test_titles_by_collation(spark):
    items = spark.createDataFrame([(1, "本经针", "x"), (2, "本经阴", "x"), (3, "伤寒论讲", None)], "node int, title string, definition string")
    assert [r.node for r in graph.alias_search(items, "本经", graph.ALIASES).collect()] == [1, 2]
    assert [(r.node, r.score) for r in graph.alias_search(items, "SHL", graph.ALIASES).collect()] == [(3, 450)]
    assert graph.alias_search(items, "本经", {}, collation="zh").count() == 2


def test_streamed_and_freshest(spark):
    pieces = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 2, "b"), (2, 1, None)], "answer_id int, seq int, piece string")
    assert sorted(map(tuple, requests.streamed(pieces).collect())) == [(1, "ab"), (2, "")]
    late = spark.createDataFrame([(1, 3, "new"), (1, 2, "old")], "conv_id int, seq int, text string")
    assert [r.text for r in requests.freshest(late).collect()] == ["new"]
