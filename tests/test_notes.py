"""Markdown notes, policy rules, list repair, limiters and ranking on small inputs with known results."""

import random

from pyspark.sql import functions as F

from tessellate.functions import html, policy
from tessellate.functions import markdown as M
from tessellate.functions import text as T
from tessellate.operators import limiters, lists, ranking
from tessellate.config import Retrieval


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


def test_notes(spark):
    note = '---\ntitle: "A b"\nkind: x\nkind: y\n---\n# Head 一\ntext [[a/b.md|Label]] and [[c/d.MD]] **bold**\n## 经方，针灸 x'
    assert one(spark, note, M.front_matter) == {"title": "A b", "kind": "y"}
    assert one(spark, "no block", M.front_matter) == {} and one(spark, "", M.front_matter) == {}
    assert one(spark, note, M.title) == "Head 一" and one(spark, note, M.keywords) == ["经方", "针灸"]
    assert one(spark, note, M.body).startswith("# Head")
    assert one(spark, "[[a/b.md|Label]] [[c/d.MD]] **bold** `x`", M.plain) == "Label d bold x" and one(spark, None, M.plain) == ""
    assert one(spark, "一\n" + "=" * 80 + "\n\n" + "=" * 90 + "\n二", M.subfiles) == ["一", "二"]
    assert one(spark, "句。" * 100, M.sentence_cut) == "句。" * 90 + "…" and one(spark, "短", M.sentence_cut) == "短"
    assert one(spark, "中" * 100, M.readable) and not one(spark, "中" * 99, M.readable) and not one(spark, "a" * 200, M.readable) and one(spark, None, M.readable) is False
    assert not one(spark, "中" * 120 + "机器转换，待校对", M.readable)
    assert one(spark, "资料认为急症优先用针灸，其他", M.modest_claims) == "资料认为资料中的相关学习观点，其他".replace("认为资料", "资料", 1)


def test_sections(spark):
    text = "前言\n主星之紫微星\\\n内容一\n\n禄存星\n内容二"
    assert [tuple(r) for r in one(spark, text, M.sections)] == [("", "前言"), ("紫微星", "主星之紫微星\\\n内容一"), ("禄存星", "禄存星\n内容二")]
    assert [tuple(r) for r in one(spark, "a\nb", M.sections)] == [("", "a\nb")] and one(spark, None, M.sections) == []


def test_evidence_and_concepts(spark):
    assert one(spark, "x" * 50 + "经方" + "y" * 50, lambda c: M.evidence(c, F.array(F.lit("无"), F.lit("没有"), F.lit("经方")))) == "..." + "x" * 40 + "经方" + "y" * 40 + "..."
    assert one(spark, "abc", lambda c: M.evidence(c, F.array(F.lit("zz")))) == "abc..." and one(spark, None, lambda c: M.evidence(c, F.array(F.lit("zz")))) == ""
    assert one(spark, "人纪与天纪", lambda c: M.concepts(c, [["经方", "针灸"], ["人纪", "天纪"]])) == ["人纪", "天纪"]


def test_policy(spark):
    stopped = {"我失眠怎么办": "person", "发烧怎么办": "fever", "昏迷了": "always", "咳嗽吃什么": "symptom", "当归能吃吗": "use", "剂量多少": "context", "学习麻黄汤怎么治": "treatment"}
    for text, rule in stopped.items():
        assert one(spark, text, policy.request_rule) == rule, text
    for text in ("经方学习的顺序是什么", "学习剂量的意义", "天纪讲什么", "", None):
        assert one(spark, text, policy.request_rule) is None, text
    assert one(spark, "每日 3 克", policy.answer_stopped) and not one(spark, "桂枝三两", policy.answer_stopped) and one(spark, None, policy.answer_stopped) is False
    assert one(spark, "急救", policy.refusal) == policy.EMERGENCY_REFUSAL and one(spark, "剂量", policy.refusal) == policy.REFUSAL


def test_list_repair():
    assert lists.renumbered("1. a\nnote\n1. b\n2. c") == "1. a\nnote\n2、 b\n3. c"
    assert lists.renumbered("1. a\n1. b\n# h\n1. c") == "1. a\n2. b\n# h\n1. c"
    assert lists.renumbered("1. a\n```\n1. x\n```\n1. b") == "1. a\n```\n1. x\n```\n1. b"
    assert lists.renumbered("1. a\n  1. s\n1. b\n  1. t") == "1. a\n  1. s\n2. b\n  1. t" and lists.renumbered("") == ""


def test_limiters(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.randrange(400), rnd.random() < 0.5) for i in range(400)]
    asked = spark.createDataFrame(rows, "event_id long, user_id string, ms long, ok boolean")
    got = {r.event_id: r.verdict for r in limiters.limited(asked, limiters.two_windows(3, 20, 50)).collect()}
    for key in ("a", "b", None):
        own = sorted((ms, i) for i, k, ms, _ in rows if k == key)
        start, count, total = own[0][0], 0, 0
        for ms, i in own:
            if ms > start + 50:
                start, count = ms, 0
            want = "minute_limit" if count >= 3 else "day_limit" if total >= 20 else "ok"
            count, total = count + (want == "ok"), total + (want == "ok")
            assert got[i] == want
    step, state, seen = limiters.breaker(2, 100), (), []
    for now, ok in ((0, True), (1, False), (2, False), (50, True), (102, False), (150, True), (202, True), (203, False)):
        state, verdict = step(state, now, ok)
        seen.append(verdict)
    assert seen == ["ok", "ok", "ok", "open", "probe", "open", "probe", "ok"]


def test_han_ranking(spark):
    chunks = [
        (1, "g", "总论", "", "经方 针灸 本草 经方"), (2, "g", "目录", "", "目录 紫微星 经方 针灸"), (3, "h", "紫微", "紫微星", "紫微星 坐命 经方"),
        (4, "h", "紫微", "紫微星", "紫薇星 在命宫"), (5, None, "x", None, None), (6, "h", "紫微", "紫微星", "紫微星 坐命 经方"),
    ]
    asked = [("q1", "经方 针灸"), ("q2", "紫薇星"), ("q3", "hello"), ("q4", None)]
    made = spark.createDataFrame(chunks, "chunk_id int, source_group string, chunk_title string, section_title string, content string")
    got = ranking.ranked(made, spark.createDataFrame(asked, "query_id string, query string"), 5, Retrieval(min_score=0.0, min_terms=2)).collect()
    by = {q: [r.chunk_id for r in sorted(got, key=lambda r: r.position) if r.query_id == q] for q, _ in asked}
    assert by["q3"] == by["q4"] == [] and by["q2"] == [3] and by["q1"][0] == 1 and 2 not in by["q1"]


def test_paths_and_links_of_every_form(spark):
    clean = lambda text: one(spark, text, lambda c: T.sanitised(c, ("AI/人生知识库/", "AI/")))
    assert clean("/Users/e/AI/人生知识库/资料/a.md，/home/bob/AI/b /home/bob/") == "资料/a.md，b "
    assert clean("/Users/bob 与 /home/bob") == "/Users/bob 与 /home/bob"
    for text in ("/Users/bob", "/home/bob/", "/home/bob/x/y", "见/Users/a/b。"):
        assert one(spark, text, T.private_counts)["local_path"] == 1
    assert clean("[ [路径/笔记[一] .md|别名] ]") == "别名"
    assert clean("[[资料/阴阳|阴阳]] ![[资料/五行.md]] [ [资料/伤寒论.md|伤寒论]]") == "阴阳 五行 伤寒论"
    assert clean("[ [DSR] | 伤寒论]]") == "伤寒论" and clean("[ [DSR] | 伤寒论]") == "[DSR] | 伤寒论]"
    assert clean("[[a/b.MD#节 一]] [[#节]] [[a/ # h]] [[/]] [[]] [[a|b|c ]]") == "b · 节 一 节 a · h /  c"
    assert clean("[[x]] 1 [[y") == "x 1 [y" and clean("![[p]]]") == "p]"
    assert clean("[[a\nb]]") == "[a\nb]" and clean(None) is None and clean("") == ""
    counts = one(spark, "/home/b/x [[a]] [[b", T.transformations)
    assert (counts["local_path"], counts["wikilink"]) == (1, 2)


def test_forbidden_elements_that_claim_to_be_closed():
    assert html.clean("<script/>alert(1)</script>a<style/>p{}</style>b<embed/>c<iframe/>d</iframe>e") == "abce"
    assert html.clean("a<script/>never closed <b>x</b>") == "a"


def test_sanitised(spark):
    from tessellate.functions import text as T

    raw = "/home/me/AI/x/a.md [[p/b.md|名]] [[p/c.md#节]] ![[d]] [ [e 地址：某某路十二号"
    assert one(spark, raw, lambda c: T.sanitised(c, ("AI/",))) == "x/a.md 名 c · 节 d [e 地址：[已脱敏地址]"
    assert one(spark, "北京市海淀区中关村大街1号", T.redacted) == "[已脱敏地址]" and one(spark, None, T.sanitised) is None
    assert one(spark, "某某市人民医院", T.private_counts)["institution"] == 1


def test_sinks(spark, tmp_path):
    from tessellate.sources import sinks

    docs = spark.createDataFrame([(1, "a b a", "x"), (2, "a c", "y"), (3, None, None)], "doc_id long, text string, source_group string")
    made = sinks.index_sink(docs, str(tmp_path / "i"))
    kept = made.part("postings").select("token", F.inline("docs")).join(made.part("terms"), "token")
    assert sorted(map(tuple, kept.select("token", "doc", "tf", "df").collect())) == [("a", 1, 2, 2), ("a", 2, 1, 2)]
    sinks.corpus_sink(docs, str(tmp_path / "c"))
    sinks.report_sink(docs, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "r")).count() == 3
    assert {r.doc_id for r in sinks.without(docs, spark.createDataFrame([(2,)], "doc_id long"), "doc_id").collect()} == {1, 3}
    new = spark.createDataFrame([(2, "n", "y"), (4, "m", "z")], docs.schema)
    assert {r.doc_id: r.text for r in sinks.upserted(docs, new, "doc_id", "source_group").collect()} == {1: "a b a", 2: "n", 3: None, 4: "m"}
