"""Link graphs: edges, integrity, degree, core tier, ranked title search."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How titles are typed in Latin letters.
ALIASES = {
    "shanghanlun": "伤寒论", "shl": "伤寒论", "huangdineijing": "黄帝内经", "hdnj": "黄帝内经", "jinguiyaolue": "金匮要略", "jgyl": "金匮要略",
    "shennongbencaojing": "神农本草经", "snbcj": "神农本草经", "guizhitang": "桂枝汤", "gzt": "桂枝汤", "mahuangtang": "麻黄汤", "mht": "麻黄汤",
    "xiaochaihutang": "小柴胡汤", "xcht": "小柴胡汤", "wulingsan": "五苓散", "wls": "五苓散", "ziweidoushu": "紫微斗数", "zwds": "紫微斗数",
    "yijing": "易经", "yj": "易经", "zhenjiu": "针灸", "zj": "针灸",
}


def undirected(links: DataFrame) -> DataFrame:
    """Distinct unordered edges (a, b) of links (src, dst), loops left out."""
    return links.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """(node, neighbour) for the nodes of focus (node): what is one undirected edge away."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("neighbour")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("neighbour")))
    return both.join(focus.select("node").distinct(), "node", "left_semi")


def dangling(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose target is null, unknown or the source itself."""
    known = nodes.select(F.col("node").alias("dst"))
    return links.filter("src = dst").unionByName(links.filter("dst IS NULL OR src <> dst").join(known, "dst", "left_anti").select("src", "dst"))


def core_tier(nodes: DataFrame, degrees: DataFrame, want: int = 20, least: int = 5) -> DataFrame:
    """nodes (node, explicit): explicit ones are core; while they are under want, the best-linked others fill up.

    Only the best `want` of the others can matter, so they are found by top-k, not by a global window.
    """
    have = nodes.filter("explicit").limit(want).count()
    rows = nodes.join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    fill = rows.filter((~F.col("explicit")) & (F.col("degree") >= least)).orderBy(F.desc("degree"), "node").limit(max(0, want - have))
    return rows.filter("explicit").unionByName(fill).select("node", "explicit", "degree")


def title_score(title, query):
    """Exact 1000, prefix 800, inside 600 less its place (40 at most), else -1."""
    t, q = F.lower(title), F.lower(query)
    at = F.instr(t, q) - 1
    return F.when(t == q, 1000).when(t.startswith(q), 800).when(at >= 0, 600 - F.least(at, F.lit(40))).otherwise(-1)


def search(titles: DataFrame, query: str, limit: int = 8) -> DataFrame:
    return titles.withColumn("score", title_score(F.col("title"), F.lit(query)).cast("long")).filter("score >= 0").orderBy(F.desc("score"), "title", "node").limit(limit)


def first_titles(items: DataFrame) -> DataFrame:
    """One row for each title: the least position wins, before anything is shuffled."""
    whole = F.struct(*(c for c in items.columns))
    return items.groupBy(F.col("title").alias("_t")).agg(F.min_by(whole, "position").alias("_r")).select("_r.*")


def resolved(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Titles of a list column (titles) joined to items (title, position, ...), places kept; unknown titles go, the first of equal items wins."""
    named = lists.select("*", F.posexplode("titles").alias("place", "title")).drop("titles").withColumn("place", F.col("place") + 1)
    return named.join(first_titles(items), "title")


def links(items: DataFrame, view: DataFrame | None = None) -> DataFrame:
    """(src, dst) of items (id, node_links: array of path) whose target is another item of the view (id; all items if not given)."""
    seen = (items if view is None else view).select(F.col("id").alias("dst")).distinct()
    named = items.select(F.col("id").alias("src"), F.explode("node_links").alias("l")).select("src", F.col("l.path").alias("dst"))
    return named.filter("dst <> src").join(seen, "dst", "left_semi").select("src", "dst")


def both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) with both ends among nodes (node)."""
    known = nodes.select("node").distinct()
    return edges.join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")


def concept(items: DataFrame, layers: Sequence[str] = (), kinds: Sequence[str] = (), titles: Sequence[str] = (), inside: Sequence[str] = (), pattern: str | None = None) -> DataFrame:
    """Items of a concept: by layer, by kind (node_type), by title, by a word inside the title, or by a pattern of it."""
    title = F.coalesce("title", F.lit(""))
    tests = [F.col("layer").isin(*layers)] * bool(layers) + [F.col("node_type").isin(*kinds)] * bool(kinds) + [title.isin(*titles)] * bool(titles) + [F.contains(title, F.lit(w)) for w in inside] + ([title.rlike(pattern)] if pattern else [])
    return items.filter(reduce(lambda x, y: x | y, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False)))


def tagged(cards: DataFrame, tag: str) -> DataFrame:
    """Cards (tags) with a tag; all of them for `all`."""
    return cards if tag == "all" else cards.filter(F.coalesce(F.array_contains("tags", tag), F.lit(False)))


def highlighted(items: DataFrame, query: str) -> DataFrame:
    """Items whose title or definition holds the query, case aside; a blank query lights none."""
    q = F.lower(F.trim(F.lit(query)))
    found = F.contains(F.lower(F.coalesce("title", F.lit(""))), q) | F.contains(F.lower(F.coalesce("definition", F.lit(""))), q)
    return items.filter((q != "") & found)


def alias_search(items: DataFrame, query: str, aliases: Mapping[str, str], limit: int = 8, collation: str | None = None) -> DataFrame:
    """items (node, title, definition) by how well they meet a query, the best first.

    The title decides as in title_score; then an alias that holds the query and names a part of the title (450), then the
    definition (200 less the place, 80 at most). Ties go by title, in code point order or by a collation, then node.
    """
    q = query.lower()
    names = sorted({name for alias, name in aliases.items() if q in alias})
    title, definition = F.coalesce("title", F.lit("")), F.lower(F.coalesce("definition", F.lit("")))
    alias = F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower(title), n)) if names else F.lit(False)
    own = title_score(title, F.lit(q))
    at = F.instr(definition, F.lit(q)) - 1
    score = F.when(own >= 0, own).when(alias, 450).when(at >= 0, 200 - F.least(at, F.lit(80))).otherwise(-1)
    order = F.collate("title", collation) if collation else F.col("title")
    return items.withColumn("score", score.cast("long")).filter("score >= 0").orderBy(F.desc("score"), order, "node").limit(limit)


def preview(broken: DataFrame, most: int = 5) -> DataFrame:
    """(shown, more): the first links (src, dst) in order, and how many are left."""
    first = broken.orderBy("src", "dst").limit(most).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" -> ", "src", F.coalesce("dst", F.lit("?"))))), "; ").alias("shown"))
    return first.crossJoin(broken.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more")))  # one row each


def unsafe(items: DataFrame, key: str, value: str = "learning_only") -> DataFrame:
    """(id, problem) of items (id, medical_safety, sections: map) without the safety mark, or without the section `key`."""
    problems = F.array_compact(F.array(F.when(F.coalesce("medical_safety", F.lit("")) != value, "mark"), F.when(F.coalesce(F.try_element_at("sections", F.lit(key)), F.lit("")) == "", "section")))
    return items.select("id", F.explode(problems).alias("problem"))


def layered(items: DataFrame, layers: Sequence[str], other: str = "其他") -> DataFrame:
    """(position, layer, items): configured layers in order, empty ones too, then those present besides, by name."""
    known = items.sparkSession.createDataFrame(list(enumerate(layers)), "at int, layer string")
    counts = items.groupBy(F.coalesce(F.nullif("layer", F.lit("")), F.lit(other)).alias("layer")).agg(F.count("*").alias("items"))
    rows = counts.join(F.broadcast(known), "layer", "full")  # as many rows as layers are configured
    return rows.select(F.row_number().over(Window.orderBy(F.col("at").isNull(), "at", "layer")).alias("position"), "layer", F.coalesce("items", F.lit(0).cast("long")).alias("items"))


def consistency(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """(total, readable, error) of sources (readable) against the stored total (one row, public_sources)."""
    counts = sources.agg(F.count("*").alias("total"), F.count_if("readable").alias("readable"))
    return counts.crossJoin(stored.select("public_sources")).select("total", "readable", F.when(~F.col("public_sources").eqNullSafe(F.col("total")), F.format_string("stats=%d, found=%d", F.coalesce("public_sources", F.lit(0)), "total")).alias("error"))


def route(path: Column, patterns: Sequence[str]) -> Column:
    """(pattern, params) of the first pattern that a path or #path meets, exact ones first; `:name` takes a part. Null if none."""
    p = F.coalesce(F.nullif(F.regexp_replace(F.coalesce(path, F.lit("")), "^#", ""), F.lit("")), F.lit("/"))
    out = F.lit(None).cast("struct<pattern:string,params:map<string,string>>")
    for pattern in reversed(patterns):
        names = re.findall(r":(\w+)", pattern)
        if names:
            whole = "^" + "([^/]+)".join(re.escape(x) for x in re.split(r":\w+", pattern)) + "$"
            params = F.create_map(*(x for i, n in enumerate(names, 1) for x in (F.lit(n), F.regexp_extract(p, whole, i))))
            out = F.when(p.rlike(whole), F.struct(F.lit(pattern).alias("pattern"), params.alias("params"))).otherwise(out)
    none = F.create_map().cast("map<string,string>")
    return F.when(p.isin(*patterns), F.struct(p.alias("pattern"), none.alias("params"))).otherwise(out)


def importance(core: Column, up: Column, down: Column, layer: Column, said: Mapping[str, str], layers: Mapping[str, str], glue: str = "、") -> Column:
    """Sentences on why an item matters; said has core, both, up and down, with {up} and {down} for the joined titles."""
    titles = lambda names: F.coalesce(F.array_join(names, glue), F.lit(""))
    fill = lambda text: F.replace(F.replace(F.lit(text), F.lit("{up}"), titles(up)), F.lit("{down}"), titles(down))
    some_up, some_down = F.coalesce(F.size(up), F.lit(0)) > 0, F.coalesce(F.size(down), F.lit(0)) > 0
    place = F.when(some_up & some_down, fill(said["both"])).when(some_up, fill(said["up"])).when(some_down, fill(said["down"]))
    own = F.lit(None).cast("string")
    for name, text in layers.items():
        own = F.when(layer == name, text).otherwise(own)
    return F.concat_ws("\n", F.when(core, F.lit(said["core"])), place, own)
