"""A stored posting index, and rankings that read it and stop early without losing a row.

`write` tokenises the corpus once. Documents are put in order (by `by`, then length) and cut into blocks of BLOCK; a posting row
holds a token's documents of one block and the most that any of them adds to a score. Rows are dealt to buckets of their token
and sorted by token in a bucket's files, so a query reads the buckets of its tokens (partition pruning), and of these the row
groups whose bounds hold them. Layout of the folder: forward (documents by block), postings/bucket=, terms/bucket= (frequencies),
corpus (one row). It is built beside its place and renamed, so a reader sees a whole index or none.

`top` scores, for each query, the FIRST blocks of the highest bound: the sum of their tokens' most, which no document of theirs
exceeds. The last score among the best so far then rules out most of the rest. Blocks whose bound is less are not read. Of the
others only the query's heavier tokens are read at first: the lighter ones, whose most sum up to at most LIGHT of that score, can
add no more than that, so a document is done with if its heavier tokens and that sum don't reach it. The lighter tokens, which
have the longest lists, are then read for the documents that are left. Nothing that is skipped can be in the result or tie with it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Retrieval
from ..functions.text import four_places, words
from ..sources import shared
from . import retrieval

BUCKETS = 64
#: Documents of a block, a power of two.
BLOCK = 64
#: Blocks that a query visits first, and the share of the score to beat that tokens read last may add up to.
FIRST, LIGHT = 4, 0.5
#: Tokens (repeats counted) whose postings one task of the writing takes, about: what it sorts doesn't grow with the corpus.
TASK_TOKENS = 1 << 21
#: Rounding to four places can lift a score by so much.
HALF = 0.00005 + 1e-9
FORWARD, POSTINGS, TERMS, CORPUS = "forward", "postings", "terms", "corpus"


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def write(docs: DataFrame, path: str, settings: Retrieval = Retrieval(), least_df: int = 2, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ()) -> None:
    """Write the index of docs to path, which must not be there. by: columns that put like documents together, which makes bounds tight.

    Null and empty texts count as documents without a token. Keys must be unique.
    """
    spark = docs.sparkSession
    if shared.exists(spark, path):
        raise FileExistsError(path)
    made = f"{path}-{shared.place(spark, 'making').rsplit('-', 1)[1]}"
    tokens = F.coalesce(words(F.col(text)), F.array().cast("array<string>"))
    rows = retrieval.spread_out(docs.select(F.col(key).alias("doc"), text, *by)).withColumn("_dl", F.size(tokens))
    # shuffled to an order first, as texts, which are less than their counted tokens; numbered where they lie then: numbers are read
    # from the table, so they never change
    ordered = rows.repartitionByRange(*by, "_dl", "doc").sortWithinPartitions(*by, "_dl", "doc")
    retrieval.counted(ordered, tokens, "doc").select(F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1).alias("block"), "doc", "dl", "tf").write.parquet(f"{made}/{FORWARD}")
    forward = spark.read.parquet(f"{made}/{FORWARD}")
    total = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
    total.select("n", "total", F.coalesce(four_places(F.try_divide("total", "n")), F.lit(0.0)).alias("avgdl"), F.lit(settings.k1).alias("k1"), F.lit(settings.b).alias("b")).coalesce(1).write.parquet(f"{made}/{CORPUS}")
    corpus = spark.read.parquet(f"{made}/{CORPUS}").first()
    dealt = forward.select("block", "doc", "dl", F.explode_outer("tf").alias("t")).select("block", "doc", "dl", "t.token", "t.tf").filter("token IS NOT NULL")
    # a bucket is dealt to as many tasks as there are for it, so that no token's list is one task of many
    parts = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")), corpus.total // TASK_TOKENS)
    dealt = dealt.withColumns({"bucket": bucket(F.col("token")), "slice": F.pmod(F.xxhash64("block"), F.lit(-(-parts // BUCKETS)))})
    weight = retrieval.term_weight(settings, F.lit(corpus.avgdl))
    # one shuffle for the groups and for the files
    lists = dealt.repartition(parts, "bucket", "slice").groupBy("bucket", "slice", "token", "block").agg(F.max(weight).alias("most"), F.count("*").alias("held"), F.collect_list(F.struct("doc", "tf", "dl")).alias("docs"))  # BLOCK documents at most
    lists.drop("slice").sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").parquet(f"{made}/{POSTINGS}")
    posts = Index(spark, made).part(POSTINGS)
    terms = posts.groupBy("bucket", "token").agg(F.sum("held").alias("df")).filter(F.col("df") >= least_df)
    terms.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{made}/{TERMS}")
    if not shared.rename(spark, made, path):
        shared.delete(spark, made)
        raise FileExistsError(path)


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    def part(self, name: str) -> DataFrame:
        """A table of the index; one by buckets has no file, and so no schema of its own, if it has no row."""
        read = self.spark.read
        if name in (POSTINGS, TERMS):
            doc = read.parquet(f"{self.path}/{FORWARD}").schema["doc"].dataType.simpleString()
            lists = f"block long, most double, held long, docs array<struct<doc:{doc},tf:bigint,dl:bigint>>"
            read = read.schema(f"token string, {lists if name == POSTINGS else 'df long'}, bucket int")
        return read.parquet(f"{self.path}/{name}")

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, asked, token, bucket) of queries (query_id, query)."""
        rows = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("t")).select("query_id", F.size("t").alias("asked"), F.explode("t").alias("token"))
        return rows.withColumn("bucket", bucket(F.col("token")))

    def hits(self, queries: DataFrame) -> DataFrame:
        """(query_id, asked, token, block, idf, most, held, docs): the posting rows of each query's tokens, from their buckets alone."""
        return self._read(queries)()

    def _read(self, queries: DataFrame) -> Callable[..., DataFrame]:
        """What gives hits; of the tables that it takes (tokens or blocks, pairs of a query) only those that any query names are read on."""
        asked = self.asked(queries)
        some = asked.agg(F.count("*").alias("n"), F.collect_set("bucket").alias("buckets"), F.min("token").alias("low"), F.max("token").alias("high")).first()  # BUCKETS numbers
        here = F.col("bucket").isin(some.buckets) & F.col("token").between(some.low or "", some.high or "")
        small = F.broadcast if some.n <= retrieval.BROADCAST_ROWS else lambda rows: rows
        corpus = self.part(CORPUS)
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        heavy = self.part(TERMS).filter(here).join(small(asked), ["bucket", "token"]).crossJoin(F.broadcast(corpus.select("n")))  # one row
        asking = heavy.select("query_id", "asked", "bucket", "token", idf.alias("idf"))
        posts = self.part(POSTINGS).filter(here)
        named = asked.select("bucket", "token").distinct()

        def of(*only: DataFrame) -> DataFrame:
            lists = posts
            for few in only:
                lists = _of(lists, few.distinct(), *few.columns, how="left_semi")
            if some.n > retrieval.BROADCAST_ROWS:
                return lists.join(asking, ["bucket", "token"])
            # lists are dealt by block before they meet each query of their token: what leaves a task is a list, once, and no posting
            lists = lists.join(F.broadcast(named), ["bucket", "token"], "left_semi")
            return lists.repartition("block").join(F.broadcast(asking), ["bucket", "token"])

        return of

    def scored(self, hits: DataFrame, settings: Retrieval) -> DataFrame:
        """(query_id, doc_id, score, terms) of the documents of hits that hold min_terms of a query's tokens or more.

        A document's postings are in its block, so blocks that are dealt whole add up where they are.
        """
        avgdl = self.part(CORPUS).select("avgdl")
        rows = hits.select("query_id", "asked", "idf", "block", F.inline("docs")).crossJoin(F.broadcast(avgdl))  # one row
        out = rows.groupBy("query_id", "block", F.col("doc").alias("doc_id")).agg(F.sum(F.col("idf") * retrieval.term_weight(settings, F.col("avgdl"))).alias("raw"), F.count("*").alias("terms"), F.first("asked").alias("asked"))
        return out.filter(F.col("terms") >= F.least(F.lit(settings.min_terms), F.col("asked"))).select("query_id", "doc_id", four_places(F.col("raw")).alias("score"), "terms")

    def bm25(self, queries: DataFrame, settings: Retrieval = Retrieval()) -> DataFrame:
        """What retrieval.bm25 gives, from the index: every document that matches."""
        return self.scored(self.hits(queries), settings)

    def top(self, queries: DataFrame, limit: int, settings: Retrieval = Retrieval(), measure: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """(query_id, doc_id, score, terms, rank) of each query's best; and, to measure, one row (scored, held): postings scored, and
        all of the queries' tokens. The result is a table in the shared folder; k1 and b must be those that the index was written with."""
        kept = self.part(CORPUS).first()
        if (kept.k1, kept.b) != (settings.k1, settings.b):
            raise ValueError(f"the index was written for k1={kept.k1}, b={kept.b}")
        read = self._read(queries)
        by_query = Window.partitionBy("query_id")
        rows = shared.written(read().select("query_id", "asked", "token", "block", (F.col("idf") * F.col("most")).alias("most"), "held"), "heads")
        sums = rows.groupBy("query_id", "block").agg(F.sum("most").alias("bound"), F.count("*").alias("n"), F.first("asked").alias("asked"))
        live = sums.filter(F.col("n") >= F.least(F.lit(settings.min_terms), F.col("asked"))).select("query_id", "block", "bound")
        placed = live.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("bound"), "block")))
        first = shared.written(placed.filter(F.col("place") <= FIRST).select("query_id", "block"), "first")
        best = shared.written(retrieval.best(self.scored(_of(read(first.select("block")), first, "query_id", "block"), settings), limit), "best")
        # queries with fewer rows so far have nothing to beat
        beat = best.filter(F.col("rank") == limit).select("query_id", (F.col("score") - HALF).alias("beat"))
        tokens = rows.groupBy("query_id", "token").agg(F.max("most").alias("most")).join(beat, "query_id", "left")
        sums = F.sum("most").over(by_query.orderBy("most", "token"))  # the tokens of one query
        split = tokens.withColumn("light", F.coalesce(sums <= LIGHT * F.col("beat"), F.lit(False)))
        split = split.withColumn("rest", F.coalesce(F.sum(F.when(F.col("light"), F.col("most"))).over(by_query), F.lit(0.0)))
        split = shared.written(split.select("query_id", "token", "beat", "light", "rest"), "split")
        later = live.join(beat, "query_id", "left").filter(F.col("beat").isNull() | (F.col("bound") >= F.col("beat"))).select("query_id", "block")
        later = shared.written(later.join(first, ["query_id", "block"], "left_anti"), "later")
        # lists of the blocks and tokens that are asked for, and no others, leave their tasks
        near = lambda tokens, blocks: _of(read(tokens.select("token"), blocks.select("block")), blocks, "query_id", "block")
        heavy = _of(near(split.filter("NOT light"), later), split.filter("NOT light"), "query_id", "token")
        avgdl = F.lit(kept.avgdl)
        gain = F.col("idf") * retrieval.term_weight(settings, avgdl)
        part = heavy.select("query_id", "asked", "beat", "rest", "idf", "block", F.inline("docs")).groupBy("query_id", "block", "doc").agg(F.sum(gain).alias("raw"), F.count("*").alias("terms"), *(F.first(c).alias(c) for c in ("asked", "beat", "rest")))
        able = shared.written(part.filter(F.col("beat").isNull() | (F.col("raw") + F.col("rest") >= F.col("beat"))).drop("beat", "rest"), "able")
        light = split.filter("light").select("query_id", "token")
        last = _of(near(light, able.select("query_id", "block").distinct()), light, "query_id", "token")
        more = last.select("query_id", "idf", F.inline("docs")).join(able.select("query_id", "doc"), ["query_id", "doc"]).select("query_id", "doc", gain.alias("raw"), F.lit(1).cast("long").alias("terms"), F.lit(None).cast("int").alias("asked"))
        whole = shared.written(able.select("query_id", "doc", "raw", "terms", "asked").unionByName(more).groupBy("query_id", "doc").agg(F.sum("raw").alias("raw"), F.sum("terms").alias("terms"), F.max("asked").alias("asked")), "whole")
        fine = whole.filter(F.col("terms") >= F.least(F.lit(settings.min_terms), F.col("asked"))).select("query_id", F.col("doc").alias("doc_id"), four_places(F.col("raw")).alias("score"), "terms")
        out = shared.written(retrieval.best(fine.unionByName(best.drop("rank")), limit), "top")
        shares = self._shares(rows, first, split, later, able, whole) if measure else None
        shared.drop(rows, first, best, split, later, able, whole)
        return out, shares

    def _shares(self, rows: DataFrame, first: DataFrame, split: DataFrame, later: DataFrame, able: DataFrame, whole: DataFrame) -> DataFrame:
        total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0)).cast("long")).first()[0]
        read = total(_of(rows, first, "query_id", "block"), "held") + total(_of(_of(rows, later, "query_id", "block"), split.filter("NOT light").select("query_id", "token"), "query_id", "token"), "held")
        scored = read + total(whole, "terms") - total(able, "terms")
        return self.spark.createDataFrame([(scored, total(rows, "held"))], "scored long, held long")


def _of(rows: DataFrame, few: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """rows that meet a row of few (a table, unique in on), which is broadcast if it is small."""
    return rows.join(F.broadcast(few) if retrieval.small(few) else few, list(on), how)
