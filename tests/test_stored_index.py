"""The stored index: what it holds, what a query reads of it, and rankings that skip against the full ones."""

import random

import pytest
from pyspark.sql import functions as F

from tessellate.config import Retrieval
from tessellate.operators import retrieval, stored
from tessellate.sources import shared, sinks


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    weights = [1 / (i + 3) for i in range(800)]
    names = [f"{a}{b}{c}" for a in "bdfgklmnpr" for b in "aeiou" for c in "bdfgklmnprstvwxz"]
    rows = [(i, " ".join(rng.choices(names, weights, k=rng.randrange(1, 80))), f"s{i % 4}") for i in range(1500)]
    rows += [(2000 + i, rows[3][1], "s1") for i in range(600)] + [(5000, None, None), (5001, "", "s0"), (5002, "12 34", "s0"), (5003, names[0] * 50, "s9")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), rows, names


@pytest.fixture(scope="module")
def queries(spark, corpus):
    _, rows, names = corpus
    rng = random.Random(6)
    asked = [(i, " ".join(rng.sample(names, rng.randrange(1, 12)))) for i in range(20)] + [(30, rows[3][1]), (31, None), (32, "nowhere"), (33, names[0]), (34, f"{names[0]} {names[1]}"), (35, rows[9][1])]
    return spark.createDataFrame(asked, "query_id long, query string")


@pytest.fixture(scope="module")
def index(spark, corpus):
    return sinks.index_sink(corpus[0], shared.place(spark, "test-index"), by=("source",))


def held(df):
    return sorted(map(tuple, df.collect()))


def test_rankings_equal_the_full_ones(corpus, queries, index):
    for settings, limits in ((Retrieval(), (1, 12)), (Retrieval(min_terms=1), (700,))):
        full = shared.written(retrieval.bm25(corpus[0], queries, settings), "full")
        assert held(index.bm25(queries, settings)) == held(full)
        for limit in limits:
            got, shares = index.top(queries, limit, settings, measure=True)
            assert held(got.select("query_id", "doc_id", "score", "terms", "rank")) == held(retrieval.best(full, limit).select("query_id", "doc_id", "score", "terms", "rank"))
            share = shares.first()
            assert 0 < share.scored <= share.held * (0.6 if limit == 1 else 1)


def test_large_sides_are_shuffled_with_the_same_rows(corpus, queries, index, monkeypatch):
    want = held(index.top(queries, 5)[0])
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert held(index.top(queries, 5)[0]) == want
    assert held(retrieval.indexed(corpus[0]).groupBy("token").agg(F.count("*"), F.sum("tf"), F.max("df"))) == held(index.part("postings").select("token", F.inline("docs")).groupBy("token").agg(F.count("*").alias("n"), F.sum("tf").alias("tf")).filter("n > 1").select("token", "n", "tf", F.col("n").alias("df")))


def test_a_query_reads_its_buckets_and_no_text(spark, corpus, index, capsys):
    one = spark.createDataFrame([(1, corpus[2][5])], "query_id long, query string")
    index.hits(one).explain("formatted")
    plan = capsys.readouterr().out
    scans = [x for x in plan.split("\n\n") if "Scan parquet" in x and "Location" in x and ("/postings" in x or "/terms" in x)]
    assert len(scans) == 2
    for scan in scans:
        buckets = scan.split("PartitionFilters: ")[1].split("\n")[0]
        assert "bucket" in buckets and ("IN (" in buckets or " = " in buckets)
        assert "GreaterThanOrEqual(token," in scan and "LessThanOrEqual(token," in scan and "text" not in scan.split("ReadSchema")[1]


def test_an_index_is_whole_or_not_there(spark, corpus, index):
    with pytest.raises(FileExistsError):
        stored.write(corpus[0], index.path)
    path = shared.place(spark, "broken")
    bad = corpus[0].withColumn("text", F.when(F.col("doc_id") == 1000, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        stored.write(bad, path)
    assert not shared.exists(spark, path)
    with pytest.raises(ValueError, match="k1"):
        index.top(spark.createDataFrame([(1, "a")], "query_id long, query string"), 3, Retrieval(k1=2.0))


def test_an_empty_corpus(spark, queries):
    made = sinks.index_sink(spark.createDataFrame([], "doc_id long, text string"), shared.place(spark, "none"))
    got, shares = made.top(queries, 5, measure=True)
    assert got.collect() == [] and tuple(shares.first()) == (0, 0)
