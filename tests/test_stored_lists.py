"""Which lists of the stored index leave their tasks, and how its postings are dealt."""

from pyspark.sql import functions as F

from tessellate.operators import stored
from tessellate.sources import shared


def test_only_named_lists_are_read_on_and_slices_grow(spark, monkeypatch):
    rows = [(i, f"all {'even' if i % 2 == 0 else 'odd'} part{'abcdefghij'[i % 10]}") for i in range(1000)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "all odd"), (2, "even nowhere")], "query_id long, query string")
    monkeypatch.setattr(stored, "TASK_TOKENS", 10)
    path = shared.place(spark, "lists")
    stored.write(docs, path)
    index = stored.Index(spark, path)
    held = lambda df: sorted((r.query_id, r.token, r.block) for r in df.collect())
    every = held(index.hits(queries))
    block = min(b for *_, b in every)
    blocks, tokens = (spark.createDataFrame([(x,), (x,)], f"{n} {t}") for x, n, t in ((block, "block", "long"), ("odd", "token", "string")))
    read = index._read(queries)
    assert held(read()) == every and len({b for *_, b in every}) > 3
    assert held(read(blocks)) == [r for r in every if r[2] == block] and held(read(tokens, blocks)) == [r for r in every if r[1:] == ("odd", block)]
    # 3000 tokens, 10 a task: the lists of `all` lie in more than one file, each list once
    lists = index.part(stored.POSTINGS).filter("token = 'all'")
    assert lists.select(F.input_file_name()).distinct().count() > 1 and lists.agg(F.sum("held")).first()[0] == 1000
    assert lists.select("block").distinct().count() == lists.count()
