"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

MOST_ROUNDS = 60


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node that reaches a smaller one; component is the smallest it reaches, and has no row itself.

    edges: two long columns a, b in any order, repeats and loops allowed. Each round points every node at the least of its
    neighbours, so trees flatten in about log(diameter) rounds; rounds are written to the shared folder, so none is ever
    recomputed. It ends when a round leaves the edges as they were. Raises if that takes over MOST_ROUNDS rounds.
    """
    now = base.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionAll(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        old, now = now, base.written(small, name)
        base.drop(old)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components: no end after {MOST_ROUNDS} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s
