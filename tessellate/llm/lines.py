"""Line dedup with levelled sorted runs. DataFrame functions only.

A line's key is the line without ASCII white space at its ends, A-Z lowered; it is known by two hashes (96 bits). A run is a
table of (h, g, n, last): in how many rows a key was found and the largest doc_id of these, bucketed by the hashes and sorted
within its files. Rows come in batches. The keys of a batch are counted, merge-anti-joined with the settled keys of the runs
(those that one run has seen in `least` rows: a later batch can't change their lot, as batches go by falling doc_id), and what
is left becomes a run of its own. Two runs of a level are compacted into one of the next by a merge join of their buckets, so no
run is shuffled again. Once all batches are in, the last run tells which lines go.

Each row is a document. Null and empty texts are one empty line. Ids may be null (below all others) or repeated: lines stay in
every row that has the largest id. Repeated rows count as often as they are there, and get equal results. Only doc_id and text
are read, so other columns can't clash. An empty table gives an empty table. A text of any length is one row; keys that repeat
within it count once. Hot keys are counted before the shuffle; where lines meet the run, its keys are unique and the join can
be split. The runs are in the shared folder: a lost executor costs the tasks it ran.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

#: Code points of a key, and rows that hold it, from which its lines go.
LONG = 20
LEAST = 3
#: Batches that the query deals documents to.
BATCHES = 4
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["h", "g"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.length(bare)  # lower() leaves nothing else to tell apart, and is much the faster
    return F.when(ascii_only, F.lower(bare)).when(bare.rlike("[A-Z]"), F.translate(bare, UPPER, UPPER.lower())).otherwise(bare)


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h"), F.hash(key).alias("g")]


class Runs:
    """Levelled runs of line keys; levels[i] is a run of 2**i batches, or None."""

    def __init__(self, spark: SparkSession, long: int = LONG, least: int = LEAST):
        self.spark, self.long, self.least, self.levels = spark, long, least, []

    def _written(self, keys: DataFrame) -> DataFrame:
        """keys as a run: a bucketed table in the shared folder."""
        name, parts = f"line_run_{uuid.uuid4().hex}", base.partitions(self.spark)
        path = f"{base.shared_folder(self.spark)}/{name}"
        keys.write.bucketBy(parts, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        run = self.spark.table(name)
        run.written_to, run.name = path, name
        return run

    def _dropped(self, *runs: DataFrame) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE {run.name}")
            base.drop(run)

    def add(self, batch: DataFrame) -> None:
        """Take in a batch (doc_id, text), none of whose ids is above one of an earlier batch."""
        keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), key_of), lambda k: F.length(k) >= self.long))
    # an outer explode: an inner one is given a filter that makes all keys once more
        found = batch.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode_outer(keys).alias("key")).filter("key IS NOT NULL").select("doc_id", *_hashes("key"))
        new = found.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        for run in self.levels:
            if run is not None:
                new = new.join(run.filter(F.col("n") >= self.least).hint("merge"), KEY, "left_anti")
        run, level = self._written(new), 0
        while level < len(self.levels) and self.levels[level] is not None:
            run, self.levels[level] = self._merged(self.levels[level], run), None
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        x, y = a.toDF(*KEY, "n1", "last1"), b.toDF(*KEY, "n2", "last2")
        both = x.hint("merge").join(y, KEY, "full")
        out = self._written(both.select(*KEY, (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("last1", "last2").alias("last")))
        self._dropped(a, b)
        return out

    def repeated(self) -> DataFrame:
        """(h, g, last): the keys found in `least` rows or more. Read without its buckets, so that a join can split hot keys."""
        runs = [run for run in self.levels if run is not None]
        while len(runs) > 1:
            runs[:2] = [self._merged(runs[0], runs[1])]
        self.levels = [None] * (len(self.levels) - 1) + runs
        return self.spark.read.schema(runs[0].schema).parquet(runs[0].written_to).filter(F.col("n") >= self.least).select(*KEY, "last")


def batches(docs: DataFrame, n: int = BATCHES) -> list[DataFrame]:
    """docs in batches of falling doc_id, about equal in rows; null ids are in the last. Rows of one id are in one batch."""
    doc_id = F.col("doc_id").cast("long")
    ids = docs.select(doc_id.alias("doc_id")).agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000)).first()[0] or []
    cuts = sorted(set(ids), reverse=True)
    if not cuts:
        return [docs]
    middle = [docs.filter((doc_id > low) & (doc_id <= high)) for high, low in zip(cuts, cuts[1:])]
    return [docs.filter(doc_id > cuts[0]), *middle, docs.filter((doc_id <= cuts[-1]) | doc_id.isNull())]


def deduplicated(docs: DataFrame, long: int = LONG, least: int = LEAST, n: int = BATCHES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of each row of docs (doc_id, text): lines before, lines that went, the rest of the text."""
    runs = Runs(docs.sparkSession, long, least)
    for batch in batches(docs, n):
        runs.add(batch)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({"r": F.xxhash64("doc_id", "text"), "s": F.hash("text", "doc_id")})
    at = rows.select("r", "s", "doc_id", F.posexplode(F.transform(lines_of(F.col("text")), key_of)).alias("at", "key")).filter(F.length("key") >= long)
    gone = at.select("r", "s", "doc_id", "at", *_hashes("key")).join(runs.repeated(), KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = gone.groupBy("r", "s").agg(F.collect_set("at").alias("gone"))  # the places of one text
    split = rows.join(gone, ["r", "s"], "left").withColumn("lines", F.split("text", "\n", -1))
    none = F.array().cast("array<int>")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", none))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return split.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(base.documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {LONG} GROUP BY 1 HAVING count(DISTINCT doc_id) >= {LEAST}),
d AS (SELECT k.*, last IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY 1"""
