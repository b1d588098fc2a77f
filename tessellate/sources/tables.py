"""Readers for the columnar tables and for corpora of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, folder: str, expected: list[str] | None = None, glob: str = "*.txt") -> DataFrame:
    """(name, body, bytes, sha256) of the text files of a folder, in UTF-8; raises if their names aren't the expected set.

    Files that aren't UTF-8 are left out where no set is expected, else their bad bytes are replaced.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), F.col("content").cast("string").alias("body"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if expected is None:
        rows = rows.filter(F.is_valid_utf8("body"))
    else:
        rows = rows.withColumn("body", F.make_valid_utf8("body"))
        found = {r["name"] for r in rows.select("name").limit(len(expected) + 100).collect()}
        if found != set(expected):
            raise ValueError(f"missing: {sorted(set(expected) - found)}; extra: {sorted(found - set(expected))}")
    return rows


def violations(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (filename, bytes, sha256) that the files don't bear out, with a reason."""
    joined = manifest.alias("m").join(files.alias("f"), F.col("m.filename") == F.col("f.name"), "left")
    reason = F.when(F.col("f.name").isNull(), "missing").when(F.col("m.bytes") != F.col("f.bytes"), "size").when(F.col("m.sha256") != F.col("f.sha256"), "sha256")
    return joined.select("m.filename", reason.alias("reason")).filter("reason IS NOT NULL")


CHUNK = "id string, source_group string, source_quality string, learning_use string, medical_safety string, subfile string, chunk_title string, section_title string, chunk_index int, content string, content_length int, keywords array<string>"
INDEX = "total_docs long, avg_doc_length double, doc_lengths array<long>, inverted_index map<string, array<long>>, topic_keywords map<string, array<string>>"
ITEM = "id string, title string, definition string, summary string, layer string, node_type string, importance string, tier string, medical_safety string, sections map<string,string>, node_links array<struct<path:string>>, upstream array<string>, downstream array<string>, related array<string>, misconceptions array<struct<wrong:string,correction:string>>, quotes array<struct<text:string,source:string>>"
SOURCE = "path string, title string, quality string, public_status string, source_type string, license_status string, medical_safety string, readable boolean, size long"
STATS = "nodes_total long, topic_articles long, public_sources long, public_sources_readable long, manifest_total long, indexed_sources long"
GRAPH = f"generated_at string, layers array<string>, stats struct<{STATS.replace(' ', ':').replace(',:', ',')}>, nodes array<struct<{{item}}>>, articles array<struct<{{item}}>>, public_sources array<struct<{{source}}>>"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON documents at a path; none if there is no such path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    return spark.read.schema(schema).json(path, multiLine=True) if found else spark.createDataFrame([], schema)


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a knowledge base file, with their place doc; no rows without a file."""
    base = _document(spark, path, f"corpus_version string, generated_at string, chunks array<struct<{_fields(CHUNK)}>>")
    return base.select(F.posexplode("chunks").alias("doc", "c")).select("doc", "c.*")


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    """(token, doc, tf, df, dl) of an index file, whose lists hold a document and its count in turn; no rows without a file."""
    index = _document(spark, path, INDEX)
    lists = index.select("doc_lengths", F.explode("inverted_index").alias("token", "flat"))
    pairs = lists.select("token", "doc_lengths", (F.size("flat") / 2).cast("long").alias("df"), F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("flat") / 2).cast("int") - 1), lambda i: F.struct(F.get("flat", 2 * i).alias("doc"), F.get("flat", 2 * i + 1).alias("tf")))).alias("p"))
    return pairs.select("token", "p.doc", "p.tf", "df", F.get("doc_lengths", F.col("p.doc").cast("int")).alias("dl"))


def site_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a graph file: items (nodes, then articles, with their position and kind), layers, stats and public_sources.
    All are empty without a file."""
    whole = _document(spark, path, GRAPH.format(item=_fields(ITEM), source=_fields(SOURCE)))
    parts = [whole.select(F.lit(kind).alias("kind"), F.posexplode(kind).alias("at", "i")).select("kind", "at", "i.*") for kind in ("nodes", "articles")]
    items = parts[0].unionByName(parts[1])
    return {"items": items, "layers": whole.select(F.posexplode("layers").alias("at", "layer")), "stats": whole.select("stats.*"), "public_sources": whole.select(F.explode("public_sources").alias("s")).select("s.*")}


def _fields(schema: str) -> str:
    return ", ".join(":".join(f.split(" ", 1)) for f in schema.split(", "))


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(problem) of a manifest (file_count, total_bytes, files: array of filename, bytes, sha256): what its own figures deny."""
    f = F.col("files")
    rules = (
        (F.coalesce(F.size(f), F.lit(0)) == 0, "no files"), (F.size(f) != F.col("file_count"), "file_count"), (F.aggregate(f, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["bytes"], F.lit(0))) != F.col("total_bytes"), "total_bytes"),
        (F.size(F.array_distinct(F.transform(f, lambda x: x["filename"]))) != F.size(f), "repeated filename"), (F.exists(f, lambda x: ~F.coalesce(x["sha256"], F.lit("")).rlike("^[0-9a-f]{64}$")), "sha256"),
    )
    return manifest.select(F.explode(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in rules)))).alias("problem"))
