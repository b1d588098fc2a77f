"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master (tests) gets a folder of its own; any other master raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessellate-"))
        root = context.getCheckpointDir().get()
    return root.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A path that nothing has yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, whatever reads it and whichever executors are lost."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `written` gave, once nothing reads them any more."""
    for table in tables:
        delete(table.sparkSession, table.written_to)


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete(spark: SparkSession, path: str) -> None:
    where, system = _path(spark, path)
    system.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _path(spark, path)
    return system.exists(where)


def folders(spark: SparkSession, path: str) -> None:
    """Make a folder and those above it, if they are not there."""
    where, system = _path(spark, path)
    system.mkdirs(where)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Whether old became new: at most one of several that try does, and none if new is there."""
    where, system = _path(spark, old)
    target, _ = _path(spark, new)
    return not system.exists(target) and system.rename(where, target)


def names(spark: SparkSession, path: str) -> list[str]:
    where, system = _path(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []
