"""A table with a key that is changed in place: rows lie in buckets of their key, and a change rewrites the buckets it touches.

The folder holds data/<change>/bucket=<n>/ and versions/<number>, each version a list of the folder of every bucket. A change
writes its buckets beside the old ones and then adds a version by one rename, so a reader sees the table before it or after it,
whatever is lost on the way, and an untouched bucket keeps its files. Of two changes that start from one version the second fails.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared


class Conflict(RuntimeError):
    """Another change was made meanwhile; this one left the table as it was."""


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64, order: str | None = None) -> KeyedTable:
        """A new table of rows; of several with one key that of the highest order stays (or any, without one)."""
        made = cls(rows.sparkSession, path)
        made._add(0, {"key": key, "buckets": buckets, "schema": rows.schema.json(), "folders": {}})
        made.upsert(rows, order)
        return made

    def versions(self) -> list[int]:
        return [int(n) for n in shared.names(self.spark, f"{self.path}/versions") if n.isdigit()]

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        number = max(self.versions()) if version is None else version
        return number, json.loads(self.spark.read.text(f"{self.path}/versions/{number:09d}", wholetext=True).first()[0])

    def _add(self, number: int, state: dict) -> None:
        made = shared.place(self.spark, "version")
        made = f"{self.path}/{made.rsplit('/', 1)[1]}"
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(made)
        shared.folders(self.spark, f"{self.path}/versions")
        if not shared.rename(self.spark, made, f"{self.path}/versions/{number:09d}"):
            shared.delete(self.spark, made)
            raise Conflict(f"version {number} of {self.path} is there")

    def _read(self, state: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last unless it is given."""
        state = self._state(version)[1]
        return self._read(state, sorted(state["folders"].values()))

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(state["key"])), F.lit(state["buckets"])).cast("int")

    def _change(self, keys: DataFrame, changed) -> list[int]:
        """Rewrite the buckets of keys with what changed gives of their old rows."""
        number, state = self._state()
        touched = sorted(r[0] for r in keys.select(self._bucket(state)).distinct().collect())  # at most as many as there are buckets
        if not touched:
            return []
        old = self._read(state, [state["folders"][str(b)] for b in touched if str(b) in state["folders"]])
        change = shared.place(self.spark, "change").rsplit("/", 1)[1]
        rows = changed(old, state["key"]).withColumn("bucket", self._bucket(state))
        rows.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{change}")
        there = {n.split("=")[1] for n in shared.names(self.spark, f"{self.path}/data/{change}") if n.startswith("bucket=")}
        folders = {b: f for b, f in state["folders"].items() if int(b) not in touched} | {b: f"{change}/bucket={b}" for b in there}
        try:
            self._add(number + 1, state | {"folders": folders})
        except Conflict:
            shared.delete(self.spark, f"{self.path}/data/{change}")
            raise
        return touched

    def upsert(self, new: DataFrame, order: str | None = None) -> list[int]:
        """Put in the rows of new in the place of those with their keys (of equals or without an order the new row); the buckets touched.

        new is read twice and must give the same rows. A null key is a key.
        """

        def changed(old: DataFrame, key: str) -> DataFrame:
            both = old.withColumn("_n", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_n", F.lit(1)))
            best = F.max_by(F.struct(*old.columns), F.struct(*([order] if order else []), "_n"))
            return both.groupBy(key).agg(best.alias("_r")).select("_r.*")

        return self._change(new, changed)

    def delete(self, gone: DataFrame) -> list[int]:
        """Take out the rows whose key is in gone; the buckets touched."""

        def changed(old: DataFrame, key: str) -> DataFrame:
            out = gone.select(F.col(key).alias("_k")).distinct()
            return old.join(out, old[key].eqNullSafe(out["_k"]), "left_anti")

        return self._change(gone, changed)

    def clear(self) -> None:
        """Take out all rows; earlier versions can still be read."""
        number, state = self._state()
        self._add(number + 1, state | {"folders": {}})
