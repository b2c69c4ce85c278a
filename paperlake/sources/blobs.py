"""Binary contents kept once each under their SHA-256, in a versioned store.

Contents lie sorted by their digest, so that a lookup reads the row groups that
may hold it. Garbage collection writes the digests that it drops; compaction
rewrites what is left.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Store

NAME = "blobs"
SCHEMA = "sha256 string, content binary, length long, version long"
DROPPED = "sha256 string, version long"


@dataclass(frozen=True)
class Compaction:
    live: int
    dropped: int
    bytes_reclaimed: int


class Blobs:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    @staticmethod
    def _entry(manifest: dict) -> dict:
        empty = {"schema": T._parse_datatype_string(SCHEMA).json(), "parts": [], "dropped": [], "indexes": {}, "rules": None, "ttl": None}
        return dict(manifest["collections"].get(NAME, empty))

    def _commit(self, manifest: dict, entry: dict) -> int:
        return self.store.commit(manifest, manifest["collections"] | {NAME: entry})

    def _all(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*entry["parts"]) if entry["parts"] else self.spark.createDataFrame([], SCHEMA)

    def _live(self, entry: dict) -> DataFrame:
        """Contents that weren't dropped after they were written."""
        rows = self._all(entry)
        if not entry["dropped"]:
            return rows
        gone = self.spark.read.schema(DROPPED).parquet(*entry["dropped"]).groupBy("sha256").agg(F.max("version").alias("upto"))
        return rows.join(gone, (rows["sha256"] == gone["sha256"]) & (rows["version"] <= gone["upto"]), "left_anti")

    def live(self, version: int | None = None) -> DataFrame:
        """(sha256, content, length) of the contents that are kept."""
        return self._live(self._entry(self.store.manifest(version))).drop("version")

    def put(self, df: DataFrame, column: str = "content") -> DataFrame:
        """Keep the contents of a binary column that aren't kept yet; gives (sha256, length) of the distinct ones of ``df``. Nulls are left out."""
        rows = df.where(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("sha256"), F.col(column).cast("binary").alias("content"))
        once = rows.groupBy("sha256").agg(F.first("content").alias("content"))

        def change(manifest: dict) -> int:
            entry = self._entry(manifest)
            new = once.join(self._live(entry).select("sha256"), "sha256", "left_anti")
            new = new.select("sha256", "content", F.octet_length("content").cast("long").alias("length"), F.lit(manifest["version"] + 1).cast("long").alias("version"))
            entry["parts"] = [*entry["parts"], self.store.write_part(NAME, new, sort=["sha256"])]
            return self._commit(manifest, entry)

        self.store.retry(change)
        return rows.select("sha256", F.octet_length("content").cast("long").alias("length")).distinct()

    def put_files(self, path: str) -> DataFrame:
        """Keep the files below a path."""
        return self.put(self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))

    def get(self, sha256: str, start: int = 0, count: int | None = None) -> bytes | None:
        """A content's bytes from ``start`` on, ``count`` at most; None if it isn't kept."""
        if start < 0 or count is not None and count < 0:
            raise ValueError("a range begins at zero or later and isn't negative")
        part = F.col("content") if start == 0 and count is None else F.substring("content", start + 1, (1 << 31) - 1 - start if count is None else count)
        row = self.live().where(F.col("sha256") == sha256.lower()).select(part.alias("part")).first()
        return None if row is None else bytes(row["part"])

    def length_of(self, sha256: str) -> int | None:
        row = self.live().where(F.col("sha256") == sha256.lower()).select("length").first()
        return None if row is None else row["length"]

    def collect_garbage(self, referenced: DataFrame, column: str = "sha256") -> int:
        """Drop the contents that ``referenced`` doesn't name; gives how many."""
        named = referenced.select(F.lower(column).alias("sha256"))

        def change(manifest: dict) -> int:
            nonlocal n
            entry = self._entry(manifest)
            gone = self._live(entry).select("sha256").join(named, "sha256", "left_anti").withColumn("version", F.lit(manifest["version"]).cast("long"))
            path = self.store.write_part(f"{NAME}-dropped", gone)
            n = self.spark.read.schema(DROPPED).parquet(path).count()
            if not n:
                return manifest["version"]
            entry["dropped"] = [*entry["dropped"], path]
            return self._commit(manifest, entry)

        n = 0
        self.store.retry(change)
        return n

    def compact(self) -> Compaction:
        """Rewrite the kept contents as one part. Older versions keep theirs until they are vacuumed."""
        out = Compaction(0, 0, 0)

        def change(manifest: dict) -> int:
            nonlocal out
            entry = self._entry(manifest)
            before = self._all(entry).agg(F.count(F.lit(1)), F.sum("length")).first()
            path = self.store.write_part(NAME, self._live(entry), sort=["sha256"])
            after = self.spark.read.schema(SCHEMA).parquet(path).agg(F.count(F.lit(1)), F.sum("length")).first()
            out = Compaction(after[0], before[0] - after[0], (before[1] or 0) - (after[1] or 0))
            return self._commit(manifest, entry | {"parts": [path], "dropped": []})

        self.store.retry(change)
        return out

    def manifest(self) -> str:
        """What is kept, as JSON: how many contents and how many bytes."""
        row = self.live().agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
        return json.dumps(row.asDict())
