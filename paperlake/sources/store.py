"""A versioned copy-on-write store: immutable Parquet parts under one manifest per version.

A manifest lists every collection's parts, indexes, rules and time-to-live, and
the change files of its own version. A commit makes the next one by one step
that fails if it exists, so that only one writer can and a writer that dies
leaves nothing that blocks others. Change files are written aside and moved to
the log once a manifest names them; the next writer or reader does so where a
writer died in between. All collections change together, so a transaction is
one commit. Any version can be read. Files go through Hadoop's file systems, so
the root can be in a cluster's store.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.compare import as_number, as_text
from ..operators.paths import INTERNAL, Ref, Scope, Star, parse_path

CHANGES = "seq long, version long, collection string, op string, id string, document string"


class Conflict(RuntimeError):
    """Another writer has committed first."""


class BadName(ValueError):
    pass


class ResyncNeeded(LookupError):
    """The change log no longer reaches back to what a follower has: it must begin with a snapshot."""


def scratch_root(spark: SparkSession) -> str:
    """A fresh folder for a store that is thrown away, in the cluster's shared folder if it names one; deleted when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{(shared or 'file://' + tempfile.mkdtemp()).rstrip('/')}/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def collection_name(name: str) -> str:
    """Names are compared in lower case."""
    if not name or not name.strip() or len(name) > 128:
        raise BadName(f"not a collection's name: {name!r}")
    return name.lower()


#: Seconds after which change files that no manifest names are taken for those of a writer that is gone.
STALE = 86400
#: The folders' name of a collection that is laid out by a shard key.
SHARD = f"{INTERNAL}shard"


def shard_of(ref: Ref, shards: int) -> Column:
    """The shard of a key: numbers by value, all else by its text without regard to case, as comparisons take them."""
    text = as_number(ref).cast("string") if isinstance(ref.kind, T.NumericType) else F.lower(as_text(ref))
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(shards)).cast("int")


def index_paths(entry: dict) -> list[str]:
    """The paths of a collection's indexes, each once."""
    return list(dict.fromkeys(p for i in entry["indexes"].values() for p in i["paths"]))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._read: dict[int, str] = {}
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_manifest"))

    # manifests

    def _file(self, version: int):
        return self._path(f"{self.root}/_manifest/{version:012d}.json")

    def version(self) -> int:
        """The last version: from a hint, which is written after a commit and may be late, or else by a list."""
        at = self._hint()
        if not at:
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_manifest"))]
            return max((int(m[1]) for n in names if (m := re.fullmatch(r"(\d{12})\.json", n))), default=0)
        while self._fs.exists(self._file(at + 1)):
            at += 1
        return at

    def _hint(self) -> int:
        try:
            at = int(self._line(self._path(f"{self.root}/_manifest/_last")))
            return at if self._fs.exists(self._file(at)) else 0
        except Exception:  # not there, or only half written: a list tells
            return 0

    def _line(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()

    def _put(self, path, text: str, overwrite: bool) -> None:
        out = self._fs.create(path, overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "time": 0.0, "seq": 0, "first": 0, "log": [], "collections": {}}
        if version not in self._read:  # a version's file never changes
            if len(self._read) >= 16:
                self._read.clear()
            self._read[version] = self._line(self._file(version))
        return json.loads(self._read[version])

    def version_at(self, moment: float) -> int:
        """The last version committed at or before a time in seconds; times never fall from one version to the next."""
        low, high = 0, self.version()
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.manifest(middle)["time"] <= moment else (low, middle - 1)
        return low

    def commit(self, base: dict, collections: dict, log: tuple[int, list[str]] | None = None, first: int | None = None) -> int:
        """Make ``collections`` the next version after ``base``; Conflict if that isn't the last any more.

        ``log``: the last sequence number and the change files. ``first``: the
        sequence number after which the log is complete.
        """
        version = base["version"] + 1
        seq, files = log or (base["seq"], [])
        body = {"version": version, "time": max(time.time(), base["time"]), "seq": seq, "first": base["first"] if first is None else first, "log": files, "collections": collections}
        self._publish(base)
        aside = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        self._put(aside, json.dumps(body), False)
        try:
            self._claim(aside, self._file(version))
        except Exception as e:
            if not self._fs.exists(self._file(version)):
                raise
            raise Conflict(f"version {version} is another writer's") from e
        finally:
            self._fs.delete(aside, False)
        self._publish(body)
        self._put(self._path(f"{self.root}/_manifest/_last"), str(version), True)
        return version

    def _claim(self, aside, target) -> None:
        """Give a complete file its name, or fail if that is taken: a hard link on a local disk, else a rename that doesn't overwrite."""
        if self._fs.getUri().getScheme() != "file":
            self._rename(aside, target)
            return
        jvm = self.spark._jvm
        local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        jvm.java.nio.file.Files.createLink(local(target), local(aside))

    def _rename(self, aside, target) -> None:
        jvm = self.spark._jvm
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(target), plain)

    def _publish(self, manifest: dict) -> None:
        """Move a committed version's change files to the log; what is there already stays."""
        for k, name in enumerate(manifest["log"]):
            staged, target = self._path(f"{self.root}/_staged/{name}"), self._path(f"{self.root}/_changes/{manifest['version']:012d}-{k:04d}")
            if self._fs.exists(target) or not self._fs.exists(staged):
                continue
            self._fs.mkdirs(target.getParent())
            try:
                self._fs.rename(staged, target)
            except Exception:
                if not self._fs.exists(target):  # else another did it
                    raise

    # collections

    def read(self, name: str, version: int | None = None, manifest: dict | None = None) -> DataFrame | None:
        entry = (manifest or self.manifest(version))["collections"].get(collection_name(name))
        if entry is None:
            return None
        return self.rows(entry)

    def load(self, schema: T.StructType, *paths: str) -> DataFrame:
        """Files below paths; the folders of shards say nothing that the rows don't."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def rows(self, entry: dict, shards: list[int] | None = None) -> DataFrame:
        """The rows of a collection's entry; of some of its shards alone where ``shards`` are given."""
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        paths = entry["parts"]
        if shards is not None:
            paths = [f for p in paths for k in sorted({*shards}) if self._fs.exists(self._path(f := f"{p}/{SHARD}={k}"))]
        return self.load(schema, *paths) if paths else self.spark.createDataFrame([], schema)

    def size(self, entry: dict) -> int:
        """Bytes of a collection's files."""
        return sum(self._fs.getContentSummary(self._path(p)).getLength() for p in entry["parts"])

    def write_part(self, name: str, df: DataFrame, sort: list[str] | None = None, shard: dict | None = None) -> str:
        """Write rows aside. ``sort``: an index's paths, by whose ranges files are cut and sorted, so that files and row
        groups can be skipped; paths with ``[*]`` don't order anything. ``shard``: a folder for each shard of a key."""
        path = f"{self.root}/{collection_name(name)}/{uuid.uuid4().hex}"
        scope = Scope(df.schema)
        refs = [scope.ref(p) for p in sort or [] if not any(isinstance(s, Star) for s in parse_path(p))]
        keys = [r.column for r in refs if isinstance(r.kind, T.AtomicType)]
        if shard:
            df = df.withColumn(SHARD, shard_of(scope.ref(shard["path"]), shard["shards"]))
            # a hot shard's rows are dealt over tasks by their other columns
            df = df.repartitionByRange(SHARD, *(keys or [F.xxhash64(*[F.col(f"`{c}`") for c in ("_id",) if c in df.columns] or [F.lit(0)])]))
            df.sortWithinPartitions(SHARD, *keys).write.partitionBy(SHARD).parquet(path)
            return path
        if keys:
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        df.write.parquet(path)
        return path

    def log(self, version: int, seq: int, changes: list[tuple[str, str, DataFrame]]) -> tuple[int, list[str]]:
        """Write (collection, op, rows with id and document) aside; gives the last sequence number and the files' names.

        Numbers follow the order of ``changes``; within one they are unique and increasing, not dense.
        """
        names = []
        for name, op, rows in changes:
            n = rows.select(F.lit(version).cast("long").alias("version"), F.lit(name).alias("collection"), F.lit(op).alias("op"), F.col("id").cast("string"), F.col("document").cast("string"))
            names.append(uuid.uuid4().hex)
            path = f"{self.root}/_staged/{names[-1]}"
            n.select((F.monotonically_increasing_id() + F.lit(seq + 1)).alias("seq"), "*").write.parquet(path)
            seq = self.spark.read.schema(CHANGES).parquet(path).agg(F.max("seq")).first()[0] or seq
        return seq, names

    def publish(self) -> None:
        """See to it that the log has all committed changes: only the last version's can be missing."""
        self._publish(self.manifest())

    def changes(self, after: int = 0) -> DataFrame:
        """The committed changes that the log has after a sequence number."""
        self.publish()
        root = self._path(f"{self.root}/_changes")
        if not self._fs.exists(root) or not self._fs.listStatus(root):
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).option("recursiveFileLookup", "true").parquet(str(root.toString())).where(F.col("seq") > after)

    def catch_up(self, after: int) -> DataFrame:
        """The changes since a follower's last; ResyncNeeded if the log begins later, or never had that number."""
        manifest = self.manifest()
        if after < manifest["first"] or after > manifest["seq"]:
            raise ResyncNeeded(f"the log has the changes from {manifest['first'] + 1} to {manifest['seq']}, not those after {after}")
        return self.changes(after)

    def trim(self, keep: int = 1) -> int:
        """Drop the log of all but the last ``keep`` versions; gives the sequence number after which it is complete."""

        def change(manifest: dict) -> int:
            last = manifest["version"] - keep
            first = self.manifest(last)["seq"] if last > 0 else manifest["first"]
            if first <= manifest["first"]:
                return manifest["first"]
            self.commit(manifest, manifest["collections"], first=first)
            return first

        first = self.retry(change)
        root = self._path(f"{self.root}/_changes")
        if self._fs.exists(root):
            for s in self._fs.listStatus(root):
                if self.manifest(int(s.getPath().getName()[:12]))["seq"] <= first:
                    self._fs.delete(s.getPath(), True)
        return first

    def snapshot(self, target: str, version: int | None = None) -> Store:
        """A store of its own with a version's collections, rewritten below ``target``."""
        other = Store(self.spark, target)
        manifest = self.manifest(version)
        out = {}
        for name, entry in manifest["collections"].items():
            df = self.read(name, manifest=manifest)
            out[name] = entry | {"parts": [other.write_part(name, df, index_paths(entry), entry.get("shard"))] if entry["parts"] else []}
        other.commit(other.manifest(), out, (manifest["seq"], []), manifest["seq"])
        return other

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete parts that none of the last ``keep`` versions names; older versions can't be read then."""
        last = self.version()
        live = {p.rsplit("/", 1)[-1] for v in range(max(1, last - keep + 1), last + 1) for e in self.manifest(v)["collections"].values() for p in [*e["parts"], *e.get("dropped", [])]}
        gone = []
        for s in self._fs.listStatus(self._path(self.root)):
            if s.isDirectory() and not s.getPath().getName().startswith("_"):
                for p in self._fs.listStatus(s.getPath()):
                    if p.getPath().getName() not in live:
                        self._fs.delete(p.getPath(), True)
                        gone.append(p.getPath().toString())
        staged = self._path(f"{self.root}/_staged")
        for s in self._fs.listStatus(staged) if self._fs.exists(staged) else []:
            if s.getModificationTime() < (time.time() - STALE) * 1000 and s.getPath().getName() not in self.manifest(last)["log"]:
                self._fs.delete(s.getPath(), True)  # of a writer that died or lost
        return gone

    def retry(self, change: Callable[[dict], int], times: int = 5) -> int:
        """Run a change against the last manifest again while others commit first."""
        for k in range(times):
            try:
                return change(self.manifest())
            except Conflict:
                if k + 1 == times:
                    raise
        raise AssertionError
