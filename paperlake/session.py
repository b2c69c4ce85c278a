"""A database of document collections on a SparkSession."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import compare as C
from .operators import constraints as K
from .operators import mutations as M
from .operators.paths import INTERNAL, Scope, field_paths
from .plans import ast, build
from .plans.parser import parse
from .sources import documents
from .sources.store import Store, collection_name, index_paths, shard_of
from .streaming.changes import expired


@dataclass
class QueryResult:
    """A lazy result, or how many documents a change affected."""

    df: DataFrame | None = None
    affected: int = 0
    message: str = ""
    success: bool = True
    code: str | None = None
    elapsed: float = 0.0
    inserted: DataFrame | None = None

    @property
    def ids(self) -> list[str]:
        """The inserted documents' ids on the driver, all of them; ``inserted`` has them as a frame."""
        return [] if self.inserted is None else [r["_id"] for r in self.inserted.collect()]

    @property
    def plan(self) -> str:
        return "" if self.df is None else self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def rows(self) -> list[dict]:
        return [] if self.df is None else [r.asDict(True) for r in self.df.collect()]

    def lines(self) -> Iterator[str]:
        return documents.stream_lines(self.df, self.message)


class EtagMismatch(RuntimeError):
    pass


class ReservedField(ValueError):
    """A document has a field whose name begins as the engine's own do."""


#: Bytes of files up to which a replicated collection is sent to every executor; a larger one is joined as any other.
REPLICATED_BYTES = 64 << 20
#: Parts of a collection at which an insert merges the small ones, and bytes of a small one.
MANY_PARTS, SMALL_PART_BYTES = 64, 64 << 20
#: Which row of which file a new document is: what tells equal documents apart.
ROW = f"{INTERNAL}row"
HIT = f"{INTERNAL}hit"


def _part() -> Column:
    """The part that a row read from a collection's files lies in."""
    return F.regexp_extract(F.col("_metadata.file_path"), "/([0-9a-f]{32})/(?!.*/[0-9a-f]{32}/)", 1)


def where(df: DataFrame, condition: object) -> Column:
    """A parsed condition as a two-valued Column."""
    return F.lit(True) if condition is None else F.coalesce(build.condition(build.scope_of(df), condition), F.lit(False))


def updated(df: DataFrame, q: ast.Update) -> DataFrame:
    """The collection after an UPDATE; assignments read the documents as they were."""
    hit, new = f"{INTERNAL}where", f"{INTERNAL}new"
    out = df.withColumn(hit, where(df, q.where))
    scope = build.scope_of(df)
    for i, (path, node) in enumerate(q.sets):
        value = M.literal(node.value, scope.ref(path).kind) if isinstance(node, ast.Literal) else build.value(scope, node).column
        out = out.withColumn(f"{new}{i}", value)
    kinds = [out.schema[f"{new}{i}"].dataType for i in range(len(q.sets))]
    for i, (path, _) in enumerate(q.sets):
        out = M.assign(out, path, F.col(f"{new}{i}"), F.col(hit), kinds[i])
    return out.drop(hit, *[f"{new}{i}" for i in range(len(q.sets))])


def deleted(df: DataFrame, q: ast.Delete) -> DataFrame:
    return df.filter(~where(df, q.where))


def inserted(spark: SparkSession, q: ast.Insert) -> DataFrame:
    """The new document as a frame of one row."""
    if q.json is not None:
        json.loads(q.json)
        return documents.from_texts(spark, [q.json])
    one = spark.range(1)
    return one.select(*[build.value(Scope(T.StructType([])), v).column.alias(k) for k, v in q.values.items()])


class DocumentSession:
    """Collections of a store at ``root``, and frames registered under a name, which are read-only.

    Every change goes through one path: rules and uniqueness are tested on the
    new image, files are written aside, and one commit makes them and the
    change log's rows visible.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, auto_limit: int | None = None):
        self.spark, self.auto_limit = spark, auto_limit
        self.store = Store(spark, root) if root else None
        self.frames: dict[str, DataFrame] = {}

    # reading

    def register(self, name: str, df: DataFrame) -> DocumentSession:
        self.frames[collection_name(name)] = df
        return self

    def collections(self) -> list[str]:
        kept = list(self.store.manifest()["collections"]) if self.store else []
        return sorted({*self.frames, *kept})

    def find(self, name: str, version: int | None = None) -> DataFrame | None:
        name = collection_name(name)
        if name in self.frames:
            return self.frames[name]
        if self.store is None:
            return None
        manifest = self.store.manifest(version)
        entry = manifest["collections"].get(name)
        df = self.store.read(name, manifest=manifest)
        if entry and entry.get("replicated") and self.store.size(entry) <= REPLICATED_BYTES:
            return F.broadcast(df)
        return df

    def _found(self, q: ast.Select) -> Callable[[str], DataFrame | None]:
        """``find`` for a SELECT, of one version for all its collections: one that is laid out by a key which the condition fixes is
        read in those shards alone."""

        version = self.store.version() if self.store else None

        def find(name: str) -> DataFrame | None:
            name = collection_name(name)
            if self.store is None or name in self.frames:
                return self.find(name)
            entry = self.store.manifest(version)["collections"].get(name)
            keys = build.key_values(q, name, entry["shard"]["path"]) if entry and entry.get("shard") else None
            if keys is None:
                return self.find(name, version)
            kind = Scope(T.StructType.fromJson(json.loads(entry["schema"]))).ref(entry["shard"]["path"]).kind
            placed = [C.as_key(v, kind) for v in keys]
            if any(p is None for p in placed):
                return self.find(name, version)
            wanted = [shard_of(p, entry["shard"]["shards"]).alias(f"s{i}") for i, p in enumerate(placed)]
            return self.store.rows(entry, list(self.spark.range(1).select(*wanted).first()) if wanted else [])

        return find

    def collection(self, name: str):
        from .fluent import Query

        return Query(self, name)

    def as_of(self, version: int | None = None, moment: float | None = None) -> DocumentSession:
        """A read-only session of an older version."""
        v = self.store.version_at(moment) if version is None else version
        out = DocumentSession(self.spark)
        out.frames = {n: self.store.read(n, v) for n in self.store.manifest(v)["collections"]}
        return out

    def find_by_id(self, name: str, key: str) -> DataFrame:
        return self._there(name).filter(F.col("_id") == key)

    def find_by(self, name: str, path: str, value: str) -> DataFrame:
        """The first document whose field's text is ``value``."""
        df = self._there(name)
        return df.filter(C.as_text(build.scope_of(df).ref(path)) == value).limit(1)

    def _there(self, name: str) -> DataFrame:
        df = self.find(name)
        if df is None:
            raise build.CollectionNotFound(name)
        return df

    def count(self, name: str) -> int:
        df = self.find(name)
        return 0 if df is None else df.count()

    def stats(self) -> dict[str, dict]:
        entries = self.store.manifest()["collections"] if self.store else {}
        return {n: {"documents": self.count(n), "indexes": len(entries.get(n, {}).get("indexes", {}))} for n in self.collections()}

    def fields(self, name: str, depth: int = 3) -> list[str]:
        return field_paths(self._there(name).schema, depth)

    def export(self, path: str, database: str = "default") -> dict:
        return documents.export({n: self.find(n) for n in self.collections()}, path, database)

    # statements

    def query(self, text: str) -> DataFrame:
        """A SELECT as a lazy frame."""
        q = parse(text)
        if not isinstance(q, ast.Select):
            raise TypeError("query() takes a SELECT; sql() runs every statement")
        if self.auto_limit is not None and q.limit is None:
            q.limit = self.auto_limit
        try:
            return build.select(q, self._found(q))
        except build.CollectionNotFound as e:
            if e.count:
                return self.spark.createDataFrame([(0,)], "count long")
            raise

    def sql(self, text: str) -> QueryResult:
        """Run any statement; what goes wrong is in the result."""
        began = time.time()
        try:
            q = parse(text)
            if isinstance(q, ast.Select):
                out = QueryResult(self.query(text))
            elif isinstance(q, ast.Insert):
                out = self.insert(q.collection, inserted(self.spark, q))
            elif isinstance(q, ast.Update):
                out = self._rewrite(q.collection, lambda df: where(df, q.where), lambda df: updated(df, q))
            elif isinstance(q, ast.Delete):
                out = self.delete(q.collection, lambda df: where(df, q.where))
            elif isinstance(q, ast.CreateIndex):
                out = self.create_index(q.name, q.collection, q.paths, q.unique)
            else:
                out = self.drop_index(q.name, q.collection)
        except Exception as e:  # the result carries it
            out = QueryResult(success=False, message=str(e).split("\n")[0], code=getattr(e, "code", None))
        out.elapsed = time.time() - began
        return out

    # changes

    def _entry(self, manifest: dict, name: str, schema: T.StructType | None = None) -> dict:
        entry = manifest["collections"].get(name)
        if entry is None:
            entry = {"schema": (schema or T.StructType([])).json(), "parts": [], "indexes": {}, "rules": None, "ttl": None}
        return json.loads(json.dumps(entry))

    def _stamped(self, df: DataFrame, new_etag: bool = True) -> DataFrame:
        if taken := [c for c in df.columns if c.startswith(INTERNAL)]:
            raise ReservedField(f"{', '.join(taken)}: names that begin with {INTERNAL} are the engine's own")
        fresh = F.expr("replace(uuid(), '-', '')")
        df = df.withColumn("_id", F.coalesce(F.col("_id").cast("string"), fresh) if "_id" in df.columns else fresh)
        df = df.withColumn("_etag", fresh) if new_etag else df
        first = [c for c in ("_id", "_etag") if c in df.columns]
        return df.select(*first, *[F.col(f"`{c}`") for c in df.columns if c not in first])

    def _as_frame(self, docs: object) -> DataFrame:
        if not isinstance(docs, DataFrame):
            items = docs if isinstance(docs, list) else [docs]
            docs = documents.from_texts(self.spark, [d if isinstance(d, str) else json.dumps(d) for d in items])
        return M.with_id(docs)

    def _log_rows(self, df: DataFrame) -> DataFrame:
        return df.select(F.col("_id").alias("id"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("document"))

    def _rows(self, path: str, schema: T.StructType) -> DataFrame:
        """A part just written, with which row of which file each document is."""
        df = self.store.load(schema, path)
        return df.select(*[F.col(f"`{c}`") for c in schema.fieldNames()], F.struct("_metadata.file_path", "_metadata.row_index").alias(ROW))

    def _faults(self, name: str, entry: dict, new: DataFrame, rest: DataFrame | None, manifest: dict, drawn: bool = False) -> DataFrame:
        """New documents (with ``ROW``) and what each breaks: rules, references, uniqueness among themselves and against the rest.

        ``drawn``: their ids were drawn at random just now, and needn't be compared.
        """
        rules = K.Rules.from_json(entry["rules"]) if entry["rules"] else K.Rules()
        out = K.violations(new, rules)

        def marked(out: DataFrame, rows: DataFrame, text: str) -> DataFrame:
            bad = rows.select(F.col(ROW).alias(f"{INTERNAL}bad")).distinct()
            more = F.when(F.col(f"{INTERNAL}bad").isNotNull(), F.array_append(K.BROKEN, F.lit(text))).otherwise(F.col(K.BROKEN))
            return out.join(bad, F.col(ROW) == F.col(f"{INTERNAL}bad"), "left").withColumn(K.BROKEN, more).drop(f"{INTERNAL}bad")

        for r in rules.refs:
            out = marked(out, K.dangling(new, r.path, self.store.read(r.collection, manifest=manifest), r.target), f"{r.path} refers to no {r.collection}")
        unique = ([] if drawn else [["_id"]]) + [i["paths"] for i in entry["indexes"].values() if i["unique"]]
        for paths in unique:
            keys = [C.as_text(Scope(new.schema).ref(p)) for p in paths]
            whole = F.lit(True)
            for k in keys:
                whole = whole & k.isNotNull()
            again = new.select(ROW, F.struct(*keys).alias("_k"), whole.alias("_w")).where("_w")
            twice = again.groupBy("_k").agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
            clash = again.join(twice, "_k").where(F.col(ROW) != F.col("_first")).select(ROW)  # the first of equal keys may stay
            if rest is not None:
                clash = clash.unionByName(K.clashes(new, rest, paths).select(ROW))
            out = marked(out, clash, f"{', '.join(paths)} must be unique")
        return out

    def _write(self, name: str, entry: dict, df: DataFrame) -> str:
        return self.store.write_part(name, df, index_paths(entry), entry.get("shard"))

    def _merged(self, name: str, entry: dict) -> list[str]:
        """A collection's parts; where there are many, the small ones as one, so that many small inserts don't slow down reads."""
        if len(entry["parts"]) < MANY_PARTS:
            return entry["parts"]
        small = [p for p in entry["parts"] if self.store.size({"parts": [p]}) <= SMALL_PART_BYTES]
        if len(small) < 2:
            return entry["parts"]
        return [*(p for p in entry["parts"] if p not in small), self._write(name, entry, self.store.rows(entry | {"parts": small}))]

    def import_json(self, name: str, path: str, atomic: bool = True, checked: bool = True, multi_line: bool = False) -> QueryResult:
        """Insert a file or folder of JSON lines, or with ``multi_line`` of JSON arrays, as ``insert`` does."""
        return self.insert(name, documents.read_json(self.spark, path, multi_line=multi_line), atomic, checked)

    def insert(self, name: str, docs: object, atomic: bool = True, checked: bool = True) -> QueryResult:
        """Append documents. ``atomic``: all or none; else those that break no rule, and all the others' faults in ``df``.

        ``inserted`` of the result has the new ids as a frame. Files are cut and
        sorted by the collection's indexes. ``checked`` False is the untracked
        bulk path: no rules, no change log.
        """
        name = collection_name(name)
        given = self._as_frame(docs)
        new, drawn = self._stamped(given, checked), "_id" not in given.columns

        def change(manifest: dict) -> QueryResult:
            entry = self._entry(manifest, name, new.schema)
            schema = M.widened(T.StructType.fromJson(json.loads(entry["schema"])), new.schema)
            old = self.store.read(name, manifest=manifest)
            staged = self._write(name, entry, M.aligned(new, schema))  # ids are drawn once
            faults = None
            if checked:
                rows = self._rows(staged, schema)
                judged = self._faults(name, entry, rows, old, manifest, drawn).where(F.size(K.BROKEN) > 0).select("_id", ROW, K.BROKEN)
                faults = self.spark.read.schema(judged.schema).parquet(self.store.write_part("_faults", judged))  # one judgement, kept whole
                bad = bool(faults.limit(1).collect())
                if bad and atomic:
                    raise K.Violation("; ".join(sorted(r[0] for r in faults.select(F.explode(K.BROKEN)).distinct().collect())))
                if bad:
                    staged = self._write(name, entry, rows.join(faults.select(ROW), ROW, "left_anti").drop(ROW))
                faults = faults.select("_id", F.col(K.BROKEN).alias("violations"))
            rows = self.store.load(schema, staged)
            if entry["schema"] != schema.json() and entry["parts"]:
                entry["parts"] = [self._write(name, entry, M.aligned(old, schema))]
            entry["schema"] = schema.json()
            entry["parts"] = [*self._merged(name, entry), staged]
            log = self.store.log(manifest["version"] + 1, manifest["seq"], [(name, "insert", self._log_rows(rows))]) if checked else None
            self.store.commit(manifest, manifest["collections"] | {name: entry}, log)
            n = rows.count()
            return QueryResult(faults, n, f"{n} inserted", inserted=rows.select("_id"))

        return self._retried(change)

    def _retried(self, change: Callable[[dict], QueryResult]) -> QueryResult:
        if self.store is None:
            raise TypeError("the session has no store to change")
        return self.store.retry(change)

    def _rewrite(self, name: str, hit: Callable[[DataFrame], Column], new_image: Callable[[DataFrame], DataFrame]) -> QueryResult:
        """Copy on write: the parts that hold a document that is hit, found in one pass, are written anew as one; the others stay.

        Where a field becomes wider the others are written with it.
        """
        name = collection_name(name)

        def change(manifest: dict) -> QueryResult:
            entry = self._entry(manifest, name)
            if not entry["parts"]:
                return QueryResult(message="0 affected")
            schema = T.StructType.fromJson(json.loads(entry["schema"]))
            df = self.store.rows(entry)
            counts = {r["part"]: r["count"] for r in df.where(hit(df)).select(_part().alias("part")).groupBy("part").count().collect()}
            if not counts:
                return QueryResult(message="0 affected")
            touched = [p for p in entry["parts"] if p.rsplit("/", 1)[-1] in counts]
            others = [p for p in entry["parts"] if p not in touched]
            old = self.store.rows(entry | {"parts": touched})
            image = new_image(old.withColumn(HIT, hit(old)))
            if "_etag" in image.columns:
                image = image.withColumn("_etag", F.when(F.col(HIT), F.expr("replace(uuid(), '-', '')")).otherwise(F.col("_etag")))
            kind = image.drop(HIT).schema
            kept = self.store.write_part(name, image)  # versions are drawn once
            rows = self._rows(kept, image.schema)
            new = rows.where(HIT).drop(HIT)
            rest = rows.where(f"not {HIT}").drop(HIT, ROW)
            if others:
                rest = M.aligned(self.store.rows(entry | {"parts": others}), kind).unionByName(rest)
            bad = self._faults(name, entry, new, rest, manifest).where(F.size(K.BROKEN) > 0).select(F.explode(K.BROKEN)).distinct().collect()
            if bad:
                raise K.Violation("; ".join(sorted(r[0] for r in bad)))
            if kind != schema and others:
                others = [self._write(name, entry, M.aligned(self.store.rows(entry | {"parts": others}), kind))]
            entry["parts"] = [*others, self._write(name, entry, rows.drop(HIT, ROW))]
            entry["schema"] = kind.json()
            log = self.store.log(manifest["version"] + 1, manifest["seq"], [(name, "update", self._log_rows(new.drop(ROW)))])
            self.store.commit(manifest, manifest["collections"] | {name: entry}, log)
            n = sum(counts.values())
            return QueryResult(affected=n, message=f"{n} affected")

        return self._retried(change)

    def delete(self, name: str, hit: Callable[[DataFrame], Column]) -> QueryResult:
        """Delete with what references to the documents ask for, in one commit."""
        name = collection_name(name)

        def change(manifest: dict) -> QueryResult:
            entries = {n: self._entry(manifest, n) for n in manifest["collections"]}
            if name not in entries:
                return QueryResult(message="0 affected")
            rules = {n: K.Rules.from_json(e["rules"]) for n, e in entries.items() if e["rules"]}
            frames = {n: self.store.read(n, manifest=manifest) for n in entries}

            def written(df: DataFrame) -> DataFrame:
                path = self.store.write_part("_scratch", df)
                return self.spark.read.schema(df.schema).parquet(path)

            plan = K.plan_delete(frames, rules, name, frames[name].filter(hit(frames[name])).select("_id"), written)
            changes, affected = [], 0
            for n, ids in plan.gone.items():
                touched, others, count = self._touched(entries[n], "_id", ids)
                if n == name:
                    affected = count
                if not count:
                    continue
                old = self.store.rows(entries[n] | {"parts": touched})
                changes.append((n, "delete", self._log_rows(old.join(ids, "_id", "left_semi").select(old.columns))))
                entries[n]["parts"] = [*others, self._write(n, entries[n], old.join(ids, "_id", "left_anti").select(old.columns))]
            for n, path, keys in plan.nulled:
                touched, others, count = self._touched(entries[n], path, keys)
                if not count:
                    continue
                old = self.store.rows(entries[n] | {"parts": touched})
                held = old.withColumn(f"{INTERNAL}ref", C.as_text(Scope(old.schema).ref(path))).join(keys, F.col(f"{INTERNAL}ref") == F.col(K.PARENT), "left").withColumn(HIT, F.col(K.PARENT).isNotNull())
                image = M.assign(held, path, F.lit(None), F.col(HIT))
                if "_etag" in old.columns:
                    image = image.withColumn("_etag", F.when(F.col(HIT), F.expr("replace(uuid(), '-', '')")).otherwise(F.col("_etag")))
                image = written(image.select(*[F.col(f"`{c}`") for c in old.columns], HIT))  # versions are drawn once
                changes.append((n, "update", self._log_rows(image.where(HIT).drop(HIT))))
                entries[n]["parts"] = [*others, self._write(n, entries[n], image.drop(HIT))]
            if not affected:
                return QueryResult(message="0 affected")
            log = self.store.log(manifest["version"] + 1, manifest["seq"], changes)
            self.store.commit(manifest, manifest["collections"] | entries, log)
            return QueryResult(affected=affected, message=f"{affected} affected")

        return self._retried(change)

    def _touched(self, entry: dict, path: str, keys: DataFrame) -> tuple[list[str], list[str], int]:
        """The parts of a collection that hold a document whose field's text is among ``keys``, a column of them, the others, and
        the number of such documents."""
        if not entry["parts"]:
            return [], [], 0
        df = self.store.rows(entry)
        named = df.select(C.as_text(Scope(df.schema).ref(path)).alias(keys.columns[0]), _part().alias(f"{INTERNAL}part"))
        found = named.join(keys, keys.columns[0], "left_semi").groupBy(f"{INTERNAL}part").count().collect()
        counts = {r[0]: r["count"] for r in found}
        touched = [p for p in entry["parts"] if p.rsplit("/", 1)[-1] in counts]
        return touched, [p for p in entry["parts"] if p not in touched], sum(counts.values())

    def replace(self, name: str, key: str, doc: dict, etag: str | None = None) -> QueryResult:
        """Replace a document, which keeps its id; with ``etag`` only that version of it."""
        if self.find(name) is None:
            return QueryResult(message="0 affected")
        new = {k: v for k, v in doc.items() if k not in ("_id", "_etag")}
        sets = [(k, "Set", v) if v is not None else (k, "Unset") for k, v in new.items()]
        return self._versioned(name, key, etag, lambda df: [(c, "Unset") for c in df.columns if c not in ("_id", "_etag", HIT, *new)] + sets)

    def update_if(self, name: str, conditions: list[tuple], mutations: list[tuple]) -> QueryResult:
        """Apply mutations to the documents for which all conditions hold, tested and written in one commit."""
        return self._rewrite(name, lambda df: M.holds(df, conditions), lambda df: M.mutate(df, mutations, F.col(HIT)))

    def patch(self, name: str, patch: dict, conditions: list[tuple]) -> QueryResult:
        """Apply a merge document, or ``{"$ops": [...]}``, to the documents for which all conditions hold."""
        return self.update_if(name, conditions, M.patch_operations(patch))

    def patch_by_id(self, name: str, key: str, patch: dict, etag: str | None = None) -> QueryResult:
        """Patch a document; with ``etag`` only that version of it."""
        operations = M.patch_operations(patch)
        return self._versioned(name, key, etag, lambda df: operations)

    def _first_key(self, name: str, path: str, value: str) -> str | None:
        """The id of the first document whose field's text is ``value``: by id, where several have it."""
        df = self._there(name)
        return df.where(C.as_text(build.scope_of(df).ref(path)) == str(value)).agg(F.min("_id")).first()[0]

    def replace_by(self, name: str, path: str, value: str, doc: dict) -> QueryResult:
        key = self._first_key(name, path, value)
        return QueryResult(message="0 affected") if key is None else self.replace(name, key, doc)

    def patch_by(self, name: str, path: str, value: str, patch: dict, etag: str | None = None) -> QueryResult:
        operations = M.patch_operations(patch)
        key = self._first_key(name, path, value)
        return QueryResult(message="0 affected") if key is None else self._versioned(name, key, etag, lambda df: operations)

    def delete_by(self, name: str, path: str, value: str) -> QueryResult:
        key = self._first_key(name, path, value)
        return QueryResult(message="0 affected") if key is None else self.delete(name, lambda df: F.col("_id") == key)

    def _versioned(self, name: str, key: str, etag: str | None, operations: Callable[[DataFrame], list[tuple]]) -> QueryResult:
        conditions = [("_id", "Eq", key)] + ([("_etag", "Eq", etag)] if etag is not None else [])
        out = self._rewrite(name, lambda df: M.holds(df, conditions), lambda df: M.mutate(df, operations(df), F.col(HIT)))
        if not out.affected and etag is not None and not self.find_by_id(name, key).isEmpty():
            raise EtagMismatch(f"{key} has changed")
        return out

    def bulk_update(self, name: str, path: str, old: object, set_path: str, new: object) -> QueryResult:
        return self._rewrite(name, lambda df: F.coalesce(C.compare(Scope(df.schema).ref(path), "=", old), F.lit(False)), lambda df: M.assign(df, set_path, M.literal(new, Scope(df.schema).ref(set_path).kind), F.col(HIT)))

    def batch(self, ops: list[tuple]) -> QueryResult:
        """(insert|replace|delete|deleteByField, collection, ...) in one transaction."""
        tx = self.begin()
        for kind, name, *rest in ops:
            {"insert": tx.insert, "replace": tx.replace, "delete": tx.delete, "deleteByField": tx.delete_by}[kind](name, *rest)
        return tx.commit()

    def begin(self) -> Transaction:
        return Transaction(self)

    # definitions

    def _define(self, name: str, change: Callable[[dict, dict], None]) -> QueryResult:
        name = collection_name(name)

        def run(manifest: dict) -> QueryResult:
            entry = self._entry(manifest, name)
            change(entry, manifest)
            self.store.commit(manifest, manifest["collections"] | {name: entry})
            return QueryResult(message="ok")

        return self._retried(run)

    def create_index(self, index: str, name: str, paths: list[str], unique: bool = False) -> QueryResult:
        """A layout hint - later writes sort by it, so that scans skip row groups - and with ``unique`` a rule."""
        df = self._there(name)
        if unique and not K.duplicates(df, paths).isEmpty():
            raise K.Violation(f"{', '.join(paths)} isn't unique in {name}")
        return self._define(name, lambda e, _: e["indexes"].update({index.lower(): {"paths": paths, "unique": unique}}))

    def drop_index(self, index: str, name: str) -> QueryResult:
        def drop(entry: dict, _: dict) -> None:
            if entry["indexes"].pop(index.lower(), None) is None:
                raise KeyError(f"there is no index {index} on {name}")

        return self._define(name, drop)

    def rebuild_index(self, index: str, name: str) -> QueryResult:
        """Test a unique index again and write the collection's files anew, cut and sorted by this index before the others."""

        def run(entry: dict, manifest: dict) -> None:
            one = entry["indexes"].get(index.lower())
            if one is None:
                raise KeyError(f"there is no index {index} on {name}")
            if not entry["parts"]:
                return
            df = self.store.rows(entry)
            if one["unique"] and not K.duplicates(df, one["paths"]).isEmpty():
                raise K.Violation(f"{', '.join(one['paths'])} isn't unique in {name}")
            entry["indexes"] = {index.lower(): one} | entry["indexes"]
            entry["parts"] = [self._write(collection_name(name), entry, df)]

        return self._define(name, run)

    def set_shard_key(self, name: str, path: str, shards: int) -> QueryResult:
        """Lay a collection out by a key: a folder for each of ``shards`` hash values, of which a query that fixes the key reads
        its own. On a collection that is laid out already this moves what has to move: readers of older versions aren't
        disturbed, as their files stay until a vacuum, and the new layout is there at once for all others."""
        if shards < 1:
            raise ValueError("at least one shard")

        def run(entry: dict, manifest: dict) -> None:
            df = self.store.rows(entry)
            entry["shard"] = {"path": path, "shards": shards}
            entry["parts"] = [self._write(collection_name(name), entry, df)] if entry["parts"] else []

        return self._define(name, run)

    def set_replicated(self, name: str, on: bool = True) -> QueryResult:
        """A collection that every executor gets whole in a join, as long as its files are ``REPLICATED_BYTES`` at most."""
        return self._define(name, lambda e, _: e.update(replicated=on))

    def set_rules(self, name: str, rules: K.Rules) -> QueryResult:
        return self._define(name, lambda e, _: e.update(rules=rules.to_json()))

    def set_ttl(self, name: str, path: str) -> QueryResult:
        return self._define(name, lambda e, _: e.update(ttl=path))

    def sweep(self, now: Column | None = None) -> int:
        """Delete what has expired in all collections with a time-to-live; gives the number of documents."""
        at = F.current_timestamp() if now is None else now
        entries = self.store.manifest()["collections"]
        return sum(self.delete(n, lambda df, p=e["ttl"]: expired(df, p, at)).affected for n, e in entries.items() if e["ttl"])

    def compact(self, name: str, files: int | None = None) -> QueryResult:
        """Rewrite a collection as one part, in as many files as asked for, sorted by its indexes."""

        def run(entry: dict, manifest: dict) -> None:
            df = self.store.read(name, manifest=manifest)
            entry["parts"] = [self._write(collection_name(name), entry, df.repartition(files) if files else df)]

        return self._define(name, run)

    def drop_collection(self, name: str) -> bool:
        name = collection_name(name)
        manifest = self.store.manifest()
        if name not in manifest["collections"]:
            return False
        self.store.commit(manifest, {k: v for k, v in manifest["collections"].items() if k != name})
        return True


class Transaction:
    """Staged changes to many collections, seen by its own reads, committed together or not at all.

    The first to commit wins: another's commit since ``begin`` makes this one fail.
    """

    def __init__(self, session: DocumentSession):
        self.session, self.store = session, session.store
        self.base = self.store.manifest()
        self.added: dict[str, list[DataFrame]] = {}
        self.gone: dict[str, list[Callable[[DataFrame], Column]]] = {}
        self.over = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if not self.over:
            self.rollback()

    def insert(self, name: str, docs: object) -> DataFrame:
        """Stage documents; gives their ids as a frame."""
        name = collection_name(name)
        df = self.session._stamped(self.session._as_frame(docs))
        path = self.store.write_part(name, df)
        rows = self.session._rows(path, df.schema)
        self.added.setdefault(name, []).append(rows)
        return rows.select("_id")

    def delete(self, name: str, key: str) -> None:
        self._remove(name, lambda df: F.col("_id") == key)

    def delete_by(self, name: str, path: str, value: str) -> None:
        self._remove(name, lambda df: C.as_text(Scope(df.schema).ref(path)) == str(value))

    def replace(self, name: str, key: str, doc: dict) -> None:
        self.delete(name, key)
        self.insert(name, [{k: v for k, v in doc.items() if k != "_etag"} | {"_id": key}])

    def _remove(self, name: str, test: Callable[[DataFrame], Column]) -> None:
        name = collection_name(name)

        def hit(df: DataFrame) -> Column:
            return F.coalesce(test(df), F.lit(False))

        self.gone.setdefault(name, []).append(hit)
        self.added[name] = [d.filter(~hit(d)) for d in self.added.get(name, [])]

    def read(self, name: str) -> DataFrame | None:
        """The collection as this transaction sees it."""
        name = collection_name(name)
        df = self.store.read(name, manifest=self.base)
        for hit in self.gone.get(name, []):
            df = df.filter(~hit(df)) if df is not None else None
        for d in self.added.get(name, []):
            d = d.drop(ROW)
            schema = d.schema if df is None else M.widened(df.schema, d.schema)
            df = M.aligned(d, schema) if df is None else M.aligned(df, schema).unionByName(M.aligned(d, schema))
        return df

    def commit(self) -> QueryResult:
        self.over = True
        collections = dict(self.base["collections"])
        changes, affected = [], 0
        for name in sorted({*self.added, *self.gone}):
            df = self.read(name)
            if df is None:
                continue
            entry = self.session._entry(self.base, name, df.schema)
            old = self.store.read(name, manifest=self.base)
            for hit in self.gone.get(name, []):
                if old is not None:
                    gone = old.filter(hit(old))
                    affected += gone.count()
                    changes.append((name, "delete", self.session._log_rows(gone)))
                    old = old.filter(~hit(old))
            for d in self.added.get(name, []):
                rows = M.aligned(d, T.StructType([*df.schema.fields, d.schema[ROW]]))
                bad = self.session._faults(name, entry, rows, old, self.base).where(F.size(K.BROKEN) > 0).select(F.explode(K.BROKEN)).distinct().collect()
                if bad:
                    raise K.Violation("; ".join(sorted(r[0] for r in bad)))
                rows = rows.drop(ROW)
                affected += rows.count()
                changes.append((name, "insert", self.session._log_rows(rows)))
                old = rows if old is None else M.aligned(old, df.schema).unionByName(rows)
            entry["parts"] = [self.session._write(name, entry, df)]
            entry["schema"] = df.schema.json()
            collections[name] = entry
        log = self.store.log(self.base["version"] + 1, self.base["seq"], changes)
        self.store.commit(self.base, collections, log)
        return QueryResult(affected=affected, message=f"{affected} affected")

    def rollback(self) -> None:
        self.over = True
        self.added, self.gone = {}, {}

