"""Schema rules, uniqueness and references as frames of violations."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import compare as C
from .mutations import CONDITIONS, holds
from .paths import INTERNAL, Ref, Scope

KINDS = ("String", "Int", "Number", "Bool", "DateTime", "Object", "Array")
ACTIONS = ("restrict", "setNull", "cascade")
#: Columns: what a document breaks, the key of a parent, and the key that a document refers to.
BROKEN, PARENT, REFERS = f"{INTERNAL}violations", f"{INTERNAL}parent", f"{INTERNAL}refers"
#: Rounds of deletions that are read one by one before they are written as one.
ROUNDS = 16


class Violation(ValueError):
    pass


@dataclass
class Reference:
    path: str
    collection: str
    target: str = "_id"
    on_delete: str = "restrict"


@dataclass
class Rules:
    """A collection's opt-in contract. ``checks``: (path, condition, value) as of conditional updates."""

    required: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    checks: list[tuple] = field(default_factory=list)
    refs: list[Reference] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.refs = [r if isinstance(r, Reference) else Reference(**r) for r in self.refs]
        for path, kind in self.types.items():
            if kind not in KINDS:
                raise ValueError(f"{path}: no type {kind}; known: {', '.join(KINDS)}")
        for path, test, *_ in self.checks:
            if test not in CONDITIONS:
                raise ValueError(f"{path}: no condition {test}")
        for r in self.refs:
            if r.on_delete not in ACTIONS:
                raise ValueError(f"{r.path}: no action {r.on_delete}")
            if r.on_delete == "setNull" and r.path in self.required:
                raise ValueError(f"{r.path} is required and can't be set to null")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Rules:
        return Rules(**json.loads(text))

    @staticmethod
    def from_wire(body: dict) -> Rules:
        """Rules as clients send them: required, types, checks of field, op and value, refs of field, collection, targetField and onDelete."""
        if not isinstance(body, dict) or not any(body.get(k) for k in ("required", "types", "checks", "refs")):
            raise ValueError("rules need at least one of required, types, checks, refs")
        required = body.get("required", [])
        if not isinstance(required, list) or not all(isinstance(x, str) and x.strip() for x in required):
            raise ValueError("required must be a list of names")
        types = {k: _named(str(v), TYPE_NAMES, "type") for k, v in body.get("types", {}).items()}
        checks = []
        for c in body.get("checks", []):
            test = _named(str(c.get("op")), TEST_NAMES, "op")
            if not c.get("field") or test not in ("Exists", "NotExists") and "value" not in c:
                raise ValueError(f"not a check: {c!r}")
            checks.append((c["field"], test) if test in ("Exists", "NotExists") else (c["field"], test, c["value"]))
        refs = []
        for r in body.get("refs", []):
            if not r.get("field") or not r.get("collection"):
                raise ValueError(f"not a reference: {r!r}")
            refs.append(Reference(r["field"], r["collection"], r.get("targetField", "_id"), _named(str(r.get("onDelete", "restrict")), {a.lower(): a for a in ACTIONS}, "onDelete")))
        return Rules(required, types, checks, refs)

    def to_wire(self) -> dict:
        return {
            "required": self.required,
            "types": {k: v.lower() for k, v in self.types.items()},
            "checks": [{"field": c[0], "op": c[1][:1].lower() + c[1][1:]} | ({"value": c[2]} if len(c) > 2 else {}) for c in self.checks],
            "refs": [{"field": r.path, "collection": r.collection, "targetField": r.target, "onDelete": r.on_delete} for r in self.refs],
        }


#: What types and conditions are called by clients.
TYPE_NAMES = {"string": "String", "int": "Int", "integer": "Int", "number": "Number", "double": "Number", "float": "Number", "bool": "Bool", "boolean": "Bool", "datetime": "DateTime", "date": "DateTime", "object": "Object", "document": "Object", "array": "Array"}
TEST_NAMES = {"==": "Eq", "=": "Eq", "eq": "Eq", "!=": "Ne", "ne": "Ne", "<": "Lt", "lt": "Lt", "<=": "Lte", "lte": "Lte", ">": "Gt", "gt": "Gt", ">=": "Gte", "gte": "Gte", "exists": "Exists", "notexists": "NotExists", "!exists": "NotExists"}


def _named(text: str, names: dict[str, str], what: str) -> str:
    if text.strip().lower() not in names:
        raise ValueError(f"unknown {what} {text!r}; known: {', '.join(names)}")
    return names[text.strip().lower()]


def _is_kind(ref: Ref, kind: str) -> Column:
    """Whether a value that isn't null is of a kind."""
    if isinstance(ref.kind, T.VariantType):
        s = F.schema_of_variant(ref.column)
        return {"String": s == "STRING", "Int": s == "BIGINT", "Number": s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), "Bool": s == "BOOLEAN", "DateTime": F.try_to_timestamp(C.as_text(ref)).isNotNull(), "Object": s.startswith("OBJECT"), "Array": s.startswith("ARRAY")}[kind]
    of = {"String": T.StringType, "Int": T.IntegralType, "Number": T.NumericType, "Bool": T.BooleanType, "DateTime": T.TimestampType, "Object": T.StructType, "Array": T.ArrayType}[kind]
    return F.lit(isinstance(ref.kind, of))


def violations(df: DataFrame, rules: Rules) -> DataFrame:
    """``df`` with array ``BROKEN``: texts of the rules that a document breaks, in the rules' order. References aside."""
    scope = Scope(df.schema, variant="_doc" if df.columns == ["_doc"] else None)
    found = []
    for path in rules.required:
        found.append(F.when(C.is_null(scope.ref(path)), F.lit(f"{path} is required")))
    for path, kind in rules.types.items():
        ref = scope.ref(path)
        found.append(F.when(~C.is_null(ref) & ~_is_kind(ref, kind), F.lit(f"{path} must be {kind}")))
    for check in rules.checks:
        found.append(F.when(~holds(df, [tuple(check)]), F.lit(f"{check[0]} must be {' '.join(map(str, check[1:]))}")))
    listed = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    return df.withColumn(BROKEN, listed)


def dangling(df: DataFrame, path: str, parents: DataFrame | None, target: str = "_id") -> DataFrame:
    """Documents whose reference isn't null and names no parent; with no parents all such."""
    ref = Scope(df.schema).ref(path)
    having = df.where(~C.is_null(ref))
    if parents is None:
        return having
    keys = parents.select(C.as_text(Scope(parents.schema).ref(target)).alias(PARENT)).where(F.col(PARENT).isNotNull()).distinct()
    return having.withColumn(REFERS, C.as_text(ref)).join(keys, F.col(REFERS) == F.col(PARENT), "left_anti").drop(REFERS)


def duplicates(df: DataFrame, paths: list[str]) -> DataFrame:
    """Keys that more than one document has, with their numbers; a key with a null part is exempt."""
    scope = Scope(df.schema)
    keyed = df.select(*[C.as_scalar(scope.ref(p)).alias(p) for p in paths])
    for p in paths:
        keyed = keyed.where(F.col(f"`{p}`").isNotNull())
    return keyed.groupBy(*[F.col(f"`{p}`") for p in paths]).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def clashes(new: DataFrame, old: DataFrame, paths: list[str]) -> DataFrame:
    """New documents whose key an old one has: a semi-join by key, after a look for duplicates within the new."""
    a, b = Scope(new.schema), Scope(old.schema)
    keys = old.select(*[C.as_text(b.ref(p)).alias(f"{INTERNAL}k{i}") for i, p in enumerate(paths)])
    out = new
    on = None
    for i, p in enumerate(paths):
        c = C.as_text(a.ref(p)) == F.col(f"{INTERNAL}k{i}")
        on = c if on is None else on & c
    return out.join(keys, on, "left_semi")


@dataclass
class DeletePlan:
    """Keys of documents to delete, and for (collection, path) the keys of parents whose references become null."""

    gone: dict[str, DataFrame]
    nulled: list[tuple[str, str, DataFrame]]


def plan_delete(frames: dict[str, DataFrame], rules: dict[str, Rules], name: str, ids: DataFrame, written) -> DeletePlan:
    """What deleting ``ids`` (column ``_id``) of ``name`` entails.

    Rounds of semi-joins, each over the last round's deletions, until a round
    deletes nothing new, however many that takes; a document is deleted once, so
    cycles end. ``written`` cuts a frame's lineage. Violation if a restricting
    reference stays.
    """
    rounds: dict[str, list[DataFrame]] = {name: [written(ids.select("_id").distinct())]}
    front = {name: rounds[name][0]}
    nulled: list[tuple[str, str, DataFrame]] = []
    restrict: list[tuple[str, Reference, DataFrame]] = []

    def gone(collection: str) -> DataFrame:
        out, *more = rounds[collection]
        for df in more:
            out = out.unionByName(df)
        return out

    while front:
        found: dict[str, DataFrame] = {}
        for child, r in rules.items():
            for ref in r.refs:
                if ref.collection.lower() not in front or child not in frames:
                    continue
                parents = front[ref.collection.lower()]
                if ref.target != "_id":
                    parents = frames[ref.collection.lower()].join(parents, "_id", "left_semi")
                keys = parents.select(C.as_text(Scope(parents.schema).ref(ref.target)).alias(PARENT)).where(F.col(PARENT).isNotNull()).distinct()
                if ref.on_delete == "setNull":
                    nulled.append((child, ref.path, written(keys)))
                    continue
                kids = frames[child].withColumn(REFERS, C.as_text(Scope(frames[child].schema).ref(ref.path))).join(keys, F.col(REFERS) == F.col(PARENT), "left_semi").select("_id")
                if ref.on_delete == "restrict":
                    restrict.append((child, ref, written(kids)))
                    continue
                if child in rounds:
                    kids = kids.join(gone(child), "_id", "left_anti")
                found[child] = found[child].unionByName(kids) if child in found else kids
        front = {}
        for child, kids in found.items():
            kids = written(kids.distinct())
            if not kids.isEmpty():
                front[child] = kids
                rounds.setdefault(child, []).append(kids)
                if len(rounds[child]) > ROUNDS:
                    rounds[child] = [written(gone(child))]
    plan = {child: gone(child) for child in rounds}
    for child, ref, kids in restrict:
        staying = kids.join(plan[child], "_id", "left_anti") if child in plan else kids
        if not staying.isEmpty():
            raise Violation(f"{child}.{ref.path} still refers to what would be deleted")
    return DeletePlan(plan, nulled)
