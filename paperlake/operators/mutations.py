"""What documents become: assignments along paths, conditions and merges, all as Columns over the pre-image."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import compare as C
from .paths import INTERNAL, VARIANT, Scope, parse_path

#: Conditions of a conditional update; null ranks lowest, so that nothing absent is at least anything.
CONDITIONS = ("Eq", "Ne", "Lt", "Lte", "Gt", "Gte", "Exists", "NotExists")
MUTATIONS = ("Set", "Inc", "Dec", "Unset")
#: Bits of whole numbers besides the sign.
INTEGERS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type for values of both: a wider number, fields of both, or else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return widened(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType))
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def _cast(column: Column, old: T.DataType, new: T.DataType) -> Column:
    """A column as a merged type: nested values become their JSON where the type is text, fields that are new are null."""
    if old == new:
        return column
    if isinstance(new, T.StringType) and isinstance(old, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        fields = [(_cast(column.getField(f.name), old[f.name].dataType, f.dataType) if f.name in old.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name) for f in new.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return F.transform(column, lambda x: _cast(x, old.elementType, new.elementType))
    return column.cast(new)


def _held_type(kind: T.DataType, steps: list, leaf: T.DataType) -> T.DataType | None:
    """A type in which the value at ``steps`` can also be a ``leaf``; None where the path leads through something else."""
    if not steps:
        return merged(kind, leaf)
    first, rest = steps[0], steps[1:]
    if isinstance(kind, T.StructType) and isinstance(first, str):
        if first not in kind.fieldNames():
            return T.StructType([*kind.fields, T.StructField(first, leaf)]) if not rest else None
        inner = _held_type(kind[first].dataType, rest, leaf)
        return None if inner is None else T.StructType([T.StructField(f.name, inner if f.name == first else f.dataType) for f in kind.fields])
    if isinstance(kind, T.ArrayType) and isinstance(first, int):
        inner = _held_type(kind.elementType, rest, leaf)
        return None if inner is None else T.ArrayType(inner)
    return None


def _replaced(column: Column, kind: T.DataType, steps: list, new: Column, leaf: T.DataType) -> Column:
    """A value with what stands at ``steps`` replaced; ``kind`` is its type, which can hold the new one."""
    if not steps:
        return _cast(new, leaf, kind)
    if isinstance(steps[0], int):
        return F.transform(column, lambda x, i: F.when(i == int(steps[0]), _replaced(x, kind.elementType, steps[1:], new, leaf)).otherwise(x))
    inner = _replaced(column.getField(steps[0]), kind[steps[0]].dataType, steps[1:], new, leaf)
    return F.when(column.isNotNull(), column.withField(f"`{steps[0]}`", inner))


def assign(df: DataFrame, path: str, new: Column, when: Column | None = None, kind: T.DataType | None = None) -> DataFrame:
    """Set a path where ``when`` holds. A new top-level field becomes a column; a nested path needs its parents.

    The value is stored as it is: where the field's type can't hold it, the
    field becomes wider, as on insert. ``kind``: the new value's type if known.
    """
    first, *rest = parse_path(path)
    held = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    leaf = df.select(new.alias("v")).schema["v"].dataType if kind is None else kind
    if first not in df.columns and schemaless(df.schema):
        doc = F.col(VARIANT)
        return df.withColumn(VARIANT, F.when(held, _set_in(doc, [first, *rest], None if isinstance(leaf, T.NullType) else variant_of(new, leaf))).otherwise(doc))
    if first not in df.columns:
        return df if rest else df.withColumn(first, F.when(held, new))
    old = df.schema[first].dataType
    wide = _held_type(old, rest, leaf)
    if wide is None:
        return df
    column = _cast(F.col(f"`{first}`"), old, wide)
    return df.withColumn(first, F.when(held, _replaced(column, wide, rest, new, leaf)).otherwise(column))


def schemaless(schema: T.StructType) -> bool:
    return VARIANT in schema.fieldNames() and isinstance(schema[VARIANT].dataType, T.VariantType)


def variant_of(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_variant_object(column)
    return column if isinstance(kind, T.VariantType) else column.cast(T.VariantType())


def _set_in(doc: Column, steps: list, new: Column | None) -> Column:
    """A schemaless value with what stands at ``steps`` set, or without it; parents that aren't there or of another kind stay."""
    first, *rest = steps
    kind = F.schema_of_variant(doc)
    if isinstance(first, int):
        items = F.from_json(F.to_json(doc), "array<variant>")
        none = F.parse_json(F.lit("null"))
        changed = F.transform(items, lambda x, i: F.when(i == int(first), _set_in(x, rest, new) if rest else none if new is None else new).otherwise(x))
        return F.when(kind.startswith("ARRAY"), F.to_variant_object(changed)).otherwise(doc)
    fields = F.from_json(F.to_json(doc), "map<string,variant>")
    others = F.map_filter(fields, lambda k, _: k != first)
    if rest:
        inner = F.try_element_at(fields, F.lit(first))
        changed = F.when(F.map_contains_key(fields, F.lit(first)), F.map_concat(others, F.create_map(F.lit(first), _set_in(inner, rest, new)))).otherwise(fields)
    else:
        changed = others if new is None else F.map_concat(others, F.create_map(F.lit(first), new))
    return F.when(kind.startswith("OBJECT"), F.to_variant_object(changed)).otherwise(doc)


def with_id(df: DataFrame) -> DataFrame:
    """Schemaless documents with the id that they hold, if any, as a column of its own; their version isn't theirs to give."""
    if not schemaless(df.schema) or "_id" in df.columns:
        return df
    doc = F.col(VARIANT)
    bare = F.when(F.schema_of_variant(doc).startswith("OBJECT"), _set_in(_set_in(doc, ["_id"], None), ["_etag"], None)).otherwise(doc)
    return df.select(F.try_variant_get(doc, "$._id", "string").alias("_id"), bare.alias(VARIANT), *[F.col(f"`{c}`") for c in df.columns if c != VARIANT])


def as_schemaless(df: DataFrame) -> DataFrame:
    """Typed documents as a schemaless collection has them; the id and version stay columns. Absent fields are not in a document."""
    if schemaless(df.schema):
        return df
    head = [c for c in df.columns if c in ("_id", "_etag") or c.startswith(INTERNAL)]
    fields = [f for f in df.schema.fields if f.name not in head]
    entries = [F.struct(F.lit(f.name).alias("key"), variant_of(F.col(f"`{f.name}`"), f.dataType).alias("value")) for f in fields]
    there = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return df.select(*head, F.to_variant_object(F.map_from_entries(there)).alias(VARIANT))


def literal(value: object, kind: T.DataType) -> Column:
    """A value as a column, of a field's own type where that holds it unchanged."""
    if isinstance(value, (dict, list)):
        text = json.dumps(value)
        return F.from_json(F.lit(text), F.schema_of_json(F.lit(text)))
    if isinstance(value, int) and not isinstance(value, bool) and (isinstance(kind, tuple(INTEGERS)) and -(2 ** INTEGERS[type(kind)]) <= value < 2 ** INTEGERS[type(kind)] or isinstance(kind, T.DoubleType)):
        return F.lit(value).cast(kind)
    if isinstance(value, str) and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and C.moment(value):
        return F.lit(value).cast(kind)
    return F.lit(value)


def holds(df: DataFrame, conditions: list[tuple]) -> Column:
    """All of (path, condition, value); an absent value is below every other."""
    scope = Scope(df.schema)
    out = F.lit(True)
    for path, test, *value in conditions:
        ref = scope.ref(path)
        missing = C.is_null(ref)
        v = value[0] if value else None
        if test == "Exists":
            out = out & ~missing
        elif test == "NotExists":
            out = out & missing
        elif test not in CONDITIONS:
            raise ValueError(f"no condition {test}; known: {', '.join(CONDITIONS)}")
        elif v is None:
            out = out & {"Eq": missing, "Ne": ~missing, "Lt": F.lit(False), "Lte": missing, "Gt": ~missing, "Gte": F.lit(True)}[test]
        else:
            op = {"Eq": "=", "Ne": "!=", "Lt": "<", "Lte": "<=", "Gt": ">", "Gte": ">="}[test]
            below = F.lit(test in ("Ne", "Lt", "Lte"))
            out = out & F.when(missing, below).otherwise(F.coalesce(C.compare(ref, op, v), F.lit(False)))
    return out


def mutate(df: DataFrame, mutations: list[tuple], when: Column) -> DataFrame:
    """Apply (path, mutation, value) where ``when`` holds; every one reads the document as it was."""
    before = df
    held = f"{INTERNAL}held"
    df = df.withColumn(held, F.coalesce(when, F.lit(False)))
    for path, kind, *value in mutations:
        if kind not in MUTATIONS:
            raise ValueError(f"no mutation {kind}; known: {', '.join(MUTATIONS)}")
        ref = Scope(before.schema).ref(path)
        if kind in ("Inc", "Dec"):
            by = value[0] if value else 1
            new = F.coalesce(ref.column, F.lit(0)) + F.lit(by if kind == "Inc" else -by)
        else:
            new = F.lit(None) if kind == "Unset" else literal(value[0], ref.kind)
        df = assign(df, path, new, F.col(held))
    return df.drop(held)


def merge_patch(df: DataFrame, patch: dict, when: Column) -> DataFrame:
    """A shallow merge: a null removes a field, anything else sets it. The key and version stay."""
    parts = [(k, "Unset") if v is None else (k, "Set", v) for k, v in patch.items() if k not in ("_id", "_etag")]
    return mutate(df, parts, when)


#: What the operations of a patch are called.
OPERATIONS = {"set": "Set", "inc": "Inc", "dec": "Dec", "unset": "Unset"}


def patch_operations(body: dict) -> list[tuple]:
    """A patch as mutations: a merge document, where null removes a field, or ``{"$ops": [{"field", "op", "value"}, ...]}``.

    The key and version stay as they are. ValueError for what isn't a patch, or changes nothing.
    """
    if "$ops" not in body:
        out = [(k, "Unset") if v is None else (k, "Set", v) for k, v in body.items() if k not in ("_id", "_etag")]
    else:
        if set(body) != {"$ops"} or not isinstance(body["$ops"], list):
            raise ValueError("$ops must be a list and stand alone")
        out = []
        for op in body["$ops"]:
            field, name = op.get("field"), str(op.get("op", "")).lower()
            if not field or name not in OPERATIONS:
                raise ValueError(f"not an operation: {op!r}; known: {', '.join(OPERATIONS)}")
            if field in ("_id", "_etag"):
                raise ValueError(f"{field} can't be changed")
            if name == "set" and "value" not in op:
                raise ValueError(f"{field}: set needs a value")
            if name in ("inc", "dec") and (isinstance(op.get("value", 1), bool) or not isinstance(op.get("value", 1), (int, float))):
                raise ValueError(f"{field}: {name} needs a number")
            out.append((field, OPERATIONS[name]) if name == "unset" else (field, OPERATIONS[name], op.get("value", 1)))
    if not out:
        raise ValueError("the patch is empty")
    return out


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A frame's columns as a schema has them, missing ones null."""
    if schemaless(schema):
        df = as_schemaless(df)
    return df.select(*[(_cast(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def widened(a: T.StructType, b: T.StructType) -> T.StructType:
    """Both schemas' fields, a number that isn't alike as a double, other unlike types as strings. Schemaless if either is."""
    if a.fields and schemaless(a) != schemaless(b):
        kept = [*dict.fromkeys(f.name for f in (*a.fields, *b.fields) if f.name in ("_id", "_etag") or f.name.startswith(INTERNAL))]
        kinds = {f.name: f.dataType for f in (*b.fields, *a.fields)}
        return T.StructType([*(T.StructField(k, kinds[k]) for k in kept), T.StructField(VARIANT, T.VariantType())])
    out = {f.name: f.dataType for f in a.fields}
    for f in b.fields:
        out[f.name] = merged(out[f.name], f.dataType) if f.name in out else f.dataType
    return T.StructType([T.StructField(k, v) for k, v in out.items()])
