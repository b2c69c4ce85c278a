"""Joins that keep each side nested under its collection's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .compare import as_text
from .paths import INTERNAL, PathError, Ref, Scope, Star, parse_path

#: Columns: a document of the right side by what its array holds, and one element of it.
TAG, ELEMENT = f"{INTERNAL}tag", f"{INTERNAL}element"


def nested(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def joined(df: DataFrame, sides: tuple[str, ...] | None, first: str, other: DataFrame | None, join) -> tuple[DataFrame, tuple[str, ...]]:
    """``df`` with one more collection: ``join`` has its kind, collection and pairs of paths.

    A missing collection counts as empty. Keys of unlike types meet as text. A
    path with ``[*]`` on the new side matches by each element, and one element
    at a time, as in an index on an array.
    """
    spark = df.sparkSession
    if sides is None:
        df, sides = nested(df, first), (first,)
    name = join.alias or join.collection
    if name.lower() in (s.lower() for s in sides):
        raise ValueError(f"two sides are called {name}: give one an alias")
    if other is None:
        other = spark.createDataFrame([], T.StructType([]))
        right = spark.createDataFrame([], T.StructType([T.StructField(name, T.StructType([]))]))
    else:
        right = nested(other, name)
    if join.kind == "cross":
        return df.crossJoin(right), (*sides, name)
    left_scope, right_scope = Scope(df.schema, sides), Scope(right.schema, (name,))
    on, tagged = [], None
    for k, (a, b) in enumerate(join.on):
        if _prefix(a, (name,)) and not _prefix(b, (name,)) or not _prefix(a, sides) and not _prefix(b, (name,)) and _has(right_scope, name, a) and not _has(left_scope, sides, a):
            a, b = b, a
        left = left_scope.ref(a)
        every = any(isinstance(s, Star) for s in parse_path(b))
        found = right_scope.ref(b, every=every)
        if every and isinstance(found.kind, T.ArrayType):
            if len(join.on) > 1:
                raise PathError("[*] needs a join on one pair of paths")
            elements = F.array_distinct(found.column if not isinstance(found.kind.elementType, T.VariantType) else F.transform(found.column, lambda x: F.try_variant_get(x, "$", "string")))
            if join.kind == "right":
                # the right side is read more than once and its rows needn't come in the same order: no numbering of rows stays the same
                held = F.sort_array(elements)
                tagged = right = right.withColumn(TAG, F.struct(F.xxhash64(held).alias("a"), F.xxhash64(F.lit(1), held).alias("b")))
            right = right.withColumn(ELEMENT, F.explode_outer(elements))
            found = Ref(F.col(ELEMENT), right.schema[ELEMENT].dataType)
        lc, rc = _alike(left, found)
        df, right = df.withColumn(f"{INTERNAL}l{k}", lc), right.withColumn(f"{INTERNAL}r{k}", rc)
        on.append(F.col(f"{INTERNAL}l{k}") == F.col(f"{INTERNAL}r{k}"))
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    columns = [F.col(f"`{s}`") for s in (*sides, name)]
    if tagged is None:
        return df.join(right, condition, join.kind).select(*columns), (*sides, name)
    # a document of the right side that any element joins isn't padded for the others; documents that hold the same elements are all met or none is
    met = right.join(df, condition, "left_semi").select(f"{TAG}.a", f"{TAG}.b").distinct()
    # grouped by two columns and joined by one of both: the shuffle between lets adaptive execution split elements that many documents hold
    alone = tagged.join(met.select(F.struct("a", "b").alias(f"{INTERNAL}met")), F.col(TAG) == F.col(f"{INTERNAL}met"), "left_anti")
    none = [F.lit(None).cast(df.schema[s].dataType).alias(s) for s in sides]
    return df.join(right, condition).select(*columns).unionByName(alone.select(*none, columns[-1])), (*sides, name)


def _prefix(path: str, names: tuple[str, ...]) -> bool:
    return any(path.lower() == n.lower() or path.lower().startswith((f"{n.lower()}.", f"{n.lower()}[")) for n in names)


def _has(scope: Scope, sides: tuple[str, ...] | str, path: str) -> bool:
    return any(scope._has(s, parse_path(path)[0]) for s in ((sides,) if isinstance(sides, str) else sides))


def _alike(a: Ref, b: Ref):
    """Join keys of one type: as they are, as doubles, or as text."""
    if isinstance(a.kind, T.IntegralType) and isinstance(b.kind, T.IntegralType) or a.kind == b.kind and not isinstance(a.kind, (T.VariantType, T.StructType, T.ArrayType)):
        return a.column, b.column
    if isinstance(a.kind, T.NumericType) and isinstance(b.kind, T.NumericType):
        return a.column.cast("double"), b.column.cast("double")
    return as_text(a), as_text(b)
