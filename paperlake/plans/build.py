"""Statements as DataFrame calls, in the order FROM, WHERE, GROUP, DISTINCT, ORDER, OFFSET, LIMIT, list."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions
from ..operators import compare as C
from ..operators.joins import joined, nested
from ..operators.paths import Ref, Scope
from . import ast


def scope_of(df: DataFrame, sides: tuple[str, ...] | None = None) -> Scope:
    return Scope(df.schema, sides)


def value(scope: Scope, node: object) -> Ref:
    """A path, literal or function call as a column."""
    if isinstance(node, ast.Path):
        return scope.ref(node.text)
    if isinstance(node, ast.Aggregate):
        return scope.ref(node.label)
    if isinstance(node, ast.Literal):
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}
        return Ref(F.lit(node.value), kinds[type(node.value)])
    args = [value(scope, a) for a in node.args]
    name = node.name.upper()
    if name in ("COALESCE", "IFNULL", "ISNULL") and len({_family(a.kind) for a in args if not isinstance(a.kind, T.NullType)}) > 1:
        args = [Ref(C.as_text(a), T.StringType()) for a in args]
    out = functions.call(node.name, [C.as_scalar(a) for a in args])
    if name in ("LENGTH", "LEN"):
        return Ref(out, T.IntegerType())
    if name in ("GETDATE", "NOW", "CURRENT_TIMESTAMP"):
        return Ref(out, T.TimestampType())
    if name in ("COALESCE", "IFNULL", "ISNULL"):
        return Ref(out, next((a.kind for a in args if not isinstance(a.kind, (T.NullType, T.VariantType))), T.StringType()))
    return Ref(out, T.StringType())


def _family(kind: T.DataType) -> type:
    return T.NumericType if isinstance(kind, T.NumericType) else type(kind)


def condition(scope: Scope, node: object) -> Column:
    if isinstance(node, ast.And):
        return condition(scope, node.left) & condition(scope, node.right)
    if isinstance(node, ast.Or):
        return condition(scope, node.left) | condition(scope, node.right)
    if isinstance(node, ast.Not):
        if isinstance(node.inner, ast.IsNull):
            return ~C.is_null(value(scope, node.inner.path))
        return C.negate(condition(scope, node.inner))
    if isinstance(node, ast.IsNull):
        return C.is_null(value(scope, node.path))
    if isinstance(node, ast.In):
        return C.contained(value(scope, node.left), list(node.values))
    if isinstance(node, ast.Like):
        return C.like(value(scope, node.left), node.pattern)
    left = value(scope, node.left)
    if isinstance(node.right, ast.Literal):
        return C.compare(left, node.op, node.right.value)
    return C.compare_columns(left, node.op, value(scope, node.right))


def aggregate(scope: Scope, a: ast.Aggregate) -> Column:
    if a.path is None:
        return F.count(F.lit(1))
    ref = scope.ref(a.path)
    if a.name == "COUNT":
        column = F.when(~C.is_null(ref), C.as_scalar(ref))
        return F.count_distinct(column) if a.distinct else F.count(column)
    number = C.as_number(ref)  # of other values there is no sum, and no least or greatest
    return {"SUM": F.sum_distinct if a.distinct else F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[a.name](number)


def _aggregates(node: object) -> list[ast.Aggregate]:
    if isinstance(node, ast.Aggregate):
        return [node]
    return [x for k in ("left", "right", "inner", "path") if hasattr(node, k) for x in _aggregates(getattr(node, k))]


def key_values(q: ast.Select, name: str, path: str) -> list | None:
    """The literals of which a path must equal one for a document of ``name`` to be in the result; None where that isn't known."""
    if q.joins or q.collection.lower() != name or q.where is None:
        return None
    names = {path.lower(), f"{(q.alias or q.collection).lower()}.{path.lower()}"}

    def of(node: object) -> list | None:
        if isinstance(node, ast.And):
            left, right = of(node.left), of(node.right)
            return right if left is None else left if right is None or len(left) <= len(right) else right
        if isinstance(node, ast.Or):
            left, right = of(node.left), of(node.right)
            return None if left is None or right is None else left + right
        if not isinstance(getattr(node, "left", None), ast.Path) or node.left.text.lower() not in names:
            return None
        if isinstance(node, ast.In):
            return [v for v in node.values if v is not None]
        if isinstance(node, ast.Compare) and node.op == "=" and isinstance(node.right, ast.Literal) and node.right.value is not None:
            return [node.right.value]
        return None

    return of(q.where)


def select(q: ast.Select, find: Callable[[str], DataFrame | None]) -> DataFrame:
    """``find`` gives a collection's frame, None for one that isn't there."""
    df = find(q.collection)
    items = q.items
    if df is None:
        alone = items and len(items) == 1 and isinstance(items[0].value, ast.Aggregate) and items[0].value.path is None and not q.group
        if alone:
            raise CollectionNotFound(q.collection, count=True)
        raise CollectionNotFound(q.collection)
    sides = None
    if q.alias and not q.joins:
        df, sides = nested(df, q.alias), (q.alias,)
    for join in q.joins:
        df, sides = joined(df, sides, q.alias or q.collection, find(join.collection), join)
    scope = scope_of(df, sides)
    if q.where is not None:
        df = df.filter(condition(scope, q.where))
    if q.alias and not q.joins and items is None and not q.group:  # whole documents
        df = df.select(f"`{q.alias}`.*")
        scope = scope_of(df)
        prefix = q.alias.lower() + "."
        q = dataclasses.replace(q, order=[(k[len(prefix) :] if k.lower().startswith(prefix) else k, down) for k, down in q.order])
    grouped = bool(q.group) or any(isinstance(i.value, ast.Aggregate) for i in items or [])
    if grouped:
        df = _grouped(df, scope, q)
    if q.distinct:
        df = _distinct(df, scope, q, grouped)
    if q.order:
        after = scope_of(df) if grouped or q.distinct else scope
        df = df.orderBy(*[(lambda c: c.desc_nulls_last() if down else c.asc_nulls_first())(C.rank_key(after.ref(key))) for key, down in q.order])
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    if items is not None and not grouped and not q.distinct:
        df = df.select(*_listed(scope, items, df))
    return df


class CollectionNotFound(LookupError):
    code = "collectionNotFound"

    def __init__(self, name: str, count: bool = False):
        super().__init__(f"there is no collection {name}")
        self.count = count


def _listed(scope: Scope, items: list[ast.Item], df: DataFrame) -> list[Column]:
    """Columns named by their paths' text; ``_id`` comes along where the documents have one."""
    out = []
    names = [_name(i) for i in items]
    if scope.sides is None and "_id" in df.columns and "_id" not in names:
        out.append(F.col("_id"))
    refs = [value(scope, i.value) for i in items]
    # nothing is there to tell the type of a missing field: it is text
    return out + [(r.column.cast("string") if isinstance(r.kind, T.NullType) else r.column).alias(n) for r, n in zip(refs, names, strict=True)]


def _name(item: ast.Item) -> str:
    if item.alias:
        return item.alias
    if isinstance(item.value, ast.Path):
        return item.value.text
    if isinstance(item.value, ast.Aggregate):
        return item.value.label
    return f"{item.value.name.upper()}({', '.join(getattr(a, 'text', str(getattr(a, 'value', ''))) for a in item.value.args)})"


def _grouped(df: DataFrame, scope: Scope, q: ast.Select) -> DataFrame:
    """Keys first, then aggregates; a lone COUNT(*) is called ``count``. Partial sums precede the shuffle by themselves."""
    keys = [C.as_scalar(scope.ref(g)).alias(g) for g in q.group]
    wanted = [i for i in q.items or [] if isinstance(i.value, ast.Aggregate)]
    lone = not q.group and len(q.items or []) == 1 and wanted and wanted[0].value == ast.Aggregate("COUNT", None)
    names = ["count" if lone and not i.alias else _name(i) for i in wanted]
    hidden = [a for a in _aggregates(q.having) if a.label not in names] + [ast.Aggregate(*_label(k)) for k, _ in q.order if _label(k) and k not in names]
    columns = [aggregate(scope, i.value).alias(n) for i, n in zip(wanted, names, strict=True)]
    columns += [aggregate(scope, a).alias(a.label) for a in dict.fromkeys(hidden)]
    grouped = df.groupBy(*keys)
    out = grouped.agg(*columns) if columns else grouped.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    if q.having is not None:
        out = out.filter(condition(scope_of(out), q.having))
    if hidden and not q.order:
        out = out.select(*[F.col(f"`{c}`") for c in [*q.group, *names]])
    renamed = {i.value.text: i.alias for i in q.items or [] if i.alias and isinstance(i.value, ast.Path)}
    return out.withColumnsRenamed(renamed) if renamed else out


def _label(key: str) -> tuple[str, str | None, bool] | None:
    head, _, rest = key.partition("(")
    if head not in ("COUNT", "SUM", "AVG", "MIN", "MAX") or not rest.endswith(")"):
        return None
    inner = rest[:-1]
    distinct = inner.startswith("DISTINCT ")
    inner = inner.removeprefix("DISTINCT ")
    return head, None if inner == "*" else inner, distinct


def _distinct(df: DataFrame, scope: Scope, q: ast.Select, grouped: bool) -> DataFrame:
    if grouped or q.items is None:
        flat = [C.as_text(Ref(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) if isinstance(f.dataType, T.VariantType) else F.col(f"`{f.name}`") for f in df.schema.fields]
        return df.select(*flat).distinct()
    return df.select(*[C.as_scalar(value(scope, i.value)).alias(_name(i)) for i in q.items]).distinct()
