"""Paths into nested documents: ``passenger.lastName``, ``flights[0].code``, ``flights[*].code``.

A path is resolved against a frame's schema to a Column, so that pruning and
push-down see plain field accesses. ``[*]`` reads the first element, or with
``every`` all elements as an array. What isn't there reads as null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAR = "*"
#: The column of a schemaless collection.
VARIANT = "_doc"
#: Names that begin so are the engine's own; documents can't have such fields.
INTERNAL = "__pl_"
_STEP = re.compile(r"(?:^|\.)(?:`([^`]+)`|([^.\[\]`]+))|\[(\d+|-\d+|\*)\]")


class PathError(ValueError):
    pass


@dataclass(frozen=True)
class Ref:
    """A resolved path and its type; NullType where the schema has no such field."""

    column: Column
    kind: T.DataType


def parse_path(text: str) -> list[str | int]:
    """Field names, indexes and ``Star()`` in order."""
    steps: list[str | int] = []
    at = 0
    for m in _STEP.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        if m[3] is not None:
            steps.append(Star() if m[3] == STAR else int(m[3]))
        else:
            steps.append(m[1] or m[2])
    if not steps or at != len(text):
        raise PathError(f"not a path: {text!r}")
    return steps


class Star(int):
    """All elements, or the first, as the reader asks for."""

    def __new__(cls) -> Star:
        return super().__new__(cls, 0)


def _variant_path(steps: list[str | int]) -> str:
    return "$" + "".join(f"[{int(s)}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']" for s in steps)


def walk(column: Column, kind: T.DataType, steps: list[str | int], every: bool = False) -> Ref:
    """Follow steps from a column. Behind a star with ``every``, the rest applies to each element."""
    for i, step in enumerate(steps):
        rest = steps[i + 1 :]
        if isinstance(kind, T.VariantType):
            stars = [k for k, s in enumerate(steps[i:]) if isinstance(s, Star)]
            if not (every and stars):
                return Ref(F.try_variant_get(column, _variant_path(steps[i:]), "variant"), T.VariantType())
            head, tail = steps[i : i + stars[0]], steps[i + stars[0] + 1 :]
            items = F.try_variant_get(column, _variant_path(head), "array<variant>")
            if not tail:
                return Ref(items, T.ArrayType(T.VariantType()))
            inner = F.transform(items, _element_walker(T.VariantType(), tail, every))
            return Ref(F.flatten(inner) if any(isinstance(s, Star) for s in tail) else inner, T.ArrayType(T.VariantType()))
        if isinstance(step, Star) and every and isinstance(kind, T.ArrayType):
            if not rest:
                return Ref(column, kind)
            element = walk(F.lit(None), kind.elementType, rest, every).kind
            inner = F.transform(column, _element_walker(kind.elementType, rest, every))
            nested = any(isinstance(s, Star) for s in rest) and isinstance(element, T.ArrayType)
            return Ref(F.flatten(inner), element) if nested else Ref(inner, T.ArrayType(element))
        if isinstance(step, int):
            if not isinstance(kind, T.ArrayType):
                return Ref(F.lit(None), T.NullType())
            column, kind = F.get(column, F.lit(int(step))), kind.elementType
        else:
            if not isinstance(kind, T.StructType) or step not in kind.fieldNames():
                return Ref(F.lit(None), T.NullType())
            column, kind = column.getField(step), kind[step].dataType
    return Ref(column, kind)


def _element_walker(kind: T.DataType, rest: list[str | int], every: bool):
    def follow(x: Column) -> Column:
        return walk(x, kind, rest, every).column

    return follow


@dataclass(frozen=True)
class Scope:
    """What the paths of a query can reach: a frame's columns, or the sides of a join under their collections' names.

    ``sides``: the collections that a joined frame nests; None before a join.
    ``variant``: the column that holds a schemaless collection's documents; found by its name and type where not given.
    """

    schema: T.StructType
    sides: tuple[str, ...] | None = None
    variant: str | None = None

    def __post_init__(self) -> None:
        if self.variant is None and self.sides is None and VARIANT in self.schema.fieldNames() and isinstance(self.schema[VARIANT].dataType, T.VariantType):
            object.__setattr__(self, "variant", VARIANT)

    def ref(self, path: str, every: bool = False) -> Ref:
        if path in self.schema.fieldNames():  # also a dotted name, as of a group's key
            return Ref(F.col(f"`{path}`"), self.schema[path].dataType)
        steps = parse_path(path)
        if self.sides is not None:
            return self._joined(path, steps, every)
        first, *rest = steps
        if first in self.schema.fieldNames():
            return walk(F.col(f"`{first}`"), self.schema[first].dataType, rest, every)
        if self.variant:
            return walk(F.col(self.variant), T.VariantType(), steps, every)
        return Ref(F.lit(None), T.NullType())

    def _joined(self, path: str, steps: list[str | int], every: bool) -> Ref:
        for side in sorted(self.sides, key=len, reverse=True):  # a collection's name may have dots
            name = parse_path(side) if "." in side else [side]
            if [str(s).lower() for s in steps[: len(name)]] == [str(s).lower() for s in name]:
                return self._side(side, steps[len(name) :], every)
        having = [s for s in self.sides if self._has(s, steps[0])]
        if len(having) > 1:
            raise PathError(f"{path} is in {' and '.join(having)}; put the collection's name before it")
        return self._side(having[0], steps, every) if having else Ref(F.lit(None), T.NullType())

    def _side(self, side: str, steps: list[str | int], every: bool) -> Ref:
        kind = self.schema[side].dataType
        if isinstance(kind, T.StructType) and kind.fieldNames() == ["_doc"] and steps:
            return walk(F.col(f"`{side}`").getField("_doc"), T.VariantType(), steps, every)
        return walk(F.col(f"`{side}`"), kind, steps, every)

    def _has(self, side: str, name: str | int) -> bool:
        kind = self.schema[side].dataType
        return isinstance(kind, T.StructType) and (name in kind.fieldNames() or kind.fieldNames() == ["_doc"])


def field_paths(schema: T.StructType, depth: int = 3) -> list[str]:
    """Dotted paths of a schema's fields to a depth, arrays as ``[*]``."""
    out: list[str] = []

    def visit(kind: T.DataType, path: str, level: int) -> None:
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[*]"
        out.append(path)
        if isinstance(kind, T.StructType) and level < depth:
            for f in kind.fields:
                visit(f.dataType, f"{path}.{f.name}", level + 1)

    for f in schema.fields:
        visit(f.dataType, f.name, 1)
    return out
