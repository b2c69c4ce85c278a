"""The fluent front end: fields as operators that build Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import compare as C
from .plans import build

_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


class Predicate:
    """A condition that waits for the frame it is asked of."""

    def __init__(self, make):
        self.make = make

    def __and__(self, other: Predicate) -> Predicate:
        a, b = _predicate(self), _predicate(other)
        return Predicate(lambda s: a.make(s) & b.make(s))

    def __or__(self, other: Predicate) -> Predicate:
        a, b = _predicate(self), _predicate(other)
        return Predicate(lambda s: a.make(s) | b.make(s))

    def __invert__(self) -> Predicate:
        return Predicate(lambda s: C.negate(self.make(s)))


def _predicate(x: object) -> Predicate:
    """A bare field is a condition that it is true."""
    return x == True if isinstance(x, Field) else x  # noqa: E712


class Field:
    """A path: ``f.passenger.lastName``, ``f.flights[0].code``; ``f["first.last"]`` takes any path."""

    def __init__(self, path: str = ""):
        self._path = path

    def __getattr__(self, name: str) -> Field:
        if name.startswith("__"):
            raise AttributeError(name)
        return Field(f"{self._path}.{name}" if self._path else name)

    def __getitem__(self, key: int | str) -> Field:
        if isinstance(key, int) or key == "*":
            return Field(f"{self._path}[{key}]")
        return getattr(self, key)

    def _test(self, op: str, other: object) -> Predicate:
        def make(scope):
            ref = scope.ref(self._path)
            if other is None:
                return C.is_null(ref) if op == "=" else ~C.is_null(ref)
            if isinstance(other, Field):
                return C.compare_columns(ref, op, scope.ref(other._path))
            return C.compare(ref, op, other)

        return Predicate(make)

    def __eq__(self, other: object) -> Predicate:  # type: ignore[override]
        return self._test("=", other)

    def __ne__(self, other: object) -> Predicate:  # type: ignore[override]
        return self._test("!=", other)

    def __lt__(self, other: object) -> Predicate:
        return self._test("<", other)

    def __le__(self, other: object) -> Predicate:
        return self._test("<=", other)

    def __gt__(self, other: object) -> Predicate:
        return self._test(">", other)

    def __ge__(self, other: object) -> Predicate:
        return self._test(">=", other)

    def __and__(self, other: object) -> Predicate:
        return _predicate(self) & other

    def __or__(self, other: object) -> Predicate:
        return _predicate(self) | other

    def __invert__(self) -> Predicate:
        return ~_predicate(self)

    def isin(self, *values: object) -> Predicate:
        return Predicate(lambda s: C.contained(s.ref(self._path), list(values)))

    def like(self, pattern: str) -> Predicate:
        return Predicate(lambda s: C.like(s.ref(self._path), pattern))

    __hash__ = None  # type: ignore[assignment]


f = Field()


class Query:
    """An immutable query over a collection; nothing runs before ``to_list``, ``first`` or ``count``."""

    def __init__(self, session, name: str, wheres: tuple = (), order: tuple | None = None, take: int | None = None, skip: int | None = None):
        self._s, self._name, self._wheres, self._order, self._take, self._skip = session, name, wheres, order, take, skip

    def _with(self, **changes) -> Query:
        now = {"wheres": self._wheres, "order": self._order, "take": self._take, "skip": self._skip}
        return Query(self._s, self._name, **(now | changes))

    def where(self, test: object) -> Query:
        """Conditions of repeated calls all hold."""
        return self._with(wheres=(*self._wheres, _predicate(test)))

    def order_by(self, field: Field) -> Query:
        return self._with(order=(field._path, False))

    def order_by_descending(self, field: Field) -> Query:
        return self._with(order=(field._path, True))

    def take(self, n: int) -> Query:
        return self._with(take=n)

    def skip(self, n: int) -> Query:
        return self._with(skip=n)

    def _filtered(self) -> DataFrame:
        df = self._s.find(self._name)
        if df is None:
            return self._s.spark.createDataFrame([], T.StructType([]))
        scope = build.scope_of(df)
        for w in self._wheres:
            df = df.filter(w.make(scope))
        return df

    def to_df(self) -> DataFrame:
        df = self._filtered()
        if self._order and df.columns:
            key: Column = C.rank_key(build.scope_of(df).ref(self._order[0]))
            df = df.orderBy(key.desc_nulls_last() if self._order[1] else key.asc_nulls_first())
        if self._skip:
            df = df.offset(self._skip)
        return df if self._take is None else df.limit(self._take)

    def count_df(self) -> DataFrame:
        return self._filtered().agg(F.count(F.lit(1)).alias("count"))

    def to_list(self) -> list[dict]:
        return [r.asDict(True) for r in self.to_df().collect()]

    def first(self) -> dict | None:
        rows = self.take(1).to_list()
        return rows[0] if rows else None

    def count(self) -> int:
        return self.count_df().first()[0]

    def insert(self, doc: dict) -> str:
        """Field names become camel case, as in stored documents."""

        def camel(x: object) -> object:
            if isinstance(x, dict):
                return {k if k.startswith("_") else k[:1].lower() + k[1:]: camel(v) for k, v in x.items()}
            return [camel(v) for v in x] if isinstance(x, list) else x

        return self._s.insert(self._name, [camel(doc)]).ids[0]
