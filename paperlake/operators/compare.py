"""Comparison with document semantics, built so that plain conjuncts still reach the scan.

A comparison with what is null or missing isn't true; at a filter SQL's NULL
does that by itself, so only the operand of NOT is made two-valued.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import Ref

OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def negate(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def as_text(ref: Ref) -> Column:
    if isinstance(ref.kind, T.VariantType):
        return F.try_variant_get(ref.column, "$", "string")
    if isinstance(ref.kind, T.TimestampType):
        return F.date_format(ref.column, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    if isinstance(ref.kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(ref.column)
    return ref.column.cast("string")


def as_number(ref: Ref) -> Column:
    """The value as a double where it is a number, else null."""
    if isinstance(ref.kind, T.NumericType):
        return ref.column.cast("double")
    if isinstance(ref.kind, T.VariantType):
        return F.when(F.schema_of_variant(ref.column).rlike(_NUMBERS), F.try_variant_get(ref.column, "$", "double"))
    return F.lit(None).cast("double")


def as_scalar(ref: Ref) -> Column:
    """What can be grouped, compared and sorted; a schemaless value by its text."""
    return as_text(ref) if isinstance(ref.kind, T.VariantType) else ref.column


def rank_key(ref: Ref) -> Column:
    """Order over values of any type: null, booleans, numbers, strings, then objects and arrays."""
    if not isinstance(ref.kind, T.VariantType):
        return ref.column
    kind = F.schema_of_variant(ref.column)
    rank = F.when(ref.column.isNull() | F.is_variant_null(ref.column), 0).when(kind == "BOOLEAN", 1).when(kind.rlike(_NUMBERS), 2).when(kind == "STRING", 3).when(kind.startswith("OBJECT"), 4).otherwise(5)
    return F.struct(rank, as_number(ref), as_text(ref))


def _literal_text(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def moment(text: str) -> dt.datetime | None:
    try:
        return dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None


def as_key(value: object, kind: T.DataType) -> Ref | None:
    """A literal as what equal values of a field are placed by; None where that isn't known for the field's type."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, T.NumericType):
        try:
            return Ref(F.lit(float(value)), T.DoubleType()) if number or isinstance(value, str) else None
        except ValueError:
            return None
    return Ref(F.lit(_literal_text(value)), T.StringType()) if isinstance(kind, T.StringType) else None


def compare(ref: Ref, op: str, value: object) -> Column:
    """``ref op literal`` by the type of both; of unlike types as text without regard to case. Nothing compares with NULL."""
    test = OPS[op]
    if value is None or isinstance(ref.kind, T.NullType):
        return F.lit(False)
    unlike = test(F.lower(as_text(ref)), F.lit(_literal_text(value).lower()))
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(ref.kind, T.VariantType):
        kind = F.schema_of_variant(ref.column)
        if number:
            return F.when(kind.rlike(_NUMBERS), test(as_number(ref), F.lit(value))).when(~F.is_variant_null(ref.column), unlike)
        if isinstance(value, bool):
            return F.when(kind == "BOOLEAN", test(F.try_variant_get(ref.column, "$", "boolean"), F.lit(value))).when(~F.is_variant_null(ref.column), unlike)
        return F.when(kind == "STRING", test(as_text(ref), F.lit(value))).when(~F.is_variant_null(ref.column), unlike)
    if isinstance(ref.kind, T.NumericType) and number or isinstance(ref.kind, T.StringType) and isinstance(value, str) or isinstance(ref.kind, T.BooleanType) and isinstance(value, bool):
        return test(ref.column, F.lit(value))
    if isinstance(ref.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(value, str):
        return test(ref.column, F.lit(value).cast(ref.kind)) if moment(value) else test(as_text(ref), F.lit(value))
    return unlike


def compare_columns(left: Ref, op: str, right: Ref) -> Column:
    """Of two values; null beside anything isn't true, unlike types compare as text."""
    a, b = left.kind, right.kind
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType) or a == b and not isinstance(a, T.VariantType):
        return OPS[op](left.column, right.column)
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return F.lit(False)
    return OPS[op](F.lower(as_text(left)), F.lower(as_text(right)))


def contained(ref: Ref, values: list[object]) -> Column:
    """IN: one pushed membership test where all literals are of the column's own type."""
    kinds = {"n" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__ for v in values}
    if kinds == {"n"} and isinstance(ref.kind, T.NumericType) or kinds == {"str"} and isinstance(ref.kind, T.StringType):
        return ref.column.isin(*values)
    out = F.lit(False)
    for v in values:
        out = out | compare(ref, "=", v)
    return out


def like(ref: Ref, pattern: str) -> Column:
    """LIKE without regard to case and without an escape character; only strings are like anything."""
    if isinstance(ref.kind, T.VariantType):
        column = F.when(F.schema_of_variant(ref.column) == "STRING", as_text(ref))
    elif isinstance(ref.kind, T.StringType):
        column = ref.column
    else:
        return F.lit(False)
    return F.ilike(column, F.lit(pattern), F.lit("\x01"))


def is_null(ref: Ref) -> Column:
    if isinstance(ref.kind, T.VariantType):
        return ref.column.isNull() | F.coalesce(F.is_variant_null(ref.column), F.lit(True))
    return ref.column.isNull()
