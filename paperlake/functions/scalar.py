"""The registry of scalar functions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnknownFunction(ValueError):
    pass


class ArityError(ValueError):
    pass


_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _text(c: Column) -> Column:
    return c.cast("string")


_FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Column]]] = {}


def register(names: str, least: int, most: int | None, make: Callable[..., Column]) -> None:
    """Add a function under one or more names; ``most`` None means any number of arguments."""
    for name in names.split():
        _FUNCTIONS[name.upper()] = (least, most, make)


register("NEWID UUID GENERATE_UUID", 0, 0, lambda: F.replace(F.uuid(), F.lit("-"), F.lit("")))
register("GETDATE NOW CURRENT_TIMESTAMP", 0, 0, lambda: F.current_timestamp())
register("LOWER", 1, 1, lambda c: F.lower(_text(c)))
register("UPPER", 1, 1, lambda c: F.upper(_text(c)))
register("LENGTH LEN", 1, 1, lambda c: F.length(_text(c)))
register("TRIM", 1, 1, lambda c: F.btrim(_text(c), F.lit(_WHITE)))
register("COALESCE IFNULL ISNULL", 1, None, lambda *c: F.coalesce(*c))


def call(name: str, args: list[Column]) -> Column:
    if name.upper() not in _FUNCTIONS:
        raise UnknownFunction(f"there is no function {name}; known: {', '.join(sorted(_FUNCTIONS))}")
    least, most, make = _FUNCTIONS[name.upper()]
    if len(args) < least or (most is not None and len(args) > most):
        raise ArityError(f"{name.upper()} takes {least if most == least else f'{least} or more'} arguments, not {len(args)}")
    return make(*args)
