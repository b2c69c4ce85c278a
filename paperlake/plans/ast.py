"""What the parser makes of a statement."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Path:
    text: str


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    name: str
    path: str | None
    distinct: bool = False

    @property
    def label(self) -> str:
        return f"{self.name}({'DISTINCT ' if self.distinct else ''}{self.path or '*'})"


@dataclass(frozen=True)
class Compare:
    left: Path | Call | Aggregate
    op: str
    right: Path | Literal | Call


@dataclass(frozen=True)
class In:
    left: Path | Call
    values: tuple


@dataclass(frozen=True)
class Like:
    left: Path | Call
    pattern: str


@dataclass(frozen=True)
class IsNull:
    path: Path | Call


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Item:
    value: Path | Aggregate | Call
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str
    collection: str
    on: tuple[tuple[str, str], ...]
    alias: str | None = None


@dataclass
class Select:
    items: list[Item] | None  # None: the whole document
    collection: str
    joins: list[Join] = field(default_factory=list)
    where: object = None
    group: list[str] = field(default_factory=list)
    having: object = None
    distinct: bool = False
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    alias: str | None = None


@dataclass
class Insert:
    collection: str
    json: str | None = None
    values: dict[str, object] | None = None


@dataclass
class Update:
    collection: str
    sets: list[tuple[str, object]]
    where: object = None


@dataclass
class Delete:
    collection: str
    where: object = None


@dataclass
class CreateIndex:
    name: str
    collection: str
    paths: list[str]
    unique: bool = False


@dataclass
class DropIndex:
    name: str
    collection: str
