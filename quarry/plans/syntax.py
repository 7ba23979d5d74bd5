"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from quarry.schema import ColumnDef, IndexKind


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class Between:
    column: str
    low: Any
    high: Any


@dataclass(frozen=True)
class Flag:
    column: str


@dataclass(frozen=True)
class Rectangle:
    column: str
    x0: float
    y0: float
    x1: float
    y1: float


@dataclass(frozen=True)
class Circle:
    column: str
    x: float
    y: float
    radius: float


@dataclass(frozen=True)
class Nearest:
    column: str
    x: float
    y: float
    k: int


@dataclass(frozen=True)
class Not:
    inner: Predicate


@dataclass(frozen=True)
class Both:
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Either:
    left: Predicate
    right: Predicate


Predicate = Compare | Between | Flag | Rectangle | Circle | Nearest | Not | Both | Either


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] | None
    where: Predicate | None = None
    order_by: str | None = None
    ascending: bool = True
    limit: int | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable:
    table: str
    if_exists: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: Predicate | None


@dataclass(frozen=True)
class CreateIndex:
    index: str
    table: str
    columns: tuple[str, ...]
    kind: IndexKind | None = None


@dataclass(frozen=True)
class DropIndex:
    index: str
    table: str


Statement = Select | CreateTable | DropTable | Insert | Delete | CreateIndex | DropIndex
