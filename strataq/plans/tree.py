"""What a statement means, as small immutable parts."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Test:
    attribute: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Neither:
    """NOT of its one part."""

    parts: tuple


@dataclass(frozen=True)
class Item:
    """A select item: an attribute, ``*``, an aggregate, a scalar or a window function.

    ``arguments`` are the literals behind the attribute; ``frame`` is (ROWS or RANGE,
    first, last), with None for an unbounded side.
    """

    attribute: str
    function: str | None = None
    alias: str | None = None
    partition_by: tuple[str, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()
    over: bool = False
    arguments: tuple = ()
    distinct: bool = False
    frame: tuple | None = None


@dataclass(frozen=True)
class Query:
    kind: str  # SELECT, FIND, WATCH
    collection: str | None = None
    items: tuple[Item, ...] = ()
    distinct: bool = False
    joins: tuple[tuple[str, str, str, str], ...] = ()  # collection, left and right attribute, kind
    where: Any = None
    match: tuple[str, str, int | None] | None = None
    similar: tuple[str, int, float | None] | None = None
    traverse: tuple[str, int, str | None] | None = None
    rank_by: str | None = None
    group_by: tuple[str, ...] = ()
    grouping: str = "groupBy"  # groupBy, rollup, cube
    having: Any = None
    order_by: tuple[str, bool] | None = None
    as_of: tuple[str, str] | None = None
    limit: int | None = None
    offset: int | None = None
    ctes: tuple[tuple[str, Any], ...] = ()
    recursive: bool = False
    combined: tuple[tuple[str, bool, Any], ...] = ()  # UNION, INTERSECT or EXCEPT, whether ALL, query


@dataclass(frozen=True)
class Mutation:
    kind: str  # INSERT, UPDATE, DELETE
    collection: str
    key: str | None
    values: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Definition:
    kind: str  # CREATE, ALTER ADD, ALTER DROP, DROP
    object: str  # COLLECTION, BRANCH
    name: str
    attributes: tuple = ()


@dataclass(frozen=True)
class Explain:
    query: Query
    analyze: bool = False


@dataclass(frozen=True)
class Show:
    what: str
