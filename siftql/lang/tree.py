"""The nodes of expressions and statements."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


class Node:
    pass


@dataclass(frozen=True)
class Lit(Node):
    value: Any  # int, float, str, bool or None


@dataclass(frozen=True)
class Name(Node):
    parts: tuple[str, ...]

    @property
    def text(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Variable(Node):
    name: str


@dataclass(frozen=True)
class Param(Node):
    index: int


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Binary(Node):
    op: str  # = != < <= > >= + - * / % and or in like contains intersects
    left: Node
    right: Node
    negated: bool = False


@dataclass(frozen=True)
class Group(Node):
    """``AND (a, b, ...)`` or ``OR (...)``."""

    op: str
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Unary(Node):
    op: str  # not, -, exists, is null, is not null
    item: Node


@dataclass(frozen=True)
class Between(Node):
    item: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class Items(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Include(Node):
    name: str


@dataclass(frozen=True)
class Everything(Node):
    """``*`` as a filter or a projection."""

    qualifier: str | None = None


@dataclass(frozen=True)
class Column(Node):
    expr: Node
    alias: str | None = None
    guard: Node | None = None


@dataclass(frozen=True)
class Source(Node):
    table: str | None = None
    query: Select | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Join(Node):
    kind: str  # inner left right full cross left_semi left_anti
    source: Source
    on: Node | None


@dataclass(frozen=True)
class Order(Node):
    expr: Node
    descending: bool = False


@dataclass(frozen=True)
class Select(Node):
    columns: tuple[Column, ...]
    source: Source | None = None
    joins: tuple[Join, ...] = ()
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False
    into: str | None = None
    options: dict = field(default_factory=dict, compare=False)
    alias: str | None = None
    filtered: bool = False  # written with FILTER: unknown names are missing, not errors


@dataclass(frozen=True)
class Filter(Node):
    expr: Node
    source: str | None = None
    limit: int | None = None
    options: dict = field(default_factory=dict, compare=False)
    alias: str | None = None


@dataclass(frozen=True)
class Insert(Node):
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Node, ...], ...] = ()
    query: Select | None = None
    verb: str = "insert"  # insert, replace, upsert


@dataclass(frozen=True)
class Update(Node):
    table: str
    values: tuple[tuple[str, Node], ...]
    where: Node | None


@dataclass(frozen=True)
class Delete(Node):
    table: str
    where: Node | None


@dataclass(frozen=True)
class Command(Node):
    """SET, USE, SHOW, DESCRIBE, EXPLAIN, CREATE, DROP, ALTER, PREPARE, COMMIT, ROLLBACK."""

    verb: str
    what: str = ""
    name: str | None = None
    args: tuple = ()
    where: Node | None = None
    like: str | None = None
    full: bool = False
    options: dict = field(default_factory=dict, compare=False)
    statement: Node | None = None


def walk(node):
    """All nodes of a tree, parents first."""
    if isinstance(node, Node):
        yield node
        for f in fields(node):
            yield from walk(getattr(node, f.name))
    elif isinstance(node, tuple):
        for x in node:
            yield from walk(x)


def rewrite(node, change):
    """The tree with ``change(node)`` in place of each node, children first."""
    if isinstance(node, tuple):
        return tuple(rewrite(x, change) for x in node)
    if not isinstance(node, Node):
        return node
    return change(type(node)(**{f.name: rewrite(getattr(node, f.name), change) for f in fields(node)}))


def names(node) -> list[str]:
    """Names of columns that a tree mentions, in order, once each."""
    return list(dict.fromkeys(x.text for x in walk(node) if isinstance(x, Name)))


def first_name(node) -> str | None:
    return next(iter(names(node)), None)


def includes(node) -> list[str]:
    return list(dict.fromkeys(x.name for x in walk(node) if isinstance(x, Include)))


def to_dict(node):
    """A tree as JSON-ready dicts and lists; :func:`from_dict` reverses it."""
    if is_dataclass(node):
        return {"node": type(node).__name__} | {f.name: to_dict(getattr(node, f.name)) for f in fields(node)}
    return [to_dict(x) for x in node] if isinstance(node, tuple) else node


def from_dict(value):
    if isinstance(value, dict) and "node" in value:
        return globals()[value["node"]](**{k: from_dict(v) for k, v in value.items() if k != "node"})
    return tuple(from_dict(x) for x in value) if isinstance(value, list) else value
