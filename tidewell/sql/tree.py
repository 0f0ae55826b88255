"""Syntax tree of the dialect. Nodes compare by structure; positions don't count."""

from __future__ import annotations

from dataclasses import dataclass, field


class DialectError(ValueError):
    """A diagnostic with the position it is about (1-based; 0 where there is none)."""

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{line}:{column}: {message}" if line else message)
        self.message, self.line, self.column = message, line, column


def at() -> tuple[int, int]:
    return field(default=(0, 0), compare=False, repr=False)


@dataclass(frozen=True)
class Literal:
    value: object
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Name:
    alias: str | None
    column: str
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Star:
    alias: str | None = None
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Access:
    """JSON step: key is a member name or an index; text for ->>."""

    base: object
    key: str | int
    text: bool
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class InQuery:
    arg: object
    query: object
    negated: bool
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Exists:
    query: object
    negated: bool
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class ScalarQuery:
    query: object
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None


@dataclass(frozen=True)
class Source:
    name: str
    alias: str
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Derived:
    query: object
    alias: str
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Unnest:
    expr: object
    alias: str
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, full, cross, unnest
    source: object
    within: int | None = None
    on: object = None
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Window:
    kind: str  # tumbling, hopping, session
    size: int
    advance: int | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: object
    joins: tuple[Join, ...] = ()
    where: object = None
    latest_by: tuple = ()
    group_by: tuple = ()
    group_all: bool = False
    window: Window | None = None
    emit: str | None = None
    pos: tuple[int, int] = at()


@dataclass(frozen=True)
class Union:
    branches: tuple
    distinct: bool
    pos: tuple[int, int] = at()


def children(node) -> tuple:
    """Direct expression children; subqueries are not entered."""
    match node:
        case Unary(arg=a) | InQuery(arg=a) | Access(base=a):
            return (a,)
        case Binary(left=a, right=b):
            return (a, b)
        case Call(args=args):
            return args
    return ()


def walk(node):
    yield node
    for c in children(node):
        yield from walk(c)
