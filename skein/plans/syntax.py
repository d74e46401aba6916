"""Syntax trees of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Ex:
    """An expression: what it is, its parts, and its own data."""

    op: str
    args: tuple = ()
    data: Any = None

    def walk(self):
        yield self
        for a in self.args:
            if isinstance(a, Ex):
                yield from a.walk()


@dataclass(frozen=True)
class NodePattern:
    var: str
    label: Any = None
    props: tuple = ()
    where: Ex | None = None
    named: bool = True


@dataclass(frozen=True)
class EdgePattern:
    """ways: subset of R, L, U. quantifier: (least, most or None), or ``?``."""

    var: str
    ways: frozenset
    label: Any = None
    props: tuple = ()
    where: Ex | None = None
    quantifier: Any = None
    named: bool = True


@dataclass(frozen=True)
class Chain:
    items: tuple
    path: str | None = None


@dataclass(frozen=True)
class Match:
    chains: tuple
    where: Ex | None = None
    optional: bool = False
    selector: Any = None
    mode: str = "WALK"
    different_edges: bool = False


@dataclass(frozen=True)
class Clause:
    """filter, let, for, order, offset, limit, call, subcall."""

    kind: str
    data: Any = None
    optional: bool = False


@dataclass(frozen=True)
class Project:
    """WITH, RETURN or SELECT. items: (expression, alias); None is ``*``."""

    items: tuple | None
    distinct: bool = False
    group: tuple | None = None
    having: Ex | None = None
    where: Ex | None = None
    final: bool = True
    nothing: bool = False


@dataclass(frozen=True)
class Query:
    """Clauses of one pipeline."""

    clauses: tuple


@dataclass(frozen=True)
class Compose:
    """Left and right by UNION, INTERSECT, EXCEPT (all or distinct) or OTHERWISE."""

    op: str
    every: bool
    left: Any
    right: Any


@dataclass(frozen=True)
class Next:
    left: Any
    right: Any


@dataclass(frozen=True)
class Change:
    """insert, set, remove, delete, merge or finish."""

    kind: str
    data: Any = None
    detach: bool = False


@dataclass(frozen=True)
class Command:
    """Catalog, session, transaction and SHOW statements."""

    kind: str
    data: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Explain:
    query: Any
