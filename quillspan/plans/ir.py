"""The logical plan of a query: what to find, with terms as the index has them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Query:
    pass


@dataclass(frozen=True)
class Leaf(Query):
    """Tokens of a field with a property; spans of one token."""

    field: str


@dataclass(frozen=True)
class TermIs(Leaf):
    term: str


@dataclass(frozen=True)
class StartsWith(Leaf):
    prefix: str


@dataclass(frozen=True)
class Glob(Leaf):
    pattern: str


@dataclass(frozen=True)
class Matches(Leaf):
    pattern: str


@dataclass(frozen=True)
class Between(Leaf):
    low: str | None
    high: str | None
    with_low: bool = True
    with_high: bool = True


@dataclass(frozen=True)
class Similar(Leaf):
    """Within so many edits; swaps of neighbours count as one up to two edits, beyond that they are no edits of their own."""

    term: str
    edits: int
    prefix: int = 0
    swaps: bool = True


@dataclass(frozen=True)
class AnyOf(Query):
    children: tuple[Query, ...] = ()


@dataclass(frozen=True)
class NearBy(Query):
    children: tuple[Query, ...]
    slop: int
    ordered: bool


@dataclass(frozen=True)
class NotNearBy(Query):
    include: Query
    exclude: Query
    pre: int
    post: int


@dataclass(frozen=True)
class Within(Query):
    """Spans of child with start >= low and end <= high."""

    child: Query
    low: int | None
    high: int | None


@dataclass(frozen=True)
class AllDocs(Query):
    pass


@dataclass(frozen=True)
class Typed(Query):
    """Documents whose column (not a text) equals value or lies in a range."""

    field: str
    op: str  # = prefix range
    value: str | None = None
    high: str | None = None
    with_low: bool = True
    with_high: bool = True


@dataclass(frozen=True)
class Clause:
    occur: str  # must should not
    query: Query


@dataclass(frozen=True)
class Bool(Query):
    clauses: tuple[Clause, ...]
    least: int = 0  # of the should clauses


@dataclass(frozen=True)
class Boosted(Query):
    """Same matches; the factor is for rankings."""

    child: Query
    factor: float


NOTHING = AnyOf(())


def empty(query: Query | None) -> bool:
    return query is None or query == NOTHING


def plain(query: Query) -> Query:
    """Without boosts."""
    match query:
        case Boosted(child, _):
            return plain(child)
        case AnyOf(children):
            return AnyOf(tuple(plain(c) for c in children))
        case NearBy(children, slop, ordered):
            return NearBy(tuple(plain(c) for c in children), slop, ordered)
        case NotNearBy(a, b, pre, post):
            return NotNearBy(plain(a), plain(b), pre, post)
        case Within(child, low, high):
            return Within(plain(child), low, high)
        case Bool(clauses, least):
            return Bool(tuple(Clause(c.occur, plain(c.query)) for c in clauses), least)
    return query


def leaves(query: Query) -> list[Leaf]:
    """The distinct leaves, in order of first mention."""
    out: dict[Leaf, None] = {}

    def walk(q: Query) -> None:
        match q:
            case Leaf():
                out[q] = None
            case AnyOf(children) | NearBy(children, _, _):
                for c in children:
                    walk(c)
            case NotNearBy(a, b, _, _):
                walk(a), walk(b)
            case Within(child, _, _) | Boosted(child, _):
                walk(child)
            case Bool(clauses, _):
                for c in clauses:
                    walk(c.query)

    walk(query)
    return list(out)


class UnknownQuery(ValueError):
    pass


def refuse(query: Query, field: str) -> Query:
    raise UnknownQuery(f"{type(query).__name__} can't be told as spans of {field}")


def as_spans(query: Query, field: str, unknown: Callable[[Query, str], Query] = refuse) -> Query:
    """A query over documents as one over spans of a field.

    Clauses that are not prohibited and concern the field become alternatives;
    match-all and what concerns other fields become nothing. What is of a kind
    of its own is unknown's to tell.
    """
    match query:
        case AllDocs() | Typed():
            return NOTHING
        case Leaf():
            return query if query.field == field else NOTHING
        case Bool(clauses, _):
            parts = [as_spans(c.query, field, unknown) for c in clauses if c.occur != "not"]
            return any_of(parts)
        case AnyOf(children):
            return any_of([as_spans(c, field, unknown) for c in children])
        case NearBy(children, slop, ordered):
            parts = tuple(as_spans(c, field, unknown) for c in children)
            return NOTHING if any(empty(p) for p in parts) else NearBy(parts, slop, ordered)
        case NotNearBy(a, b, pre, post):
            a, b = as_spans(a, field, unknown), as_spans(b, field, unknown)
            return a if empty(a) or empty(b) else NotNearBy(a, b, pre, post)
        case Within(child, low, high):
            child = as_spans(child, field, unknown)
            return child if empty(child) else Within(child, low, high)
        case Boosted(child, factor):
            child = as_spans(child, field, unknown)
            return child if empty(child) else Boosted(child, factor)
    return unknown(query, field)


def with_terms(query: Query, field: str) -> Query:
    """as_spans, with every term that the query mentions in the field as one more alternative."""
    return any_of([as_spans(query, field), *(x for x in leaves(query) if isinstance(x, TermIs) and x.field == field)])


def any_of(parts: list[Query | None]) -> Query:
    some = list(dict.fromkeys(p for p in parts if not empty(p)))
    return NOTHING if not some else some[0] if len(some) == 1 else AnyOf(tuple(some))


def replaced(query: Query, by: dict[Leaf, Query]) -> Query:
    """query with other leaves."""
    match query:
        case Leaf():
            return by.get(query, query)
        case AnyOf(children):
            return AnyOf(tuple(replaced(c, by) for c in children))
        case NearBy(children, slop, ordered):
            return NearBy(tuple(replaced(c, by) for c in children), slop, ordered)
        case NotNearBy(a, b, pre, post):
            return NotNearBy(replaced(a, by), replaced(b, by), pre, post)
        case Within(child, low, high):
            return Within(replaced(child, by), low, high)
        case Boosted(child, factor):
            return Boosted(replaced(child, by), factor)
        case Bool(clauses, least):
            return Bool(tuple(Clause(c.occur, replaced(c.query, by)) for c in clauses), least)
    return query
