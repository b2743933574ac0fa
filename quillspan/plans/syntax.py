"""Query strings as syntax trees: one pass over the characters, clauses by recursion.

Inside a near clause words such as AND are ordinary terms; fields, counts of
required clauses and match-all belong to Boolean clauses only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace


class QueryError(ValueError):
    """A query string that has no meaning."""


@dataclass(frozen=True)
class Node:
    boost: float | None = None
    start: int | None = None
    end: int | None = None


@dataclass(frozen=True)
class Term(Node):
    text: str = ""
    quoted: bool = False


@dataclass(frozen=True)
class Fuzzy(Node):
    text: str = ""
    edits: int | None = None
    prefix: int | None = None
    swaps: bool = True


@dataclass(frozen=True)
class Wildcard(Node):
    text: str = ""


@dataclass(frozen=True)
class Prefix(Node):
    text: str = ""


@dataclass(frozen=True)
class Regex(Node):
    text: str = ""


@dataclass(frozen=True)
class Range(Node):
    low: str | None = None
    high: str | None = None
    with_low: bool = True
    with_high: bool = True


@dataclass(frozen=True)
class Everything(Node):
    pass


@dataclass(frozen=True)
class Or(Node):
    children: tuple = ()
    least: int | None = None


@dataclass(frozen=True)
class Near(Node):
    children: tuple = ()
    slop: int | None = None
    ordered: bool | None = None


@dataclass(frozen=True)
class NotNear(Node):
    children: tuple = ()
    pre: int | None = None
    post: int | None = None


@dataclass(frozen=True)
class Operator:
    name: str  # AND OR NOT MUST


@dataclass(frozen=True)
class Field:
    name: str


CLOSERS = {"(": ")", "[": "]", "{": "}", '"': '"'}
BREAKS = set("{}()[]^")
DEFAULT_LEAST = 2


def unescaped(text: str) -> str:
    return re.sub(r"\\(.?)", r"\1", text, flags=re.S)


class Scanner:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.near = 0  # open near clauses
        self.quote = False

    def peek(self, ahead: int = 0) -> str:
        return self.text[self.at + ahead : self.at + ahead + 1]

    def take(self, pattern: str) -> re.Match | None:
        if m := re.compile(pattern, re.S).match(self.text, self.at):
            self.at = m.end()
        return m

    def breaks(self, ahead: int = 0) -> bool:
        c = self.peek(ahead)
        return not c or c.isspace() or c in BREAKS

    # Suffixes

    def boost(self) -> float | None:
        if self.peek() != "^":
            return None
        rest = self.text[self.at + 1 : self.at + 2]
        if rest in ("-", "+") and rest:
            raise QueryError("a boost has no sign")
        m = re.compile(r"\^(\d+\.?\d*|\.\d*)").match(self.text, self.at)
        if not m:
            return None
        if m[1] == ".":
            raise QueryError("'.' is no boost")
        self.at = m.end()
        if self.peek() == "^":
            raise QueryError("a boost ends in '^'")
        return float(m[1])

    def positions(self, strict: bool) -> tuple[int | None, int | None] | None:
        """A range @a..b, @a.. or @..b; None if there is none. strict: what begins like one must be one."""
        if self.peek() != "@":
            return None
        m = re.compile(r"@(\d*)\.\.(\d*)").match(self.text, self.at)
        if not m or not (m[1] or m[2]):
            if strict:
                raise QueryError("a position range reads @2..10, @..10 or @2..")
            return None
        self.at = m.end()
        if not self.breaks():
            raise QueryError("a position range ends within a term")
        a, b = (int(x) if x else None for x in m.groups())
        return (b, a) if a is not None and b is not None and a > b else (a, b)

    def suffixed(self, node: Node) -> Node:
        boost = self.boost()
        span = self.positions(True)
        if span and boost is None:
            boost = self.boost()
        start, end = span or (None, None)
        return replace(node, boost=boost, start=start, end=end)

    # Terms

    def delimited(self, mark: str) -> str:
        """What stands between two marks; a doubled mark is one."""
        m = self.take(f"{mark}((?:[^{mark}]|{mark}{mark})*){mark}")
        if not m:
            raise QueryError(f"no matching {mark}")
        if not m[1]:
            raise QueryError(f"nothing between {mark} and {mark}")
        return m[1].replace(mark * 2, mark)

    def fuzzy(self, raw: str, wild: int) -> Node:
        if wild:
            raise QueryError("wildcards in fuzzy terms need escapes")
        self.at += 1
        swaps = not self.take(">")
        if self.peek() in ("-", "+") and self.peek():
            raise QueryError("edits have no sign")
        m = self.take(r"\d+\.?\d*|\.\d+")
        if m and float(m[0]) != int(float(m[0])):
            raise QueryError("edits are whole numbers")
        prefix = self.take(r",(\d+)")
        return self.suffixed(Fuzzy(text=unescaped(raw), edits=int(float(m[0])) if m else None, prefix=int(prefix[1]) if prefix else None, swaps=swaps))

    def word(self, raw: str, stars: int, marks: int, items: list, boost: float | None = None, span: tuple | None = None) -> None:
        start, end = span or (None, None)
        if raw == "*" and items and items[-1] == Field("*"):
            items[-1] = Everything(boost=boost)
            return
        if not self.near and raw in ("AND", "OR", "NOT"):
            if boost is not None or span:
                raise QueryError("an operator has no boost")
            operator(items, raw)
            return
        text = raw if marks else unescaped(raw)
        kind = Term
        if stars + marks:
            kind = Prefix if stars == 1 and not marks and len(text) > 1 and text.endswith("*") else Wildcard
        items.append(kind(text=text[:-1] if kind is Prefix else text, boost=boost, start=start, end=end))

    # Clauses

    def items(self, opener: str) -> tuple[list, str]:
        """The parts of a clause, and the character that ended it."""
        items: list = []
        raw, stars, marks = "", 0, 0

        def flush(boost: float | None = None, span: tuple | None = None) -> None:
            nonlocal raw, stars, marks
            if raw:
                self.word(raw, stars, marks, items, boost, span)
            raw, stars, marks = "", 0, 0

        while True:
            c = self.peek()
            if not c:
                flush()
                if opener:
                    raise QueryError(f"no matching end of {opener}")
                return items, ""
            if c.isspace():
                flush()
                self.at += 1
            elif c == "~" and raw:
                items.append(self.fuzzy(raw, stars + marks))
                raw, stars, marks = "", 0, 0
            elif c == "@" and raw and (span := self.positions(False)):
                flush(self.boost(), span)
            elif c == "^" and raw and (boost := self.boost()) is not None:
                flush(boost, self.positions(False))
            elif c in "'/":
                flush()
                text = self.delimited(c)
                items.append(self.suffixed(Term(text=text, quoted=True) if c == "'" else Regex(text=text)))
            elif c == "\\":
                if self.at + 1 == len(self.text):
                    raise QueryError("a query can't end in \\")
                if m := self.take(r"\\u([0-9a-fA-F]{4})"):
                    raw += chr(int(m[1], 16))
                elif self.peek(1) == "u":
                    raise QueryError("\\u needs four hexadecimal digits")
                else:
                    raw += self.text[self.at : self.at + 2]
                    self.at += 2
            elif c == ":":
                if not raw or self.near or (items and isinstance(items[-1], Field)):
                    raise QueryError("a field needs a name, belongs to a term or clause and can't be in a near clause")
                items.append(Field(unescaped(raw)))
                raw, stars, marks = "", 0, 0
                self.at += 1
            elif c == '"' and self.quote or c in ")]}":
                flush()
                self.at += 1
                if not opener or (c != CLOSERS[opener] and not (opener in "[{" and c in "]}")):
                    raise QueryError(f"{c} ends no clause")
                return items, c
            elif c in CLOSERS:
                flush()
                self.at += 1
                items.append(self.clause(c))
            elif c in "+-" and not raw and self.peek(1) and not self.peek(1).isspace():
                operator(items, "MUST" if c == "+" else "NOT")
                self.at += 1
            elif c == "!" and not raw and not self.near and not self.breaks(1):
                operator(items, "NOT")
                self.at += 1
            elif c in "&|" and not raw and self.peek(1) == c and self.breaks(2) and not (c == "&" and self.near):
                operator(items, "AND" if c == "&" else "OR")
                self.at += 2
            else:
                stars += c == "*"
                marks += c == "?"
                raw += c
                self.at += 1

    def clause(self, opener: str) -> Node:
        near = opener != "("
        quote = self.quote
        self.near += near
        self.quote = opener == '"'
        items, closer = self.items(opener)
        self.near -= near
        self.quote = quote
        if not near:
            least = None
            if m := self.take(r"~(\d*)"):
                if self.near:
                    raise QueryError("a near clause holds no count of required clauses")
                least = int(m[1]) if m[1] else DEFAULT_LEAST
            node = self.suffixed(Or(children=tuple(items), least=least))
            if least is not None and (node.start is not None or node.end is not None):
                raise QueryError("a clause has a count of required clauses or a position range, not both")
            return node
        curly = opener == "{" or closer == "}"
        if m := self.take(r"!~(\d*)(?:,(\d*))?"):
            pre = int(m[1]) if m[1] else None
            node = NotNear(children=tuple(items), pre=pre, post=int(m[2]) if m[2] else pre)
        elif self.peek() == "!":
            raise QueryError("not-near is written !~")
        elif m := self.take(r"~(>?)(\d*)"):
            if curly:
                raise QueryError("curly brackets are for ranges, which have no distance")
            node = Near(children=tuple(items), slop=int(m[2]) if m[2] else None, ordered=bool(m[1]))
        else:
            node = Near(children=tuple(items))
            if opener != '"' and len(items) == 3 and items[1] == Term(text="TO") and all(isinstance(x, (Term, Fuzzy, Wildcard, Prefix, Regex, Range)) for x in items):
                node = Range(low=bound(items[0]), high=bound(items[2]), with_low=opener == "[", with_high=closer == "]")
            elif curly:
                raise QueryError("curly brackets are for ranges")
        return self.suffixed(node)


def bound(node: Node) -> str | None:
    if isinstance(node, Wildcard) and node.text == "*":
        return None
    if isinstance(node, Term):
        return node.text
    raise QueryError(f"a range has no {type(node).__name__.lower()} in it")


def operator(items: list, name: str) -> None:
    if items and isinstance(items[-1], Operator):
        before = items[-1].name
        if before in ("NOT", "MUST") or before == name == "AND" or before == "OR" and name in ("AND", "OR"):
            raise QueryError("operators follow each other")
    items.append(Operator(name))


def parse_syntax(text: str) -> Or:
    """The query as one Boolean clause; one without parts for blank text."""
    scanner = Scanner(text)
    return Or(children=tuple(scanner.items("")[0]))
