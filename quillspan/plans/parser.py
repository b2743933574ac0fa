"""From the syntax of a query to its logical plan: analysis, default operators,
collapse of what is empty or alone, limits of distances, all-negative queries.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from ..functions.analysis import Analyzer
from . import ir
from . import syntax as sx
from .syntax import QueryError

UNLIMITED = 2**31 - 1


@dataclass(frozen=True)
class FieldType:
    """kind: text (with an analyzer), string, or a type of Spark that values are cast to."""

    kind: str = "text"
    analyzer: Analyzer = field(default_factory=Analyzer)
    normalizer: Analyzer | None = None  # for terms with wildcards and such; the analyzer where unset


@dataclass(frozen=True)
class Options:
    field: str = "text"
    default_and: bool = False
    leading_wildcard: bool = False
    auto_phrase: bool = False
    phrase_slop: int = 0
    near_max: int | None = 100
    not_near_max: int | None = 50
    max_edits: int = 2
    prefix_length: int = 0

    @classmethod
    def from_request(cls, parameters: Mapping[str, str]) -> Options:
        """The request presets: df, q.op, mfe, nmax, nnmax, ldwc, ap, ps, pl; distances are unlimited and leading wildcards allowed unless said otherwise."""
        p = parameters
        limit = lambda name: None if int(p.get(name, -1)) < 0 else int(p[name])
        flag = lambda name, default: str(p.get(name, default)).lower() == "true"
        return cls(p.get("df", "text"), p.get("q.op", "OR").upper() == "AND", flag("ldwc", True), flag("ap", False), int(p.get("ps", 0)), limit("nmax"), limit("nnmax"), int(p.get("mfe", 2)), int(p.get("pl", 0)))


class Parser:
    def __init__(self, fields: Mapping[str, FieldType] | None = None, options: Options = Options()):
        self.fields, self.options = fields or {options.field: FieldType()}, options

    def parse(self, text: str) -> ir.Query:
        """A query over documents; blank text finds nothing."""
        query = self.clause(sx.parse_syntax(text), self.options.field)
        if isinstance(query, ir.Bool) and all(c.occur == "not" for c in query.clauses):
            return ir.Bool((*query.clauses, ir.Clause("must", ir.AllDocs())), query.least)
        return query

    def parse_spans(self, text: str) -> ir.Query:
        """A query over spans of the default field: neither fields nor operators nor match-all."""
        root = sx.parse_syntax(text)
        return self.spans(root, self.options.field) if root.children else ir.NOTHING

    # Boolean level

    def clause(self, node: sx.Or, field_name: str) -> ir.Query:
        if not node.children:
            return ir.NOTHING
        first, last = node.children[0], node.children[-1]
        if isinstance(first, sx.Operator) and first.name in ("AND", "OR"):
            raise QueryError("a clause begins with AND or OR")
        if isinstance(last, (sx.Operator, sx.Field)):
            raise QueryError("a clause ends with an operator or a field")
        if node.start is not None or node.end is not None:
            return self.spans(node, field_name)
        clauses: list[ir.Clause] = []
        joint = sign = None
        current = field_name
        for item in node.children:
            if isinstance(item, sx.Operator):
                if item.name in ("AND", "OR"):
                    joint, sign = item.name, None
                else:
                    sign = item.name
                continue
            if isinstance(item, sx.Field):
                current = item.name
                continue
            query = self.document_part(item, current)
            if not ir.empty(query):
                self.add(clauses, joint, sign, query)
            joint = sign = None
            current = field_name
        if not clauses:
            return ir.NOTHING
        if len(clauses) == 1 and clauses[0].occur != "not":
            return clauses[0].query
        return ir.Bool(tuple(clauses), node.least or 0)

    def add(self, clauses: list[ir.Clause], joint: str | None, sign: str | None, query: ir.Query) -> None:
        if clauses and clauses[-1].occur != "not":
            if joint == "AND":
                clauses[-1] = ir.Clause("must", clauses[-1].query)
            elif joint == "OR" and self.options.default_and:
                clauses[-1] = ir.Clause("should", clauses[-1].query)
        must = joint != "OR" if self.options.default_and else sign == "MUST" or joint == "AND"
        clauses.append(ir.Clause("not" if sign == "NOT" else "must" if must else "should", query))

    def document_part(self, item: sx.Node, name: str) -> ir.Query | None:
        if isinstance(item, sx.Or):
            query = self.clause(item, name)
            return query if ir.empty(query) or item.boost is None or isinstance(query, ir.Boosted) else ir.Boosted(query, item.boost)
        if isinstance(item, (sx.Near, sx.NotNear)):
            return self.spans(item, name)
        if item.start is not None or item.end is not None:
            return self.span_leaf(item, name)
        return boosted(self.leaf(item, name), item)

    # Leaves

    def type_of(self, name: str) -> FieldType | None:
        return self.fields.get(name)

    def leaf(self, item: sx.Node, name: str, quoted: bool = False) -> ir.Query | None:
        if isinstance(item, sx.Everything):
            return ir.AllDocs()
        kind = self.type_of(name)
        if kind is None:
            if isinstance(item, sx.Term):
                return ir.TermIs(name, item.text)
            raise QueryError(f"{name} is no field")
        if kind.kind != "text":
            match item:
                case sx.Term():
                    return ir.Typed(name, "=", item.text)
                case sx.Range():
                    return ir.Typed(name, "range", item.low, item.high, item.with_low, item.with_high)
                case sx.Prefix() if kind.kind == "string":
                    return ir.Typed(name, "prefix", item.text)
            raise QueryError(f"{name} is no text")
        norm = (kind.normalizer or kind.analyzer).normalize
        match item:
            case sx.Term():
                return self.new_term(name, kind.analyzer, item.text, item.quoted or quoted or self.options.auto_phrase)
            case sx.Fuzzy():
                edits = self.options.max_edits if item.edits is None else min(item.edits, self.options.max_edits)
                return self.new_fuzzy(name, norm(item.text), edits, self.options.prefix_length if item.prefix is None else item.prefix, item.swaps)
            case sx.Wildcard():
                if not self.options.leading_wildcard and item.text[:1] in ("*", "?"):
                    raise QueryError("a wildcard begins a term")
                return self.new_wildcard(name, norm(item.text))
            case sx.Prefix():
                return self.new_prefix(name, norm(item.text))
            case sx.Range():
                return self.new_range(name, *(None if x is None else norm(x) for x in (item.low, item.high)), item.with_low, item.with_high)
            case sx.Regex():
                return self.new_regex(name, item.text)
        raise QueryError(f"{type(item).__name__} is no term")

    # Leaves of texts, for subclasses to make otherwise

    def new_term(self, name: str, analyzer: Analyzer, text: str, phrase: bool) -> ir.Query | None:
        return self.analyzed(name, analyzer, text, phrase)

    def new_fuzzy(self, name: str, text: str, edits: int, prefix: int, swaps: bool) -> ir.Query:
        return ir.TermIs(name, text) if not edits else ir.Similar(name, text, edits, prefix, swaps)

    def new_wildcard(self, name: str, pattern: str) -> ir.Query:
        return ir.Glob(name, pattern)

    def new_prefix(self, name: str, text: str) -> ir.Query:
        return ir.StartsWith(name, text)

    def new_range(self, name: str, low: str | None, high: str | None, with_low: bool, with_high: bool) -> ir.Query:
        return ir.Between(name, low, high, with_low, with_high)

    def new_regex(self, name: str, pattern: str) -> ir.Query:
        return ir.Matches(name, pattern)

    def analyzed(self, name: str, analyzer: Analyzer, text: str, phrase: bool) -> ir.Query | None:
        found = analyzer.analyze(text)
        parts = [ir.any_of([ir.TermIs(name, t) for t in terms]) for _, terms in found]
        if not parts:
            return None
        if len(parts) == 1 or not phrase:
            return ir.any_of(parts)
        holes = found[-1][0] - found[0][0] - (len(found) - 1)
        return ir.NearBy(tuple(parts), holes, True)

    # Spans

    def span_leaf(self, item: sx.Node, name: str) -> ir.Query | None:
        query = self.leaf(item, name)
        if isinstance(query, (ir.AllDocs, ir.Typed)):
            raise QueryError("what has no positions is in a near clause or has a position range")
        return boosted(query if ir.empty(query) else within(query, item), item)

    def spans(self, node: sx.Node, name: str) -> ir.Query:
        children = node.children
        if any(isinstance(c, (sx.Operator, sx.Field, sx.Everything)) for c in children):
            raise QueryError("operators, fields and match-all have no place among spans")
        if isinstance(node, sx.Near) and len(children) == 1 and isinstance(children[0], sx.Term):
            query = self.leaf(children[0], name, True)
            if isinstance(query, ir.NearBy):
                slop = self.options.phrase_slop if node.slop is None else node.slop
                query = self.near(list(query.children), slop, True if node.ordered is None else node.ordered)
            return self.finished(query, node)
        parts = [self.spans(c, name) if isinstance(c, (sx.Or, sx.Near, sx.NotNear)) else self.span_leaf(c, name) for c in children]
        if isinstance(node, sx.Or):
            query = ir.any_of(parts)
        elif isinstance(node, sx.Near):
            slop = self.options.phrase_slop if node.slop is None else node.slop
            query = self.near(parts, slop, slop == 0 if node.ordered is None else node.ordered)
        else:
            query = self.not_near(parts, node.pre, node.post)
        return self.finished(query, node)

    def finished(self, query: ir.Query | None, node: sx.Node) -> ir.Query:
        return ir.NOTHING if ir.empty(query) else boosted(within(query, node), node)

    def near(self, parts: list[ir.Query | None], slop: int, ordered: bool) -> ir.Query:
        """Stop words between the first and the last part widen the distance by one each."""
        some = [k for k, p in enumerate(parts) if not ir.empty(p)]
        if not some:
            return ir.NOTHING
        kept = tuple(parts[k] for k in some)
        if len(kept) == 1:
            only = kept[0]
            return ir.NearBy(only.children, slop, ordered) if isinstance(only, ir.NearBy) else only
        slop += some[-1] - some[0] + 1 - len(some)
        return ir.NearBy(kept, limited(slop, self.options.near_max), ordered)

    def not_near(self, parts: list[ir.Query | None], pre: int | None, post: int | None) -> ir.Query:
        if len(parts) != 2:
            raise QueryError(f"not-near has two parts, not {len(parts)}")
        include, exclude = parts
        if ir.empty(include) or ir.empty(exclude):
            return ir.NOTHING if ir.empty(include) else include
        pre = pre or 0
        post = pre if post is None else post
        return ir.NotNearBy(include, exclude, limited(pre, self.options.not_near_max), limited(post, self.options.not_near_max))


def limited(distance: int, most: int | None) -> int:
    return min(distance, UNLIMITED if most is None else most)


def within(query: ir.Query, node: sx.Node) -> ir.Query:
    return query if node.start is None and node.end is None else ir.Within(query, node.start, node.end)


def boosted(query: ir.Query | None, node: sx.Node) -> ir.Query | None:
    return query if ir.empty(query) or node.boost is None or isinstance(query, ir.Boosted) else ir.Boosted(query, node.boost)
