"""Queries as DataFrames: documents and spans of tokens that match.

Documents are tokenised where they lie, once a query. What can be told from a
document's own row (terms, alternatives, phrases, positions, Boolean groups of
them) is a filter without a shuffle. Near and not-near groups move only the
matches of their parts, hashed by document, and find partners by running
windows over them, so that a document with many matches takes linear time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import ir
from ..plans.parser import FieldType, Options, Parser, QueryError

JOINER = " | "
SPAN = "array<struct<s:int,e:int>>"
VERSION = "__version"


@dataclass(frozen=True)
class Corpus:
    """Documents, a row each; a text field is a string or an array of strings.

    Rows with a null key are left out. Rows that repeat a key are documents of
    their own that share a name: spans and windows are of one row, and counts of
    documents are of rows. What is told by key names each once.
    """

    docs: DataFrame
    key: str = "doc_id"
    fields: Mapping[str, FieldType] = field(default_factory=lambda: {"text": FieldType()})
    options: Options = Options()

    def parse(self, text: str) -> ir.Query:
        return Parser(self.fields, self.options).parse(text)

    def parse_spans(self, text: str) -> ir.Query:
        return Parser(self.fields, self.options).parse_spans(text)

    def rows(self) -> DataFrame:
        return self.docs.where(F.col(self.key).isNotNull())

    def version(self, name: str) -> Column:
        """Tells apart rows that repeat a key: a hash of the field, as rows with the same text have the same spans."""
        return F.xxhash64(name).alias(VERSION)

    def many(self, name: str) -> bool:
        return dict(self.docs.dtypes)[name].startswith("array")

    def type_of(self, name: str) -> FieldType:
        if name not in self.docs.columns:
            raise QueryError(f"{name} is no field")
        return self.fields.get(name, FieldType())

    def values(self, name: str) -> Column:
        """The values of a field with many that have tokens."""
        a = self.type_of(name).analyzer
        return F.filter(F.transform(F.col(name), a.filtered), lambda v: F.size(a.raw_tokens(v)) > 0)

    def raw(self, name: str) -> Column:
        """Tokens by position as they stand in the text; null between values."""
        a = self.type_of(name).analyzer
        if not self.many(name):
            return a.raw_tokens(a.filtered(F.col(name)))
        gap = F.array_repeat(F.lit(None).cast("string"), a.position_gap)
        return F.flatten(F.transform(self.values(name), lambda v, i: F.when(i > 0, F.concat(gap, a.raw_tokens(v))).otherwise(a.raw_tokens(v))))

    def between(self, name: str, texts: str) -> tuple[Column, Column]:
        """(text, length in characters) before each token and after the last; the lengths may be told from a column of the texts."""
        a = self.type_of(name).analyzer
        if not self.many(name):
            return a.between(a.filtered(F.col(name))), F.transform(texts, lambda g: F.length(g))
        values = self.values(name)

        def shown(v: Column, i: Column) -> Column:
            parts, before = a.between(v), F.element_at(a.between(F.get(values, i - 1)), -1)
            inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
            if not a.position_gap:
                later = F.concat(F.array(F.concat(before, F.lit(JOINER), F.get(parts, 0))), inner)
            else:
                later = F.concat(F.array(before), F.array_repeat(F.lit(""), a.position_gap - 1), F.array(F.concat(F.lit(JOINER), F.get(parts, 0))), inner)
            return F.when(i > 0, later).otherwise(F.concat(F.array(F.get(parts, 0)), inner))

        def sizes(v: Column, i: Column) -> Column:
            parts = F.transform(a.between(v), lambda g: F.length(g))
            inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
            before = F.length(F.element_at(a.between(F.get(values, i - 1)), -1)) + a.offset_gap
            later = F.concat(F.array_repeat(F.lit(0), a.position_gap), F.array(before + F.get(parts, 0)), inner)
            return F.when(i > 0, later).otherwise(F.concat(F.array(F.get(parts, 0)), inner))

        last = F.element_at(a.between(F.element_at(values, -1)), -1)
        return F.concat(F.flatten(F.transform(values, shown)), F.array(last)), F.concat(F.flatten(F.transform(values, sizes)), F.array(F.length(last)))

    def terms(self, name: str) -> Column:
        """Terms by position; null for holes."""
        a = self.type_of(name).analyzer
        return F.transform(self.raw(name), a.term) if a.lowercase or a.fold or a.replacements or a.stops else self.raw(name)


def once(rows: DataFrame, *columns: Column) -> DataFrame:
    """rows with columns that are told once a row. Of a plain projection, a filter above takes the expression for the name, and tells it anew for each element if that stands within a function of one."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is told once however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def synonyms_of(corpus: Corpus, name: str, term: Column) -> Column:
    """The terms at a position: its own and its synonyms."""
    known = corpus.type_of(name).analyzer.synonyms
    return reduce(lambda c, t: c.when(term == t, F.array(term, *map(F.lit, known[t]))), known, F.when(F.lit(False), F.array(term))).otherwise(F.array(term))


def stacked(corpus: Corpus, name: str, terms: Column) -> Column:
    """Terms with their synonyms, in one array."""
    return F.flatten(F.transform(terms, lambda t: synonyms_of(corpus, name, t))) if corpus.type_of(name).analyzer.synonyms else terms


def tokens(corpus: Corpus, name: str) -> DataFrame:
    """Rows (key, pos, term), one for each term of each document, synonyms too; no shuffle."""
    rows = corpus.rows().select(corpus.key, F.posexplode(corpus.terms(name)).alias("pos", "term")).where("term is not null")
    if not corpus.type_of(name).analyzer.synonyms:
        return rows
    return rows.select(corpus.key, "pos", F.explode(synonyms_of(corpus, name, F.col("term"))).alias("term"))


def bigrams(terms: str, unigrams: bool = True, joiner: str = "_") -> Column:
    """Neighbours in an array column of terms joined, as an array of (pos, term): each at its first term's position, behind that term itself if unigrams. Holes join with nothing."""

    def of(t: Column, i: Column) -> Column:
        following = F.get(F.col(terms), i + 1)
        pair = F.struct(i.alias("pos"), F.when(t.isNotNull() & following.isNotNull(), F.concat(t, F.lit(joiner), following)).alias("term"))
        return F.array(F.struct(i.alias("pos"), t.alias("term")), pair) if unigrams else F.array(pair)

    return F.filter(F.flatten(F.transform(F.col(terms), of)), lambda x: x.term.isNotNull())


# Leaves


def swapped(text: str) -> list[str]:
    return [text[:i] + text[i + 1] + text[i] + text[i + 2 :] for i in range(len(text) - 1) if text[i] != text[i + 1]]


def similar(t: Column, text: str, edits: int, swaps: bool) -> Column:
    """Within so many edits of text; with swaps, a swap of neighbours that no other edit touches is one."""
    near = F.levenshtein(t, F.lit(text), edits) >= 0
    if not swaps or not 1 <= edits <= 2:
        return near
    if swapped(text):
        near |= t.isin(swapped(text))
    if edits == 2:
        for i in range(len(text) - 1):
            head, pair, tail = text[:i], text[i + 1] + text[i], text[i + 2 :]
            near |= t.startswith(head + pair) & similar(F.substring(t, i + 3, 2**30), tail, 1, True)
            near |= t.endswith(pair + tail) & similar(t.substr(F.lit(1), F.length(t) - 2 - len(tail)), head, 1, True)
    return near


def glob(pattern: str) -> str:
    out, chars = "", iter(pattern)
    for c in chars:
        out += ".*" if c == "*" else "." if c == "?" else re.escape(next(chars, "\\") if c == "\\" else c)
    return out


def predicate(leaf: ir.Leaf, t: Column) -> Column:
    match leaf:
        case ir.TermIs(_, term):
            return t == F.lit(term)
        case ir.StartsWith(_, prefix):
            return t.startswith(prefix)
        case ir.Glob(_, pattern):
            return t.rlike(rf"(?s)\A(?:{glob(pattern)})\z")
        case ir.Matches(_, ".+"):
            return F.length(t) > 0
        case ir.Matches(_, pattern):
            if m := re.search(r"(?<!\\)[~&<>@#\"]", pattern):
                raise QueryError(f"{m[0]} in a regular expression needs an escape")
            return t.rlike(rf"(?s)\A(?:{pattern})\z")
        case ir.Between(_, low, high, with_low, with_high):
            out = F.lit(True)
            if low is not None:
                out = t >= low if with_low else t > low
            if high is not None:
                out &= t <= high if with_high else t < high
            return out & t.isNotNull()
        case ir.Similar(_, term, edits, prefix, swaps):
            if not prefix:
                return similar(t, term, edits, swaps)
            return t.startswith(term[:prefix]) & similar(F.substring(t, prefix + 1, 2**30), term[prefix:], edits, swaps)
    raise TypeError(leaf)


def expanded(corpus: Corpus, query: ir.Query, most: int) -> ir.Query:
    """query with each leaf that stands for many terms as its most frequent ones, by documents, then term: at most so many."""
    from .stats import vocabulary

    def some(leaf: ir.Leaf) -> ir.Query:
        rows = vocabulary(corpus, leaf.field).where(predicate(leaf, F.col("term"))).orderBy(F.col("df").desc(), "term").limit(most).collect()
        return ir.any_of([ir.TermIs(leaf.field, r.term) for r in rows])

    known: dict[ir.Leaf, ir.Query] = {x: x if isinstance(x, ir.TermIs) else some(x) for x in ir.leaves(query)}
    return ir.replaced(query, known)


def at_token(corpus: Corpus, query: ir.Query) -> Callable[[Column], Column] | None:
    """A condition on the term of one position; None if the query is more than terms and alternatives."""
    match query:
        case ir.Leaf():
            synonyms = corpus.type_of(query.field).analyzer.synonyms

            def test(t: Column) -> Column:
                out = predicate(query, t)
                for term, others in synonyms.items():
                    for other in others:
                        out |= (t == F.lit(term)) & predicate(query, F.lit(other))
                return out

            return test
        case ir.AnyOf(children) if children:
            tests = [at_token(corpus, c) for c in children]
            return None if None in tests else lambda t: reduce(lambda a, b: a | b, [x(t) for x in tests])
    return None


def field_of(query: ir.Query) -> str:
    names = {leaf.field for leaf in ir.leaves(query)}
    if len(names) > 1:
        raise QueryError("spans are of one field")
    return names.pop() if names else ""


# In a document's own row


def row_spans(corpus: Corpus, query: ir.Query, terms: Column) -> Column | None:
    """Sorted distinct spans as an array, from the document's terms alone; None if that takes more."""
    if test := at_token(corpus, query):
        places = F.filter(F.transform(terms, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())
        return F.transform(places, lambda i: F.struct(i.alias("s"), (i + 1).alias("e")))
    match query:
        case ir.NearBy(children, 0, True):
            tests = [at_token(corpus, c) for c in children]
            if None in tests:
                return None
            places = F.filter(F.transform(terms, lambda t, i: F.when(tests[0](t), i)), lambda i: i.isNotNull())
            after = F.filter(places, lambda i: reduce(lambda a, b: a & b, [F.coalesce(x(F.get(terms, i + k)), F.lit(False)) for k, x in enumerate(tests) if k]))
            return F.transform(after, lambda i: F.struct(i.alias("s"), (i + len(children)).alias("e")))
        case ir.Within(child, low, high):
            inner = row_spans(corpus, child, terms)
            if inner is None:
                return None
            return F.filter(inner, lambda x: (F.lit(True) if low is None else x.s >= low) & (F.lit(True) if high is None else x.e <= high))
        case ir.AnyOf(children):
            if not children:
                return F.array().cast(SPAN)
            parts = [row_spans(corpus, c, terms) for c in children]
            return None if any(p is None for p in parts) else F.array_sort(F.array_distinct(F.concat(*parts)))
        case ir.Boosted(child, _):
            return row_spans(corpus, child, terms)
    return None


def needed(corpus: Corpus, query: ir.Query) -> Column:
    """A cheap condition on the texts that every match fulfils: terms of ASCII are looked for before anything is tokenised."""
    true = F.lit(True)
    match query:
        case ir.TermIs(name, text) | ir.StartsWith(name, text):
            a = corpus.type_of(name).analyzer
            if not text.isascii() or a.fold or a.char_filters or a.replacements or a.synonyms or corpus.many(name):
                return true
            return (F.lower(F.col(name)) if a.lowercase else F.col(name)).contains(text)
        case ir.AnyOf(children) if children:
            return reduce(lambda a, b: a | b, [needed(corpus, c) for c in children])
        case ir.NearBy(children, _, _):
            return reduce(lambda a, b: a & b, [needed(corpus, c) for c in children])
        case ir.NotNearBy(child, _, _, _) | ir.Within(child, _, _) | ir.Boosted(child, _):
            return needed(corpus, child)
        case ir.Bool(clauses, _):
            must = [needed(corpus, c.query) for c in clauses if c.occur == "must"]
            should = [needed(corpus, c.query) for c in clauses if c.occur == "should"]
            return reduce(lambda a, b: a & b, must) if must else reduce(lambda a, b: a | b, should) if should else true
    return true


# Spans


def spans(corpus: Corpus, query: ir.Query, where: DataFrame | None = None) -> DataFrame:
    """Rows (key, s, e), distinct for each row of the corpus: the spans of tokens s..e that match. where: keys of the documents that count."""
    return located(corpus, query, where).select(corpus.key, "s", "e")


def located(corpus: Corpus, query: ir.Query, where: DataFrame | None = None) -> DataFrame:
    """Rows (key, VERSION, s, e) of spans(); rows that agree in key and text count once if their spans take a join."""
    return _spans(corpus, ir.plain(query), None if where is None else where.select(corpus.key))


def _source(corpus: Corpus, query: ir.Query, where: DataFrame | None) -> DataFrame:
    rows = corpus.rows().where(needed(corpus, query))
    return rows if where is None else rows.join(where, corpus.key, "left_semi")


def _tagged(corpus: Corpus, parts: list[ir.Query], where: DataFrame | None, all_needed: bool) -> DataFrame:
    """Rows (key, k, s, e): the spans of each part."""
    name = field_of(ir.AnyOf(tuple(parts)))
    terms = F.col("__terms")
    inner = [row_spans(corpus, p, terms) for p in parts]
    if all(x is not None for x in inner):
        rows = _source(corpus, ir.NearBy(tuple(parts), 0, True) if all_needed else parts[0], where).select(corpus.key, name, corpus.version(name))
        rows = once(once(rows, corpus.terms(name).alias("__terms")), *[x.alias(f"__{k}") for k, x in enumerate(inner)])
        for k in range(len(parts) if all_needed else 1):
            rows = rows.where(F.size(f"__{k}") > 0)
        tag = lambda k: lambda x: F.struct(F.lit(k).alias("k"), x.s.alias("s"), x.e.alias("e"))
        return rows.select(corpus.key, VERSION, F.inline(F.concat(*[F.transform(f"__{k}", tag(k)) for k in range(len(parts))])))
    tables = [_spans(corpus, p, where).select(corpus.key, VERSION, F.lit(k).alias("k"), "s", "e") for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tables)


def _spans(corpus: Corpus, query: ir.Query, where: DataFrame | None) -> DataFrame:
    name = field_of(query)
    if not name:
        return corpus.rows().where(F.lit(False)).select(corpus.key, F.lit(0).cast("long").alias(VERSION), F.lit(0).alias("s"), F.lit(0).alias("e"))
    inner = row_spans(corpus, query, F.col("__terms"))
    if inner is not None:
        rows = once(_source(corpus, query, where).select(corpus.key, name, corpus.version(name)), corpus.terms(name).alias("__terms"))
        return rows.select(corpus.key, VERSION, F.inline(inner))
    match query:
        case ir.AnyOf(children):
            return _tagged(corpus, list(children), where, False).select(corpus.key, VERSION, "s", "e").distinct()
        case ir.Within(child, low, high):
            out = _spans(corpus, child, where)
            out = out if low is None else out.where(F.col("s") >= low)
            return out if high is None else out.where(F.col("e") <= high)
        case ir.NearBy(children, slop, ordered):
            return (_ordered if ordered else _unordered)(corpus, list(children), slop, where)
        case ir.NotNearBy(include, exclude, pre, post):
            return _not_near(corpus, include, exclude, pre, post, where)
    raise QueryError(f"{type(query).__name__} has no spans")


def _ordered(corpus: Corpus, parts: list[ir.Query], slop: int, where: DataFrame | None) -> DataFrame:
    """From the last part back, each span learns of the chain that begins with the nearest span of the next part."""
    rows = _tagged(corpus, parts, where, True).select(corpus.key, VERSION, "k", "s", "e", F.col("e").alias("last"), F.lit(0).cast("long").alias("gaps"))
    for k in range(len(parts) - 2, -1, -1):
        target = F.col("k") == k + 1
        order = [F.when(target, F.col("s")).otherwise(F.col("e")).desc(), target.desc(), F.col("e").desc()]
        w = Window.partitionBy(corpus.key, VERSION).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        following = F.last(F.when(target, F.struct("s", "last", "gaps")), ignorenulls=True).over(w)
        rows = rows.where(F.col("k") <= k + 1).withColumn("__next", following).where((F.col("k") < k) | ((F.col("k") == k) & F.col("__next").isNotNull()))
        mine = F.col("k") == k
        rows = rows.select(
            corpus.key, VERSION, "k", "s", "e", F.when(mine, F.col("__next.last")).otherwise(F.col("last")).alias("last"),
            F.when(mine, F.col("__next.gaps") + F.col("__next.s") - F.col("e")).otherwise(F.col("gaps")).alias("gaps"),
        ).where((F.col("k") != k) | (F.col("gaps") <= slop))
    return rows.select(corpus.key, VERSION, "s", F.col("last").alias("e")).distinct()


def _unordered(corpus: Corpus, parts: list[ir.Query], slop: int, where: DataFrame | None) -> DataFrame:
    """Each span as the first one: with the nearest spans of the other parts that begin after it. Equal parts take spans of different starts."""
    kinds = list(dict.fromkeys(parts))
    times = [parts.count(p) for p in kinds]
    rows = _tagged(corpus, kinds, where, True)
    if max(times) > 1:
        rows = rows.groupBy(corpus.key, VERSION, "k", "s").agg(F.min("e").alias("e"))
        w = Window.partitionBy(corpus.key, VERSION, "k").orderBy("s")
        runs = F.array(F.struct("s", "e"), *[F.struct(F.lead("s", n).over(w).alias("s"), F.lead("e", n).over(w).alias("e")) for n in range(1, max(times))])
    else:
        runs = F.array(F.struct("s", "e"))
    rows = rows.withColumn("run", runs)
    # Frames by value: what begins after s is at s + 1 at least.
    w = Window.partitionBy(corpus.key, VERSION).orderBy(F.col("s").desc()).rangeBetween(Window.unboundedPreceding, -1)
    after = [F.last(F.when(F.col("k") == k, F.col("run")), ignorenulls=True).over(w).alias(f"__{k}") for k in range(len(kinds))]
    rows = rows.select(corpus.key, VERSION, "k", "s", "e", *after)
    out = []
    for k in range(len(kinds)):
        own = rows.where(F.col("k") == k)
        picks = [F.get(F.col(f"__{j}"), n) for j, m in enumerate(times) for n in range(m - (j == k))]
        for p in picks:
            own = own.where(p.s.isNotNull())
        far = F.greatest(F.col("e"), *[p.e for p in picks]) if picks else F.col("e")
        used = reduce(lambda a, b: a + b, [p.e - p.s for p in picks], F.col("e") - F.col("s"))
        out.append(own.where(far - F.col("s") - used <= slop).select(corpus.key, VERSION, "s", far.alias("e")))
    return reduce(DataFrame.unionByName, out).distinct()


def _not_near(corpus: Corpus, include: ir.Query, exclude: ir.Query, pre: int, post: int, where: DataFrame | None) -> DataFrame:
    """Spans of include that no span of exclude touches from pre before to post after; a running maximum of ends tells."""
    rows = _tagged(corpus, [include, exclude], where, False)
    mine = F.col("k") == 0
    w = Window.partitionBy(corpus.key, VERSION).orderBy(F.when(mine, F.col("e").cast("long") + post).otherwise(F.col("s")), F.col("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(~mine, F.col("e"))).over(w)
    return rows.withColumn("__reach", reach).where(mine & (F.col("__reach").isNull() | (F.col("__reach") <= F.col("s").cast("long") - pre))).select(corpus.key, VERSION, "s", "e").distinct()


def without_overlaps(found: DataFrame, key: str) -> DataFrame:
    """Of each document's spans the longest, then the first, that no token of a chosen one touches; a span that ends where a chosen one begins is dropped too."""
    names = [key, VERSION] if VERSION in found.columns else [key]
    found = found.select(*names, "s", "e")

    def choose(pdf):  # noqa: ANN001, ANN202
        taken: set[int] = set()
        kept = []
        for i in (pdf["s"] - pdf["e"]).to_frame("n").assign(s=pdf["s"]).sort_values(["n", "s"], kind="stable").index:
            s, e = int(pdf["s"][i]), int(pdf["e"][i])
            if not any(t in taken for t in range(s, e + 1)):
                taken.update(range(s, e))
                kept.append(i)
        return pdf.loc[kept]

    return found.groupBy(*names).applyInPandas(choose, found.schema)


def single_tokens(corpus: Corpus, query: ir.Query) -> bool:
    query = ir.plain(query)
    return single_tokens(corpus, query.child) if isinstance(query, ir.Within) else at_token(corpus, query) is not None


# Documents


def documents(corpus: Corpus, query: ir.Query) -> DataFrame:
    """The distinct keys of matching documents."""
    return matching(corpus, query).select(corpus.key).distinct()


def matching(corpus: Corpus, query: ir.Query) -> DataFrame:
    """The matching rows of the corpus, with all their columns."""
    query = ir.plain(query)
    hard: list[ir.Query] = []
    names = sorted({leaf.field for leaf in ir.leaves(query)})

    def test(q: ir.Query) -> Column:
        match q:
            case ir.AllDocs():
                return F.lit(True)
            case ir.Typed():
                return typed(corpus, q)
            case ir.Bool(clauses, least):
                must = [test(c.query) for c in clauses if c.occur == "must"]
                should = [test(c.query) for c in clauses if c.occur == "should"]
                never = [test(c.query) for c in clauses if c.occur == "not"]
                if not must and not should:
                    return F.lit(False)
                most = least if least else 0 if must else 1
                out = reduce(lambda a, b: a & b, must, F.lit(True))
                if most == 1:
                    out &= reduce(lambda a, b: a | b, should, F.lit(False))
                elif most:
                    out &= reduce(lambda a, b: a + b, [x.cast("int") for x in should], F.lit(0)) >= most
                return reduce(lambda a, b: a & ~b, never, out)
            case ir.AnyOf(()):
                return F.lit(False)
        terms = F.col(f"__terms_{field_of(q)}")
        if one := at_token(corpus, q):
            return F.coalesce(F.exists(terms, one), F.lit(False))
        inner = row_spans(corpus, q, terms)
        if inner is not None:
            return F.size(inner) > 0
        if q not in hard:
            hard.append(q)
        return F.coalesce(F.array_contains(f"__hits_{field_of(q)}", hard.index(q)), F.lit(False))

    condition = test(query)
    rows = corpus.rows().where(needed(corpus, query))
    if hard:
        of = {k: field_of(q) for k, q in enumerate(hard)}
        hits = [located(corpus, q).select(F.col(corpus.key).alias("__key"), F.col(VERSION).alias("__of"), F.lit(k).alias("__hit")).distinct() for k, q in enumerate(hard)]
        for name in sorted(set(of.values())):
            mine = reduce(DataFrame.unionByName, [h for k, h in enumerate(hits) if of[k] == name])
            mine = mine.groupBy("__key", "__of").agg(F.collect_set("__hit").alias(f"__hits_{name}"))
            rows = rows.join(mine, (F.col(corpus.key) == F.col("__key")) & (F.xxhash64(name) == F.col("__of")), "left").drop("__key", "__of")
    if tokenised := [n for n in names if n]:
        rows = once(rows, *[corpus.terms(n).alias(f"__terms_{n}") for n in tokenised])
    return rows.where(condition).select(*corpus.docs.columns)


def row_test(corpus: Corpus, query: ir.Query) -> Column | None:
    """Whether a row matches, told from itself; None if that takes a join."""
    query = ir.plain(query)
    if isinstance(query, ir.AllDocs):
        return F.lit(True)
    if isinstance(query, ir.AnyOf) or isinstance(query, ir.Leaf):
        one = at_token(corpus, query)
        return None if one is None else F.coalesce(F.exists(corpus.terms(field_of(query)), one), F.lit(False))
    if isinstance(query, ir.Bool):
        tests = [(c.occur, row_test(corpus, c.query)) for c in query.clauses]
        if any(t is None for _, t in tests):
            return None
        must, should = [t for o, t in tests if o == "must"], [t for o, t in tests if o == "should"]
        if not must and not should:
            return F.lit(False)
        out = reduce(lambda a, b: a & b, must, F.lit(True))
        most = query.least if query.least else 0 if must else 1
        if most:
            out &= reduce(lambda a, b: a + b, [x.cast("int") for x in should], F.lit(0)) >= most
        return reduce(lambda a, b: a & ~b, [t for o, t in tests if o == "not"], out)
    return None


def typed(corpus: Corpus, q: ir.Typed) -> Column:
    kind = corpus.type_of(q.field).kind
    column = F.col(q.field)
    value = lambda x: F.lit(x) if kind == "string" else F.lit(x).cast(kind)
    if q.op == "=":
        out = column == value(q.value)
    elif q.op == "prefix":
        out = column.startswith(q.value)
    else:
        out = column.isNotNull()
        if q.value is not None:
            out &= column >= value(q.value) if q.with_low else column > value(q.value)
        if q.high is not None:
            out &= column <= value(q.high) if q.with_high else column < value(q.high)
    return F.coalesce(out, F.lit(False))


def all_of(corpus: Corpus, *queries: ir.Query) -> DataFrame:
    """Keys of the documents that match every one of some filters."""
    return documents(corpus, ir.Bool(tuple(ir.Clause("must", q) for q in queries)))


def doc_count(corpus: Corpus, query: ir.Query) -> DataFrame:
    return matching(corpus, query).agg(F.count("*").alias("n_docs"))


def facets(corpus: Corpus, query: ir.Query, name: str) -> DataFrame:
    """Rows (value, n): matching documents by a column; nulls have a row."""
    return matching(corpus, query).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
