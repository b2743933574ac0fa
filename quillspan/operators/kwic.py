"""Keyword in context: windows of text or of terms around the spans of a query.

Spans of a document come to its row as one array (or are found there), and all
of its windows are cut within the row, in time linear in the document and the
windows' text. Only then are they rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ir
from . import search
from .search import Corpus

ORDERS = ("PRE", "POST", "TARGET_PRE", "TARGET_POST", "DOC", "NONE")


def to_spans(corpus: Corpus, query: ir.Query, name: str, where: DataFrame | None) -> tuple[ir.Query, DataFrame | None]:
    """(span query of the field, keys of the documents that count): a query over documents is its own filter."""
    pure = ir.as_spans(query, name)
    if pure == query:
        return query, where
    hits = search.documents(corpus, query)
    return pure, hits if where is None else hits.join(where.select(corpus.key), corpus.key, "left_semi")


def _located(corpus: Corpus, query: ir.Query, name: str, overlaps: bool, limit: int | None, where: DataFrame | None, columns: Sequence[str], texts: bool = False) -> DataFrame:
    """Rows (key, columns, __raw, __terms, __spans) of documents with spans, which are of that row alone; with texts, __gaps and __sizes too."""
    query, where = to_spans(corpus, query, name, where)
    query = ir.plain(query)
    kept = list(dict.fromkeys([corpus.key, *columns, name]))
    term = corpus.type_of(name).analyzer.term
    gaps, sizes = corpus.between(name, "__gaps")

    def taken_apart(rows: DataFrame) -> DataFrame:
        rows = search.once(rows, corpus.raw(name).alias("__raw"), *[gaps.alias("__gaps")] * texts)
        return search.once(rows, F.transform("__raw", term).alias("__terms"), *[sizes.alias("__sizes")] * texts)

    alone = overlaps or search.single_tokens(corpus, query)
    inner = search.row_spans(corpus, query, F.col("__terms")) if alone and limit is None else None
    if inner is not None:
        rows = taken_apart(search._source(corpus, query, where).select(*kept))
        return search.once(rows, inner.alias("__spans")).where(F.size("__spans") > 0)
    found = search.located(corpus, query, where)
    if not alone:
        found = search.without_overlaps(found, corpus.key)
    if limit is not None:
        found = found.orderBy(corpus.key, "s", "e", search.VERSION).limit(limit)
    found = found.groupBy(F.col(corpus.key).alias("__key"), F.col(search.VERSION).alias("__of")).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("__spans"))
    rows = corpus.rows().join(found, (F.col(corpus.key) == F.col("__key")) & (F.xxhash64(name) == F.col("__of"))).select(*kept, "__spans")
    return taken_apart(rows)


_PART = 16


def _running(steps: str) -> Column:
    """Sums of an array column's numbers up to each: of whole parts first, and of parts of these, so that a long array takes little more than linear time."""
    zero, add = F.lit(0).cast("long"), lambda a, n: a + n
    further = lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n))

    def sums(of: Column, levels: int) -> Column:
        def joined(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, zero, add))
            before = F.concat(F.array(zero), search.bound(totals, lambda t: sums(t, levels - 1))) if levels else F.aggregate(totals, F.array(zero), further)
            return search.bound(before, lambda b: F.flatten(F.transform(parts, lambda p, k: F.slice(F.aggregate(p, F.array(F.get(b, k)), further), 2, _PART))))

        cuts = F.sequence(F.lit(0), F.floor((F.size(of) - 1) / _PART).cast("int"))
        return search.bound(F.transform(cuts, lambda p: F.slice(of, p * _PART + 1, _PART)), joined)

    return sums(F.col(steps), 1)


def _range(low: Column, high: Column) -> Column:
    """low..high as an array; an empty one if high < low."""
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _text(raw: Column, gaps: Column, low: Column, high: Column) -> Column:
    """The text from token low to the end of token high."""
    return F.array_join(F.transform(_range(low, high), lambda i: F.concat(F.when(i > low, F.get(gaps, i)).otherwise(F.lit("")), F.coalesce(F.get(raw, i), F.lit("")))), "")


def windows(
    corpus: Corpus, query: ir.Query, name: str = "text", before: int = 10, after: int = 10, order: str | Callable[[Column, Column, Column], Column] = "PRE", limit: int | None = None,
    overlaps: bool = False, where: DataFrame | None = None, metadata: Sequence[str] = (),
) -> DataFrame:
    """Rows (key, s, e, pre, target, post, sort_key, char_start, char_end, metadata), one for each span.

    pre begins with the first token of the before positions and ends one
    character before the target; post begins right after the target and ends
    with the last token of the after positions; without such a token each is
    empty. limit keeps the first windows by key and position (None: all).
    Overlapping spans are thinned, longest first, unless overlaps. where: keys
    of the documents that count. Offsets count code points; over several values
    they include the analyzer's offset gap. order may also be a function of the
    terms before (nearest first), in and after the target, as arrays without
    holes, that builds the sort key. Nothing is shuffled for spans that a row
    tells itself.
    """
    if before < 0 or after < 0 or not (callable(order) or order in ORDERS):
        raise ValueError("a window has sizes of 0 at least and an order of " + ", ".join(ORDERS))
    rows = _located(corpus, query, name, overlaps, limit, where, metadata, True)
    raw, gaps, sizes, terms, found = (F.col(f"__{c}") for c in ("raw", "gaps", "sizes", "terms", "spans"))
    alone = search.single_tokens(corpus, ir.as_spans(query, name))

    def pre(s: Column) -> Column:
        seen = F.filter(_range(F.greatest(s - before, F.lit(0)), s - 1), lambda i: F.get(terms, i).isNotNull())
        left = search.bound(F.get(seen, 0), lambda first: F.array_join(F.transform(_range(first, s - 1), lambda i: F.concat(F.coalesce(F.get(raw, i), F.lit("")), F.get(gaps, i + 1))), ""))
        return search.bound(left, lambda t: F.when(F.length(t) > 0, t.substr(F.lit(1), F.length(t) - 1)).otherwise(F.lit("")))

    def post(e: Column) -> Column:
        seen = F.filter(_range(e, F.least(e + after, F.size(terms)) - 1), lambda i: F.get(terms, i).isNotNull())
        last = F.element_at(F.concat(F.array(F.lit(None).cast("int")), seen), -1)
        right = search.bound(last, lambda z: F.array_join(F.transform(_range(e, z), lambda i: F.concat(F.get(gaps, i), F.coalesce(F.get(raw, i), F.lit("")))), ""))
        return F.coalesce(right, F.lit(""))

    def cut(x: Column, k: Column) -> Column:
        s, e = x.s, x.e
        out = {"s": s, "char_start": F.get(F.col("__begins"), k)}
        if alone:
            out |= {"target": F.coalesce(F.get(raw, s), F.lit(""))}
        else:
            inside = F.aggregate(_range(s, e - 1), F.lit(0).cast("long"), lambda n, i: n + F.length(F.coalesce(F.get(raw, i), F.lit(""))) + F.when(i > s, F.get(sizes, i)).otherwise(0))
            out |= {"e": e, "target": _text(raw, gaps, s, e - 1), "char_end": out["char_start"] + inside}
        out |= ({"pre": pre(s)} if before else {}) | ({"post": post(e)} if after else {})
        words = lambda low, high: F.filter(F.transform(_range(low, high), lambda i: F.get(terms, i)), lambda t: t.isNotNull())
        backwards = F.reverse(words(F.greatest(s - before, F.lit(0)), s - 1))
        forwards = words(e, F.least(e + after, F.size(terms)) - 1)
        if callable(order):
            out["sort_key"] = order(backwards, words(s, e - 1), forwards)
        elif order not in ("DOC", "NONE"):
            parts = {"PRE": [backwards], "POST": [forwards], "TARGET_PRE": [words(s, e - 1), backwards], "TARGET_POST": [words(s, e - 1), forwards]}[order]
            out["sort_key"] = F.trim(F.array_join(F.concat(*parts), " "))
        return F.struct(*[v.alias(c) for c, v in out.items()])

    def step(x: Column, k: Column) -> Column:
        """Characters from the span before, or the text's begin, to this one."""
        widths, was = F.col("__widths"), F.when(k > 0, F.get(found, k - 1).s).otherwise(F.lit(-1))
        far = lambda w: F.aggregate(F.slice(widths, w + 2, x.s - w), F.lit(0).cast("long"), lambda n, c: n + c)
        return search.bound(was, lambda w: F.when(w + 1 == x.s, F.get(widths, x.s)).otherwise(far(w)))

    kept = [F.col(m) for m in dict.fromkeys([corpus.key, *metadata])]
    # Nothing that takes time may be named within a function of an element, where it would be told anew for each.
    rows = search.once(rows, F.transform(sizes, lambda n, i: n + F.coalesce(F.length(F.get(raw, i - 1)), F.lit(0)).cast("long")).alias("__widths"))
    steps = F.transform(found, step)
    if alone:
        steps = F.when(F.size(found) == F.size(raw), F.col("__widths")).otherwise(steps)
    rows = search.once(search.once(rows, steps.alias("__steps")), _running("__steps").alias("__begins"))
    rows = rows.select(*kept, F.inline(F.transform(found, cut)))
    # What follows from the rest, or is the same for all, takes no place in the arrays.
    if alone:
        rows = rows.withColumns({"e": F.col("s") + 1, "char_end": F.col("char_start") + F.length("target")})
    rows = rows.withColumns({c: F.lit("") for c in ("pre", "post", "sort_key") if c not in rows.columns})
    if order == "DOC":
        rows = rows.withColumn("sort_key", F.col(corpus.key).cast("string"))
    about = F.create_map(*[x for m in metadata for x in (F.lit(m), F.col(m).cast("string"))]) if metadata else F.create_map().cast("map<string,string>")
    return rows.select(corpus.key, "s", "e", "pre", "target", "post", "sort_key", "char_start", "char_end", about.alias("metadata"))


def ordered(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Windows by sort key; ties by document and position."""
    return found.orderBy("sort_key", key, "char_start") if "char_start" in found.columns else found.orderBy("sort_key")


def same_words(w: Callable[[str], Column]) -> list[Column]:
    """What windows agree in that are one: pre, target and post but for case."""
    return [F.lower(w(c)) for c in ("pre", "target", "post")]


def deduplicated(found: DataFrame, key: str = "doc_id", limit: int | None = None, same: Callable[[Callable[[str], Column]], list[Column]] = same_words) -> DataFrame:
    """One window of those that agree in same: the first by key and position, with their number (or the sum of their counts) as count; limit counts distinct ones."""
    at = F.struct(key, "s", "e")
    rest = [c for c in found.columns if c not in (key, "s", "e", "count")]
    many = F.sum("count") if "count" in found.columns else F.count("*")
    out = found.groupBy(*[c.alias(f"__{k}") for k, c in enumerate(same(F.col))]).agg(F.min_by(F.struct(key, "s", "e", *rest), at).alias("w"), many.alias("count")).select("w.*", "count")
    return out if limit is None else out.orderBy(key, "s", "e").limit(limit)


def totals(found: DataFrame, corpus: Corpus) -> DataFrame:
    """One row (n_docs, n_windows, total_docs); n_docs counts keys."""
    return found.agg(F.countDistinct(corpus.key).alias("n_docs"), F.count("*").alias("n_windows")).crossJoin(corpus.rows().agg(F.count("*").alias("total_docs")))


def hit_limit(corpus: Corpus, query: ir.Query, limit: int) -> bool:
    """Whether there are more spans than limit."""
    return search.spans(corpus, query).limit(limit + 1).count() > limit


def merged(shards: Sequence[DataFrame], key: str = "doc_id", limit: int | None = None, dedup: bool = False) -> DataFrame:
    """Windows of several corpora as those of one, in order, with hit_max: whether there are limit or more. dedup: windows that agree are one, and their counts are summed."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    if dedup:
        out = deduplicated(out, key)
    if limit is None:
        return ordered(out.withColumn("hit_max", F.lit(False)), key)
    some = out.limit(limit).agg(F.count("*").alias("__n"))
    return ordered(out.crossJoin(F.broadcast(some.select((F.col("__n") >= limit).alias("hit_max")))), key).limit(limit)


def visited(found: DataFrame, *results: Column, by: Sequence[str | Column] = ()) -> DataFrame:
    """What a visitor of windows gathers: aggregates over them all, or for each value of by, with n_windows."""
    return found.groupBy(*by).agg(F.count("*").alias("n_windows"), *results)


def term_windows(corpus: Corpus, query: ir.Query, name: str = "text", before: int = 10, after: int = 10, overlaps: bool = False, limit: int | None = None, where: DataFrame | None = None) -> DataFrame:
    """Rows (key, s, e, pre, target, post): terms as arrays, null for stop words, and the empty string between values of a field."""
    rows = _located(corpus, query, name, overlaps, limit, where, ())
    raw, terms, found = F.col("__raw"), F.col("__terms"), F.col("__spans")
    shown = lambda i: F.when(F.get(raw, i).isNull(), F.lit("")).otherwise(F.get(terms, i))

    def cut(x: Column) -> Column:
        s, e = x.s, x.e
        return F.struct(
            s.alias("s"), e.alias("e"), F.transform(_range(F.greatest(s - before, F.lit(0)), s - 1), shown).alias("pre"), F.transform(_range(s, e - 1), shown).alias("target"),
            F.transform(_range(e, F.least(e + after, F.size(terms)) - 1), shown).alias("post"),
        )

    return rows.select(corpus.key, F.inline(F.transform(found, cut)))


def targets(corpus: Corpus, query: ir.Query, name: str = "text", where: DataFrame | None = None) -> DataFrame:
    """Rows (key, targets), one for each document with spans: the terms of each."""
    rows = _located(corpus, query, name, False, None, where, ())
    terms = F.col("__terms")
    shown = lambda i: F.when(F.get(F.col("__raw"), i).isNull(), F.lit("")).otherwise(F.get(terms, i))
    return rows.select(corpus.key, F.transform("__spans", lambda x: F.transform(_range(x.s, x.e - 1), shown)).alias("targets"))
