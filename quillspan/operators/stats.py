"""Statistics of a corpus: vocabulary, inverse document frequencies, dumps of
frequent terms, counts of targets, grams near a target, contrast of a query's
documents with the corpus. Each is one or two aggregations with partial sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ir
from . import kwic, search
from .search import Corpus

UNSEEN_DF = 2


def _counted(rows: DataFrame, strings: str, name: str) -> DataFrame:
    """Rows (name, df, tf) of an array column: how many rows have a string, and how often. Behind an array's strings stand its distinct ones, told by their place."""
    rows = search.once(rows.select(strings), F.array_distinct(strings).alias("__distinct"))
    one = rows.select(F.size(strings).alias("__n"), F.posexplode(F.concat(strings, "__distinct")).alias("__i", name))
    again = F.col("__i") >= F.col("__n")
    return one.where(F.col(name).isNotNull()).groupBy(name).agg(F.sum(again.cast("long")).alias("df"), F.sum((~again).cast("long")).alias("tf"))


def vocabulary(corpus: Corpus, name: str = "text") -> DataFrame:
    """Rows (term, df, tf): one shuffle of terms summed before it; documents (rows) are counted within themselves."""
    terms = search.once(corpus.rows().select(name), search.stacked(corpus, name, corpus.terms(name)).alias("__t"))
    return _counted(terms, "__t", "term").where("term <> ''")


def idf(df: Column, docs: Column | int) -> Column:
    """ln((docs + 1) / df); a term that no document has counts as one of two."""
    df = F.when(F.coalesce(df, F.lit(0)) <= 0, F.lit(UNSEEN_DF)).otherwise(df)
    return F.log((docs + F.lit(1.0)) / df)


def df_of_idf(value: Column, docs: Column | int) -> Column:
    return (docs + F.lit(1.0)) / F.exp(value)


def idf_of(count: Column, n: Column | int) -> Column:
    return F.log(n / count)


def doc_total(corpus: Corpus, name: str | None = None) -> DataFrame:
    """One row (docs): documents, of a field if it is named."""
    rows = corpus.rows()
    return (rows if name is None else rows.where(F.col(name).isNotNull())).agg(F.count("*").alias("docs"))


def phrase_idf(corpus: Corpus, phrases: DataFrame, name: str = "text", phrase_col: str = "phrase") -> DataFrame:
    """Rows (phrase, sum_idf, min_df): over the words of each phrase, split at white space; words that no document has count as UNSEEN_DF."""
    words = phrases.select(F.col(phrase_col).alias("phrase")).where("phrase is not null").distinct().select("phrase", F.explode(F.filter(F.split("phrase", r"\s+"), lambda w: w != "")).alias("term"))
    seen = words.join(vocabulary(corpus, name), "term", "left").crossJoin(doc_total(corpus))
    one = F.when(F.coalesce("df", F.lit(0)) <= 0, F.lit(UNSEEN_DF)).otherwise(F.col("df"))
    return seen.groupBy("phrase").agg(F.sum(idf(F.col("df"), F.col("docs"))).alias("sum_idf"), F.min(one).alias("min_df"))


def top_terms(
    corpus: Corpus, name: str = "text", n: int | None = 100, by: str = "df", min_df: int = 0, max_df: int | None = None, min_share: float | None = None, max_share: float | None = None,
    stops: Sequence[str] = (), first: Sequence[str] = (),
) -> DataFrame:
    """Rows (term, df, tf) by df or tf, most frequent first, then by term.

    Shares are of the documents that have the field. Words of stops and of first
    (which a dump begins with) are left out.
    """
    out = vocabulary(corpus, name).where(F.col("df") >= min_df)
    if max_df is not None:
        out = out.where(F.col("df") <= max_df)
    if min_share is not None or max_share is not None:
        out = out.crossJoin(F.broadcast(doc_total(corpus, name)))
        if min_share is not None:
            out = out.where(F.col("df") >= F.col("docs") * min_share)
        if max_share is not None:
            out = out.where(F.col("df") <= F.col("docs") * max_share)
    if stops or first:
        out = out.where(~F.col("term").isin(*stops, *first))
    out = out.select("term", "df", "tf")
    return out if n is None else out.orderBy(F.col(by).desc(), "term").limit(n)


def word_list(spark: SparkSession, path: str) -> list[str]:
    """Words of a file, one a line; blank lines and those with # first don't count."""
    lines = spark.read.text(path).select(F.trim("value").alias("w")).where((F.col("w") != "") & ~F.col("w").startswith("#"))
    return [r.w for r in lines.distinct().orderBy("w").collect()]


def dump(terms: DataFrame, path: str, first: Sequence[str] = (), with_df: bool = False, with_tf: bool = False) -> None:
    """Write terms as lines, with counts behind tabs if asked for; the words of first come before. An existing path is an error."""
    spark = terms.sparkSession
    clean = F.trim(F.regexp_replace("term", r"\s+", " "))
    columns = [clean.alias("term")] + [F.col(c).cast("string").alias(c) for c, w in (("df", with_df), ("tf", with_tf)) if w]
    rows = terms.select(F.lit(1).alias("part"), F.col("df").alias("d"), F.col("tf").alias("t"), *columns)
    if first:
        extra = spark.createDataFrame([(0, -k, 0, w) for k, w in enumerate(first)], "part int, d long, t long, term string")
        rows = rows.unionByName(extra, allowMissingColumns=True)
    names = ["term", *["df"] * with_df, *["tf"] * with_tf]
    rows.orderBy("part", F.col("d").desc(), F.col("t").desc(), "term").select(F.concat_ws("\t", *names).alias("value")).write.text(path)


# Grams


def _shown(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda t: F.coalesce(F.when(t == "", F.lit("_")).otherwise(t), F.lit("_"))), " ")


def ngrams(terms: Column, low: int, high: int) -> Column:
    """All runs of low..high positions as text, '_' for stop words; runs of these alone are left out."""
    low, high = _bounds(low, high)
    runs = F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(F.size(terms) >= n, F.transform(F.sequence(F.lit(1), F.size(terms) - n + 1), lambda i: F.slice(terms, i, n))).otherwise(F.array().cast("array<array<string>>"))))
    return F.transform(F.filter(runs, lambda r: F.exists(r, lambda t: t.isNotNull() & (t != ""))), _shown)


def wgrams(terms: Column, low: int, high: int, accept=lambda t: t.isNotNull() & (t != ""), across: bool = False) -> Column:  # noqa: ANN001
    """Runs that begin and end with accepted terms and have low..high of them; the others between stay in the text but don't count. Only across: over the ends of values."""
    low, high = _bounds(low, high)
    ok = lambda t: F.coalesce(accept(t), F.lit(False)) & t.isNotNull() & (t != "")
    good = F.filter(F.transform(terms, lambda t, i: F.when(ok(t), i)), lambda i: i.isNotNull())
    ends = F.sequence(F.lit(low), F.lit(high))
    runs = search.bound(good, lambda good: F.flatten(F.transform(good, lambda a, k: F.transform(F.filter(ends, lambda n: (k + n) <= F.size(good)), lambda n: F.slice(terms, a + 1, F.get(good, k + n - 1) - a + 1)))))
    return F.transform(runs if across else F.filter(runs, lambda r: ~F.coalesce(F.array_contains(r, ""), F.lit(False))), _shown)


def _bounds(low: int, high: int) -> tuple[int, int]:
    if low < 1 or high < 1:
        raise ValueError("grams have one word at least")
    return low, max(low, high)


def cooccurrences(
    corpus: Corpus, query: ir.Query, name: str = "text", before: int = 10, after: int = 10, low: int = 1, high: int = 1, kind: str | Callable[[Column], Column] = "ngram", min_tf: int = 5, n: int | None = 20,
    dedup: bool = False, limit: int | None = None, reject_idf: float | None = None, across: bool = False, where: DataFrame | None = None, accept: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Rows (term, tf, df, idf, tfidf) of the grams before and after a query's spans, by tfidf, then term.

    kind: ngram or wgram, or a function from an array of terms to one of grams. No gram spans the target. idf is the sum over the
    gram's words, df an estimate from it. dedup counts windows with the same pre
    and post once. reject_idf: terms of an idf up to it neither begin nor end a
    w-gram nor count in one; so are those that accept, a condition on a term,
    refuses. limit: of windows, the first by key and position.
    """
    found = kwic.term_windows(corpus, query, name, before, after, limit=limit, where=where)
    if dedup:
        found = found.dropDuplicates(["pre", "post"])
    voc = vocabulary(corpus, name)
    total = doc_total(corpus)
    if callable(kind):
        grams_of = lambda side: kind(F.col(side))
    elif kind == "wgram" and reject_idf is not None:
        found = _rejecting(found, voc, total, reject_idf, corpus.key)
        plain = lambda g: F.regexp_replace(g, "⁣", "")
        grams_of = lambda side: F.transform(_wgrams_marked(F.col(side), low, high, across, accept), plain)
    elif kind == "wgram":
        grams_of = lambda side: wgrams(F.col(side), low, high, **({"accept": accept} if accept else {}), across=across)
    else:
        grams_of = lambda side: ngrams(F.col(side), low, high)
    tf = found.select(F.explode(F.concat(grams_of("pre"), grams_of("post"))).alias("term")).groupBy("term").agg(F.count("*").alias("tf")).where(F.col("tf") >= min_tf)
    return ranked(tf, voc, total, n)


_REJECTED = "⁣"  # invisible; no tokenizer makes it part of a term


def _wgrams_marked(terms: Column, low: int, high: int, across: bool, accept: Callable[[Column], Column] | None = None) -> Column:
    return wgrams(terms, low, high, lambda t: ~t.startswith(_REJECTED) & (accept(t) if accept else F.lit(True)), across)


def _rejecting(found: DataFrame, voc: DataFrame, total: DataFrame, reject_idf: float, key: str) -> DataFrame:
    """Windows whose terms of a low idf are marked; positions of windows meet the rejected terms in a join and come back."""
    bad = voc.crossJoin(F.broadcast(total)).where(idf(F.col("df"), F.col("docs")) <= reject_idf).select(F.col("term").alias("__bad"))
    place = lambda side: F.transform(side, lambda t, i: F.struct(F.lit(side == "post").alias("post"), i.alias("i"), t.alias("term")))
    one = found.select(key, "s", "e", F.inline_outer(F.concat(place("pre"), place("post"))))
    one = one.join(bad, F.col("term") == F.col("__bad"), "left").withColumn("term", F.when(F.col("__bad").isNotNull(), F.concat(F.lit(_REJECTED), "term")).otherwise(F.col("term")))
    sides = one.groupBy(key, "s", "e").agg(F.array_sort(F.collect_list(F.struct("post", "i", "term"))).alias("all"))
    side = lambda post: F.transform(F.filter("all", lambda x: x.post == F.lit(post)), lambda x: x.term)
    return sides.select(key, "s", "e", side(False).alias("pre"), side(True).alias("post"))


def ranked(tf: DataFrame, voc: DataFrame, total: DataFrame, n: int | None = 20) -> DataFrame:
    """Rows (term, tf, df, idf, tfidf) of rows (term, tf)."""
    words = tf.select("term", "tf", F.explode(F.split("term", " ")).alias("word"))
    known = voc.select(F.col("term").alias("word"), "df")
    value = words.join(known, "word", "left").crossJoin(F.broadcast(total)).groupBy("term", "tf", "docs").agg(F.sum(idf(F.col("df"), F.col("docs"))).alias("idf"))
    out = value.select("term", "tf", F.greatest(F.lit(1), F.round(df_of_idf(F.col("idf"), F.col("docs")))).cast("long").alias("df"), "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))
    return out if n is None else out.orderBy(F.col("tfidf").desc(), "term").limit(n)


def merged_cooccurrences(shards: Sequence[DataFrame], docs: Sequence[int], n: int | None = 20) -> DataFrame:
    """Counts (term, tf, df) of several corpora with so many documents as those of one: rows (term, tf, df, tfidf)."""
    out = shards[0].select("term", "tf", "df")
    for s in shards[1:]:
        out = out.unionByName(s.select("term", "tf", "df"))
    out = out.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    out = out.withColumn("tfidf", F.col("tf") * F.log(F.lit(float(sum(docs))) / F.col("df")))
    return out if n is None else out.orderBy(F.col("tfidf").desc(), F.col("df").desc(), "term").limit(n)


# Targets and contrast


def target_counts(corpus: Corpus, query: ir.Query, name: str = "text", n: int | None = 20, where: DataFrame | None = None) -> DataFrame:
    """Rows (target, df, tf) of what the query's spans read, by df, tf and target."""
    rows = search.once(kwic.targets(corpus, query, name, where), F.transform("targets", _shown).alias("__t"))
    out = _counted(rows, "__t", "target")
    return out if n is None else out.orderBy(F.col("df").desc(), F.col("tf").desc(), "target").limit(n)


def term_counts(corpus: Corpus, leaf: ir.Leaf) -> DataFrame:
    """Rows (term, df, tf) of the terms that a leaf stands for; texts are filtered before they are tokenised."""
    rows = corpus.rows().where(search.needed(corpus, leaf))
    some = Corpus(rows, corpus.key, corpus.fields, corpus.options)
    return vocabulary(some, leaf.field).where(search.predicate(leaf, F.col("term")))


def token_types(windows: DataFrame) -> DataFrame:
    """Rows (term, n): what stands in term windows, target included."""
    return windows.select(F.explode(F.concat("pre", "target", "post")).alias("term")).where("term is not null and term <> ''").groupBy("term").agg(F.count("*").alias("n"))


def contrast(corpus: Corpus, query: ir.Query, name: str = "text", max_docs: int | None = None, min_docs: int = 10, n: int | None = 20) -> DataFrame:
    """Rows (term, tf, df, idf, tfidf): tf is the number of the query's documents with the term; empty if fewer than min_docs match.

    max_docs takes the first by key (there is no score).
    """
    if max_docs is None and (test := search.row_test(corpus, query)) is not None:
        # One pass: each document's terms, marked if it matches.
        rows = corpus.rows().select(search.stacked(corpus, name, corpus.terms(name)).alias("__t"), test.alias("__hit"))
        counts = rows.agg(F.count("*").alias("docs"), F.sum(F.col("__hit").cast("long")).alias("__hits")).where(F.col("__hits") >= min_docs)
        one = rows.select("__hit", F.explode(F.array_distinct(F.filter("__t", lambda t: t.isNotNull() & (t != "")))).alias("term"))
        out = one.groupBy("term").agg(F.sum(F.col("__hit").cast("long")).alias("tf"), F.count("*").alias("df")).where("tf > 0").crossJoin(F.broadcast(counts))
    else:
        hits = search.matching(corpus, query).select(corpus.key, name)
        if max_docs is not None:
            hits = hits.orderBy(corpus.key).limit(max_docs)
        some = Corpus(hits, corpus.key, corpus.fields, corpus.options)
        terms = vocabulary(some, name).select("term", F.col("df").alias("tf"))
        enough = hits.agg(F.count("*").alias("__hits")).where(F.col("__hits") >= min_docs)
        terms = terms.crossJoin(F.broadcast(enough)).drop("__hits")
        out = terms.join(vocabulary(corpus, name).select("term", "df"), "term").crossJoin(F.broadcast(doc_total(corpus)))
    out = out.select("term", "tf", "df", idf(F.col("df"), F.col("docs")).alias("idf")).withColumn("tfidf", F.col("tf") * F.col("idf"))
    return out if n is None else out.orderBy(F.col("tfidf").desc(), "term").limit(n)
