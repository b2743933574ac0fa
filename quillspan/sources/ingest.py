"""Sources of documents and the sink of their postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..operators.search import Corpus


def text_directory(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, text): each file under path, however deep, is a document; its path is the key. Line ends read as \\n, and the last line has one."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("doc_id"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    return files.withColumn("text", F.when((F.col("text") == "") | F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n"))))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, text): each line is a document; .gz and .bz2 files are unpacked. doc_id is a hash of the file and the line, whose place in it is not known to a split; equal lines of a file share one and are documents each."""
    return spark.read.text(path).select(F.xxhash64(F.input_file_name(), "value").alias("doc_id"), F.col("value").alias("text"))


def jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, **options: str) -> DataFrame:
    """Rows (doc_id, text): the first column of a query that is not the key; without a key, a hash of the text."""
    rows = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    column = next(c for c in rows.columns if c != key)
    return rows.select((F.xxhash64(column) if key is None else F.col(key)).alias("doc_id"), F.col(column).cast("string").alias("text"))


def values_by_key(rows: DataFrame, key: str, order: str, value: str = "text") -> DataFrame:
    """Rows (key, value): a document for each key, whose values are those of its rows in an order."""
    pairs = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))).alias("v"))
    return pairs.select(key, F.transform("v", lambda x: x[value]).alias(value))


def write_postings(corpus: Corpus, name: str, path: str, files: int = 64, parts: int = 16) -> None:
    """Rows (term, key, positions), a row of the corpus each, in buckets by a hash of the term: a reader of some terms opens few files.

    Positions of a term are gathered within their row. Each bucket is cut into
    parts by the key, so that no task has all of a frequent term's postings.
    """
    place = F.transform(search.stacked(corpus, name, corpus.terms(name)), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    if corpus.type_of(name).analyzer.synonyms:
        place = F.flatten(F.transform(corpus.terms(name), lambda t, i: F.transform(search.synonyms_of(corpus, name, t), lambda x: F.struct(x.alias("term"), i.alias("pos")))))
    some = F.filter(place, lambda x: x.term.isNotNull())
    one = corpus.rows().select(corpus.key, some.alias("p")).select(corpus.key, "p", F.explode(F.array_distinct(F.transform("p", lambda x: x.term))).alias("term"))
    one = one.select("term", corpus.key, F.transform(F.filter("p", lambda x: x.term == F.col("term")), lambda x: x.pos).alias("positions"))
    one = one.withColumn("bucket", F.pmod(F.hash("term"), F.lit(files)))
    one.repartition(files * parts, "bucket", F.pmod(F.hash(corpus.key), F.lit(parts))).sortWithinPartitions("bucket", "term", corpus.key).write.partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: list[str] | None = None, files: int = 64) -> DataFrame:
    """Postings of some terms, or of all; only the buckets of the terms are read."""
    rows = spark.read.parquet(path)
    if terms is not None:
        buckets = [r.b for r in spark.createDataFrame([(t,) for t in terms] or [("",)], "t string").select(F.pmod(F.hash("t"), F.lit(files)).alias("b")).collect()]
        rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    return rows.drop("bucket")


def multivalue_substring(values: Column, start: int, end: int, offset_gap: int, joiner: str = search.JOINER) -> Column:
    """The characters start..end of an array of values that lie offset_gap apart.

    Values meet at joiner; a range that begins in a gap begins with joiner, one
    that ends in a gap ends with the value before it. Negative places count as
    0; beyond all values, and for null, there is nothing. Null values are none.
    """
    values = F.filter(values, lambda v: v.isNotNull())
    end = max(0, end)
    start = min(max(0, start), end)
    sizes = F.transform(values, lambda v: F.length(v) + offset_gap)
    placed = F.transform(values, lambda v, i: F.struct(F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, n: a + n).alias("at"), v.alias("v")))
    rest = F.filter(placed, lambda p: p.at + F.length(p.v) > start)
    skip = lambda p: F.greatest(F.lit(start) - p.at, F.lit(0))
    shown = F.transform(F.filter(rest, lambda p: p.at <= end), lambda p: F.substr(p.v, skip(p) + 1, F.least(F.lit(end) - p.at, F.length(p.v)) - skip(p)))
    text = F.concat(F.when(F.get(rest, 0).at > start, F.lit(joiner)).otherwise(F.lit("")), F.array_join(shown, joiner))
    return F.when(F.size(rest) > 0, text).otherwise(F.lit(""))
