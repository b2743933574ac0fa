"""Vocabulary of a stream of documents: tokenised without state, counted with partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search
from ..operators.search import Corpus


def term_stream(docs: DataFrame, name: str = "text", key: str = "doc_id", fields: dict | None = None) -> DataFrame:
    """Rows (key, pos, term) of a stream of documents."""
    return search.tokens(Corpus(docs, key, fields) if fields else Corpus(docs, key), name)


def windowed_counts(docs: DataFrame, time_col: str, window: str, late: str, name: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (start, end, term, tf): counts in windows of event time, closed when the watermark passes them."""
    rows = docs.where(F.col(key).isNotNull()).withWatermark(time_col, late)
    corpus = Corpus(rows, key)
    terms = rows.select(F.col(time_col), F.explode(corpus.terms(name)).alias("term")).where("term is not null")
    return terms.groupBy(F.window(time_col, window), "term").agg(F.count("*").alias("tf")).select("window.start", "window.end", "term", "tf")
