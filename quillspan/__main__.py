"""python -m quillspan index|dump ...: postings of a source, or its frequent terms."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .functions.analysis import ENGLISH_STOPS, Analyzer
from .operators import stats
from .operators.search import Corpus
from .plans.parser import FieldType
from .sources import ingest


def source(spark: SparkSession, a: argparse.Namespace) -> Corpus:
    if a.kind == "directory":
        rows = ingest.text_directory(spark, a.input)
    elif a.kind == "lines":
        rows = ingest.text_lines(spark, a.input)
    elif a.kind == "jdbc":
        rows = ingest.jdbc(spark, a.input, a.query)
    else:
        rows = spark.read.parquet(a.input)
    return Corpus(rows, a.key, {a.field: FieldType(analyzer=Analyzer(stops=ENGLISH_STOPS if a.english_stops else frozenset()))})


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillspan")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "dump"):
        p = commands.add_parser(name)
        p.add_argument("input", help="a folder, files, a table or the address of a database")
        p.add_argument("output")
        p.add_argument("--kind", choices=("parquet", "directory", "lines", "jdbc"), default="parquet")
        p.add_argument("--query", help="of a database")
        p.add_argument("--key", default="doc_id")
        p.add_argument("--field", default="text")
        p.add_argument("--english-stops", action="store_true")
    p.add_argument("-n", type=int, default=100)
    p.add_argument("--by", choices=("df", "tf"), default="df")
    p.add_argument("--min", type=int, default=0, help="documents of a term, at least")
    p.add_argument("--max", type=int, help="and at most")
    p.add_argument("--min-share", type=float)
    p.add_argument("--max-share", type=float)
    p.add_argument("--stops", help="a file of words to leave out")
    p.add_argument("--first", help="a file of words that the dump begins with")
    p.add_argument("--df", action="store_true", help="with documents of each term")
    p.add_argument("--tf", action="store_true", help="with occurrences of each term")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    corpus = source(spark, a)
    if a.command == "index":
        ingest.write_postings(corpus, a.field, a.output)
        return
    words = lambda path: stats.word_list(spark, path) if path and os.path.getsize(path) else []
    first = words(a.first)
    terms = stats.top_terms(corpus, a.field, a.n, a.by, a.min, a.max, a.min_share, a.max_share, words(a.stops), first)
    stats.dump(terms, a.output, first, a.df, a.tf)


if __name__ == "__main__":
    main()
