"""A corpus pipeline of five stages, each over all that the one before kept.

Stages but the last keep rows of documents whole, whatever columns they have,
and an empty table gives an empty one. Repeated rows are decided on alike, but
for exact dedup, which keeps one of rows alike in id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import decontaminate, exact_dedup, language_id, ngram_join, sentencepiece_bpe, store


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model tells with a probability of a half at least; null and empty texts and those without letters or digits go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first, by id, of the documents with the same text; null texts stay, null ids come last."""
    return exact_dedup.keep_first(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first, by id, of each group of near duplicates; null ids and texts without words are in no group and stay."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null ids and texts without words stay."""
    return decontaminate.without_leaks(docs, store.documents(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, and the texts that they decode to; null for null texts."""
    return sentencepiece_bpe.encode_decode(docs)


STAGES = [
    ("language ID", identified),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", dissimilar),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", encoded),
]

#: Language identification has no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table is deleted when the next one is written."""
    docs, before = store.documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = store.written(stage(spark, docs, sf_dir), f"stage{k}")
        if before is not None:
            store.drop(before)
        before = docs
    return docs
