"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arc_to_warc, decontaminate, exact_dedup, language_id, ngram_join, pii, quality, sentencepiece_bpe, suffix_lm, token_store
from .store import documents

Query = Callable[[SparkSession, str], DataFrame]


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


OP6_SQL = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS copies
FROM documents
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(documents(spark, sf_dir))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(documents(spark, sf_dir))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_to_warc.convert_archives(arc_to_warc.page_archives(documents(spark, sf_dir, "pages")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.train(docs))


def op2_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose id is divisible by 20, each against all others."""
    docs = documents(spark, sf_dir)
    return suffix_lm.score(docs.where("doc_id % 20 = 0"), docs, id_col="doc_id", corpus_id="doc_id").withColumnRenamed("item_id", "doc_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
p AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS overlap
  FROM g a JOIN shared USING (gram) JOIN g b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), s AS (
  SELECT doc_a, doc_b FROM p JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE overlap / (x.n + y.n - overlap) >= 0.5
), e AS (SELECT doc_a, doc_b FROM s UNION ALL SELECT doc_b, doc_a FROM s),
reach AS (SELECT doc_a AS doc, doc_b AS other FROM e UNION SELECT doc, doc_b FROM reach JOIN e ON other = doc_a),
c AS (SELECT doc, min(other) AS least FROM reach GROUP BY doc),
l AS (SELECT doc_a AS doc, count(*) AS links FROM e GROUP BY doc_a)
SELECT doc_id, coalesce(least(doc_id, c.least), doc_id) AS class_id, coalesce(links, 0) AS links
FROM documents LEFT JOIN c ON c.doc = doc_id LEFT JOIN l ON l.doc = doc_id
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op6_exact_dedup, op10_language_id, op4_quality_classifier, op1_ngram_jaccard, op2_suffix_lm, op3_arc_to_warc, op5_decontamination, op7_sentencepiece, op8_pii, op9_token_store)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op3_arc_to_warc": arc_to_warc.SQL, "op6_exact_dedup": OP6_SQL}
