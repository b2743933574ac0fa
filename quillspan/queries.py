"""Queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analysis import ENGLISH_STOPS, WORDS, Analyzer
from .operators import kwic, search, stats
from .operators.search import Corpus
from .plans import ir, requests
from .plans.parser import FieldType, Options
from .sources import ingest
from .sources.schema import captured, cleaned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RX = r"[\p{L}\p{N}]+"
TOK = rf"""tok AS (
  SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos
  FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{RX}'), lambda t: lower(t)) AS ws FROM documents)
)"""
VOC = TOK + ", voc AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tok GROUP BY term), total AS (SELECT count(*) AS docs FROM documents)"
OFFSETS = rf"""parts AS (
  SELECT doc_id, regexp_extract_all(text, '{RX}') AS tk, string_split_regex(text, '{RX}') AS gp FROM documents
), placed AS (
  SELECT doc_id, unnest(tk) AS raw, unnest(range(len(tk))) AS pos, unnest(gp[1 : len(tk)]) AS gap, unnest(gp[2 : len(tk) + 1]) AS after FROM parts
), off AS (
  SELECT doc_id, pos, raw, gap, after, lower(raw) AS term, (sum(len(gap) + len(raw)) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS ce FROM placed
)"""


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def documents(spark: SparkSession, sf_dir: str, analyzer: Analyzer = Analyzer(), **options) -> Corpus:  # noqa: ANN003
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Corpus(rows, fields={"text": FieldType(analyzer=analyzer), "lang": FieldType("string"), "source": FieldType("string"), "n_chars": FieldType("bigint")}, options=Options(**options))


def longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


# Analysis and vocabulary

register("tokens_positions", lambda s, d: longs(search.tokens(documents(s, d), "text")), f"WITH {TOK} SELECT doc_id, pos, term FROM tok")


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = kwic.windows(documents(spark, sf_dir), ir.Matches("text", ".+"), before=0, after=0, order="NONE")
    return w.select("doc_id", F.col("s").cast("long").alias("pos"), "char_start", "char_end", "target")


register("token_offsets", token_offsets, f"WITH {OFFSETS} SELECT doc_id, pos, ce - len(raw) AS char_start, ce AS char_end, raw AS target FROM off")
register("vocabulary", lambda s, d: stats.vocabulary(documents(s, d)), f"WITH {VOC} SELECT * FROM voc")
register("vocab_topn_df", lambda s, d: stats.top_terms(documents(s, d), n=100), f"WITH {VOC} SELECT * FROM voc ORDER BY df DESC, term LIMIT 100")
register("vocab_topn_tf", lambda s, d: stats.top_terms(documents(s, d), n=100, by="tf"), f"WITH {VOC} SELECT * FROM voc ORDER BY tf DESC, term LIMIT 100")
register("vocab_min_pct", lambda s, d: stats.top_terms(documents(s, d), n=None, min_share=0.05, max_share=0.5), f"WITH {VOC} SELECT voc.* FROM voc, total WHERE df >= 0.05 * docs AND df <= 0.5 * docs")
STOP_LIST = ", ".join(f"'{w}'" for w in sorted(ENGLISH_STOPS))
register("vocab_stopwords", lambda s, d: stats.top_terms(documents(s, d), n=50, stops=sorted(ENGLISH_STOPS)), f"WITH {VOC} SELECT * FROM voc WHERE term NOT IN ({STOP_LIST}) ORDER BY df DESC, term LIMIT 50")


def idf_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir)
    rows = stats.vocabulary(c).crossJoin(F.broadcast(stats.doc_total(c)))
    value = stats.idf(F.col("df"), F.col("docs"))
    return rows.select("term", F.round(value, 9).alias("idf"), F.round(stats.df_of_idf(value, F.col("docs")), 6).alias("back"), F.round(stats.idf_of(F.col("df"), F.col("docs")), 9).alias("plain"))


register("idf_single", idf_single, f"WITH {VOC} SELECT term, round(ln((docs + 1.0) / df), 9) AS idf, round((docs + 1.0) / exp(ln((docs + 1.0) / df)), 6) AS back, round(ln(docs / df), 9) AS plain FROM voc, total")


def idf_phrase_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lower("text").alias("phrase"))
    return stats.phrase_idf(documents(spark, sf_dir), phrases).select("phrase", F.round("sum_idf", 6).alias("sum_idf"), "min_df")


register(
    "idf_phrase_sum", idf_phrase_sum,
    f"""WITH {VOC}, ph AS (SELECT DISTINCT lower(text) AS phrase FROM benchmark WHERE text IS NOT NULL), w AS (SELECT phrase, unnest(list_filter(string_split_regex(phrase, '\\s+'), lambda x: x <> '')) AS term FROM ph)
SELECT phrase, round(sum(ln((docs + 1.0) / CASE WHEN coalesce(df, 0) <= 0 THEN 2 ELSE df END)), 6) AS sum_idf, min(CASE WHEN coalesce(df, 0) <= 0 THEN 2 ELSE df END) AS min_df
FROM w LEFT JOIN voc USING (term) CROSS JOIN total GROUP BY phrase""",
)

# Leaves and spans, each from its query string


def spans_of(name: str, text: str, sql: str, **options) -> None:  # noqa: ANN003
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = documents(spark, sf_dir, **options)
        return longs(search.spans(c, c.parse_spans(text)))

    register(name, query, f"WITH {TOK} {sql}")


def leaf(name: str, text: str, condition: str, **options) -> None:  # noqa: ANN003
    spans_of(name, text, f"SELECT doc_id, pos AS s, pos + 1 AS e FROM tok WHERE {condition}", **options)


leaf("leaf_term", "The", "term = 'the'")
leaf("leaf_prefix", "con*", "starts_with(term, 'con')")
leaf("leaf_wildcard", "?o*t", "regexp_full_match(term, '.o.*t')", leading_wildcard=True)
leaf("leaf_regex", "/[a-c].*(ed|ing)/", "regexp_full_match(term, '[a-c].*(ed|ing)')")
leaf("leaf_range", "{mab TO mor]", "term > 'mab' AND term <= 'mor'")


def whole(name: str, query_of: Callable[[Corpus], ir.Query], condition: str) -> None:
    """All terms that match, with their counts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = documents(spark, sf_dir)
        return stats.term_counts(c, query_of(c)).select("term", "df", "tf")

    register(name, query, f"WITH {VOC} SELECT term, df, tf FROM voc WHERE {condition}")


PLAIN = "regexp_replace(term, '[^a-z0-9]', '#', 'g')"  # DuckDB's distances count bytes: letters that the word hasn't are one sign
whole("leaf_fuzzy1_osa", lambda c: ir.Similar("text", "form", 1), f"damerau_levenshtein({PLAIN}, 'form') <= 1")
whole("leaf_fuzzy_lev", lambda c: ir.Similar("text", "house", 2, 1, False), f"starts_with(term, 'h') AND levenshtein({PLAIN}, 'house') <= 2")
whole("leaf_slow_fuzzy3", lambda c: ir.Similar("text", "system", 3), f"levenshtein({PLAIN}, 'system') <= 3")
whole("leaf_fuzzy_parsed", lambda c: c.parse_spans("thenth~>2,1"), f"starts_with(term, 't') AND levenshtein({PLAIN}, 'thenth') <= 2")
whole("term_counts", lambda c: ir.StartsWith("text", "con"), "starts_with(term, 'con')")


def prefix_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir)
    return longs(search.spans(c, search.expanded(c, c.parse_spans("con*"), 5)))


register("leaf_prefix_top", prefix_top, f"WITH {VOC}, top AS (SELECT term FROM voc WHERE starts_with(term, 'con') ORDER BY df DESC, term LIMIT 5) SELECT doc_id, pos AS s, pos + 1 AS e FROM tok WHERE term IN (SELECT term FROM top)")


def two(a: str, b: str, near: str) -> str:
    return f"FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.term = '{a}' AND b.term = '{b}' AND {near}"


spans_of("phrase_exact", '"of the"', "SELECT doc_id, pos AS s, pos + 2 AS e FROM (SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM tok) WHERE term = 'of' AND following = 'the'")
spans_of("near_ordered", "[the and]~>3", f"SELECT a.doc_id, a.pos AS s, min(b.pos) + 1 AS e {two('the', 'and', 'b.pos BETWEEN a.pos + 1 AND a.pos + 4')} GROUP BY ALL")
spans_of(
    "near_unordered", "[the and]~3",
    f"SELECT a.doc_id, a.pos AS s, min(b.pos) + 1 AS e {two('the', 'and', 'b.pos BETWEEN a.pos + 1 AND a.pos + 4')} GROUP BY ALL UNION SELECT a.doc_id, a.pos AS s, min(b.pos) + 1 AS e {two('and', 'the', 'b.pos BETWEEN a.pos + 1 AND a.pos + 4')} GROUP BY ALL",
)
spans_of(
    "near_three", "[the of and]~>8",
    f""", ab AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS m {two('the', 'of', 'b.pos > a.pos')} GROUP BY ALL), abc AS (SELECT ab.doc_id, s, min(c.pos) AS l FROM ab JOIN tok c ON c.doc_id = ab.doc_id AND c.term = 'and' AND c.pos > m GROUP BY ab.doc_id, s, m)
SELECT doc_id, s, l + 1 AS e FROM abc WHERE l - s - 2 <= 8""",
)
spans_of(
    "near_nested", '["of the" in]~>5',
    f""", ab AS (SELECT a.doc_id, a.pos AS s, b.pos + 1 AS m {two('of', 'the', 'b.pos = a.pos + 1')})
SELECT ab.doc_id, s, min(c.pos) + 1 AS e FROM ab JOIN tok c ON c.doc_id = ab.doc_id AND c.term = 'in' AND c.pos BETWEEN m AND m + 5 GROUP BY ab.doc_id, s, m""",
)
spans_of(
    "near_multiterm", "[(the of) (s* con*)]~>4",
    "SELECT a.doc_id, a.pos AS s, min(b.pos) + 1 AS e FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.term IN ('the', 'of') AND (starts_with(b.term, 's') OR starts_with(b.term, 'con')) AND b.pos BETWEEN a.pos + 1 AND a.pos + 5 GROUP BY ALL",
)
NOT = "SELECT a.doc_id, a.pos AS s, a.pos + 1 AS e FROM tok a WHERE a.term = 'the' AND NOT EXISTS (SELECT 1 FROM tok b WHERE b.doc_id = a.doc_id AND b.term = 'of' AND b.pos < a.pos + 1 + {post} AND b.pos + 1 > a.pos - {pre})"
spans_of("not_near", "[the of]!~2", NOT.format(pre=2, post=2))
spans_of("not_near_asym", "[the of]!~0,4", NOT.format(pre=0, post=4))
leaf("pos_first", "the@..10", "term = 'the' AND pos + 1 <= 10")
leaf("pos_range", "the@20..40", "term = 'the' AND pos >= 20 AND pos + 1 <= 40")
leaf("span_or", "(the of fox)", "term IN ('the', 'of', 'fox')")


def overlap_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir)
    return longs(search.without_overlaps(search.spans(c, c.parse_spans('(the "of the")')), c.key))


register(
    "overlap_drop", overlap_drop,
    f"""WITH {TOK}, two AS (SELECT doc_id, pos AS s FROM (SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM tok) WHERE term = 'of' AND following = 'the')
SELECT doc_id, s, s + 2 AS e FROM two UNION ALL SELECT doc_id, pos, pos + 1 FROM tok WHERE term = 'the' AND NOT EXISTS (SELECT 1 FROM two WHERE two.doc_id = tok.doc_id AND two.s BETWEEN pos - 1 AND pos + 1)""",
)

# Stop words: holes in phrases, wider distances, clauses of nothing else, edges of windows

STOPPED = Analyzer(stops=ENGLISH_STOPS)
STOPS = "(" + ", ".join(f"'{w}'" for w in sorted(ENGLISH_STOPS)) + ")"
spans_of("stop_near", "[er the st]~>4", f"SELECT a.doc_id, a.pos AS s, min(b.pos) + 1 AS e {two('er', 'st', 'b.pos BETWEEN a.pos + 1 AND a.pos + 6')} GROUP BY ALL", analyzer=STOPPED)
spans_of("stop_phrase", "'st of the th'", f"SELECT a.doc_id, a.pos AS s, min(b.pos) + 1 AS e {two('st', 'th', 'b.pos BETWEEN a.pos + 1 AND a.pos + 3')} GROUP BY ALL", analyzer=STOPPED)
spans_of("stop_inside", "[er st]~>2", f"SELECT a.doc_id, a.pos AS s, min(b.pos) + 1 AS e {two('er', 'st', 'b.pos BETWEEN a.pos + 1 AND a.pos + 3')} GROUP BY ALL", analyzer=STOPPED)


def repeated_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id")
    return longs(search.spans(c, c.parse_spans("[the of]~>6")))


TURNS = rf"""turns AS (SELECT DISTINCT conv_id, text FROM conversations), tok AS (
  SELECT conv_id, text, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM (SELECT conv_id, text, list_transform(regexp_extract_all(text, '{RX}'), lambda t: lower(t)) AS ws FROM turns)
)"""
register(
    "repeated_near", repeated_near,
    f"WITH {TURNS} SELECT conv_id, s, e FROM (SELECT a.conv_id, a.text, a.pos AS s, min(b.pos) + 1 AS e FROM tok a JOIN tok b ON a.conv_id = b.conv_id AND a.text = b.text AND a.term = 'the' AND b.term = 'of' AND b.pos BETWEEN a.pos + 1 AND a.pos + 7 GROUP BY ALL)",
)


def bigram_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir)
    return longs(c.rows().select("doc_id", c.terms("text").alias("t")).select("doc_id", F.inline(search.bigrams("t"))))


register("bigram_tokens", bigram_tokens, f"WITH {TOK} SELECT doc_id, pos, term FROM tok UNION ALL SELECT doc_id, pos, term || '_' || following FROM (SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM tok) WHERE following IS NOT NULL")

# Documents


def docs_of(name: str, text: str, sql: str, **options) -> None:  # noqa: ANN003
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = documents(spark, sf_dir, **options)
        return search.documents(c, c.parse(text))

    register(name, query, f"WITH {TOK}, has AS (SELECT DISTINCT doc_id, term FROM tok) SELECT doc_id FROM documents d WHERE {sql}")


def has(*terms: str) -> str:
    return "EXISTS (SELECT 1 FROM has h WHERE h.doc_id = d.doc_id AND h.term IN (" + ", ".join(f"'{t}'" for t in terms) + "))"


docs_of("bool_must_should_not", "+the of -and", f"{has('the')} AND NOT {has('and')}")
docs_of("bool_min_should", "(the of and in)~3", f"{has('the')}::INT + {has('of')}::INT + {has('and')}::INT + {has('in')}::INT >= 3")
docs_of("bool_negative", "-the -de", f"NOT {has('the', 'de')}")
docs_of("bool_fielded", "+lang:en +(the OR of) -source:src0", f"lang = 'en' AND {has('the', 'of')} AND coalesce(source, '') <> 'src0'")
docs_of("bool_default_and", "the of (and OR in)", f"{has('the')} AND {has('of')} AND {has('and', 'in')}", default_and=True)
docs_of("parsed_mixed", '"of the"~>2 AND NOT con*', "EXISTS (SELECT 1 FROM tok a JOIN tok b USING (doc_id) WHERE a.doc_id = d.doc_id AND a.term = 'of' AND b.term = 'the' AND b.pos BETWEEN a.pos + 1 AND a.pos + 3) AND NOT EXISTS (SELECT 1 FROM has h WHERE h.doc_id = d.doc_id AND starts_with(h.term, 'con'))")
docs_of("stop_only_clause", "+the +er", has("er"), analyzer=STOPPED)
docs_of("match_all", "*:* -the", f"NOT {has('the')}")
docs_of("typed_range_int", "n_chars:[500 TO 900} the", f"n_chars BETWEEN 500 AND 899 OR {has('the')}")
register("doc_count", lambda s, d: search.doc_count(documents(s, d), ir.TermIs("text", "the")), f"WITH {TOK} SELECT count(DISTINCT doc_id) AS n_docs FROM tok WHERE term = 'the'")  # ids are unique in documents
register("facets_lang", lambda s, d: search.facets(documents(s, d), ir.TermIs("text", "in"), "lang"), f"WITH {TOK} SELECT lang AS value, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM tok WHERE tok.doc_id = d.doc_id AND term = 'in') GROUP BY lang")


def typed_range_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    c = Corpus(events, "event_id", {"ts": FieldType("timestamp"), "event_type": FieldType("string")}, Options("event_type"))
    low, high = "'2024-01-05 00:00:00'", "'2024-01-20 12:00:00'"
    return search.documents(c, c.parse(f"+ts:[{low} TO {high}}} +event_type:c*"))


register("typed_range_date", typed_range_date, "SELECT DISTINCT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 12:00:00' AND starts_with(event_type, 'c')")


def typed_eq_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    c = Corpus(labels, "doc_id", {"quality": FieldType("int"), "toxic": FieldType("int")}, Options("quality"))
    return search.documents(c, c.parse("+1 -toxic:1"))


register("typed_eq_int", typed_eq_int, "SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND NOT coalesce(toxic = 1, false)")

# Windows


def kwic_sql(condition: str, before: int, after: int, key: str, more: str = "") -> str:
    return f"""WITH {OFFSETS}, win AS (
  SELECT h.doc_id, h.pos, coalesce(left(p, len(p) - 1), '') AS pre, h.raw AS target, coalesce(post, '') AS post, trim(coalesce({key}, '')) AS sort_key, h.ce - len(h.raw) AS char_start
  FROM (SELECT * FROM off WHERE {condition}) h JOIN (
    SELECT h.doc_id, h.pos, string_agg(o.raw || o.after, '' ORDER BY o.pos) FILTER (o.pos < h.pos) AS p, string_agg(o.gap || o.raw, '' ORDER BY o.pos) FILTER (o.pos > h.pos) AS post,
      string_agg(o.term, ' ' ORDER BY o.pos DESC) FILTER (o.pos < h.pos) AS back, string_agg(o.term, ' ' ORDER BY o.pos) FILTER (o.pos > h.pos) AS forth
    FROM (SELECT doc_id, pos FROM off WHERE {condition}) h JOIN off o ON o.doc_id = h.doc_id AND o.pos BETWEEN h.pos - {before} AND h.pos + {after} GROUP BY h.doc_id, h.pos
  ) w USING (doc_id, pos)
) {more or 'SELECT * FROM win'}"""


BACK, FORTH = "back", "forth"


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("s").cast("long").alias("pos"), "pre", "target", "post", "sort_key", "char_start")


def windows_of(name: str, text: str, order: str, key: str, before: int = 5, after: int = 5, condition: str = "term = 'the'") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = documents(spark, sf_dir)
        return shown(kwic.windows(c, c.parse(text), before=before, after=after, order=order))

    register(name, query, kwic_sql(condition, before, after, key))


windows_of("kwic_pre", "the", "PRE", BACK)
windows_of("kwic_post", "the", "POST", FORTH)
windows_of("kwic_target_pre", "con*", "TARGET_PRE", "h.term || ' ' || coalesce(back, '')", 3, 4, "starts_with(term, 'con')")
windows_of("kwic_target_post", "con*", "TARGET_POST", "h.term || ' ' || coalesce(forth, '')", 3, 4, "starts_with(term, 'con')")
windows_of("kwic_doc", "(fox of)", "DOC", "h.doc_id::VARCHAR", condition="term IN ('fox', 'of')")


def kwic_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir, analyzer=STOPPED)
    return shown(kwic.windows(c, c.parse("st"), before=4, after=4))


register(
    "kwic_stops", kwic_stops,
    f"""WITH {OFFSETS}, h AS (SELECT * FROM off WHERE term = 'st'), near AS (
  SELECT h.doc_id, h.pos, o.pos AS p, o.raw, o.gap, o.after, o.term, o.term NOT IN {STOPS} AS seen FROM h JOIN off o ON o.doc_id = h.doc_id AND o.pos BETWEEN h.pos - 4 AND h.pos + 4
), edge AS (SELECT doc_id, pos, min(p) FILTER (p < pos AND seen) AS first, max(p) FILTER (p > pos AND seen) AS last FROM near GROUP BY doc_id, pos),
win AS (
  SELECT doc_id, pos, string_agg(raw || after, '' ORDER BY p) FILTER (p < pos AND p >= first) AS pre, string_agg(gap || raw, '' ORDER BY p) FILTER (p > pos AND p <= last) AS post,
    string_agg(term, ' ' ORDER BY p DESC) FILTER (p < pos AND seen) AS back
  FROM near JOIN edge USING (doc_id, pos) GROUP BY doc_id, pos
)
SELECT doc_id, pos, coalesce(left(pre, len(pre) - 1), '') AS pre, h.raw AS target, coalesce(post, '') AS post, coalesce(back, '') AS sort_key, h.ce - len(h.raw) AS char_start FROM win JOIN h USING (doc_id, pos)""",
)


def kwic_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as documents that share their conversation's name: offsets are in the turn."""
    c = Corpus(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id")
    w = kwic.windows(c, c.parse("the"), before=3, after=3, order="NONE", metadata=["turn"])
    return w.select("conv_id", F.col("metadata")["turn"].cast("long").alias("turn"), F.col("s").cast("long").alias("pos"), "pre", "target", "post", "char_start")


register(
    "kwic_repeated", kwic_repeated,
    rf"""WITH parts AS (SELECT conv_id, turn, regexp_extract_all(text, '{RX}') AS tk, string_split_regex(text, '{RX}') AS gp FROM conversations),
placed AS (SELECT conv_id, turn, unnest(tk) AS raw, unnest(range(len(tk))) AS pos, unnest(gp[1 : len(tk)]) AS gap, unnest(gp[2 : len(tk) + 1]) AS after FROM parts),
off AS (SELECT *, lower(raw) AS term, (sum(len(gap) + len(raw)) OVER (PARTITION BY conv_id, turn ORDER BY pos))::BIGINT AS ce FROM placed),
w AS (SELECT h.conv_id, h.turn, h.pos, string_agg(o.raw || o.after, '' ORDER BY o.pos) FILTER (o.pos < h.pos) AS p, string_agg(o.gap || o.raw, '' ORDER BY o.pos) FILTER (o.pos > h.pos) AS post
  FROM (SELECT * FROM off WHERE term = 'the') h JOIN off o ON o.conv_id = h.conv_id AND o.turn = h.turn AND o.pos BETWEEN h.pos - 3 AND h.pos + 3 GROUP BY ALL)
SELECT h.conv_id, h.turn, h.pos, coalesce(left(p, len(p) - 1), '') AS pre, h.raw AS target, coalesce(post, '') AS post, h.ce - len(h.raw) AS char_start FROM w JOIN off h USING (conv_id, turn, pos)""",
)


def kwic_built_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by what follows, then by what stands before."""
    c = documents(spark, sf_dir)
    return shown(kwic.windows(c, c.parse("con*"), before=3, after=3, order=lambda before, target, after: F.concat_ws(">", F.get(after, 0), F.get(before, 0))))


register("kwic_built_key", kwic_built_key, kwic_sql("starts_with(term, 'con')", 3, 3, "concat_ws('>', string_split(forth, ' ')[1], string_split(back, ' ')[1])"))


def kwic_same_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window for each target and what follows it."""
    c = documents(spark, sf_dir)
    w = kwic.deduplicated(kwic.windows(c, c.parse("con*"), before=0, after=1), same=lambda x: [F.lower(x("target")), F.lower(x("post"))])
    return w.select("doc_id", F.col("s").cast("long").alias("pos"), "target", "post", "count")


register(
    "kwic_same_target", kwic_same_target,
    kwic_sql("starts_with(term, 'con')", 0, 1, "''", ", d AS (SELECT *, row_number() OVER (PARTITION BY lower(target), lower(post) ORDER BY doc_id, pos) AS k, count(*) OVER (PARTITION BY lower(target), lower(post)) AS \"count\" FROM win) SELECT doc_id, pos, target, post, \"count\" FROM d WHERE k = 1"),
)


def kwic_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two corpora as of one: those that agree are one, and their counts are summed."""
    c = documents(spark, sf_dir)
    shards = [Corpus(c.docs.where(w), c.key, c.fields, c.options) for w in ("source = 'src0'", "not source <=> 'src0'")]
    out = kwic.merged([kwic.deduplicated(kwic.windows(x, x.parse("of"), before=1, after=1)) for x in shards], dedup=True)
    return out.select("doc_id", F.col("s").cast("long").alias("pos"), "pre", "target", "post", "count")


register(
    "kwic_merged", kwic_merged,
    kwic_sql("term = 'of'", 1, 1, "''", ", d AS (SELECT *, row_number() OVER (PARTITION BY lower(pre), lower(target), lower(post) ORDER BY doc_id, pos) AS k, count(*) OVER (PARTITION BY lower(pre), lower(target), lower(post)) AS \"count\" FROM win) SELECT doc_id, pos, pre, target, post, \"count\" FROM d WHERE k = 1"),
)


def kwic_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by request parameters; what can't be read is passed over."""
    c = documents(spark, sf_dir)
    asked = requests.kwic_options({"tokensBefore": "2", "tokensAfter": "many", "sortOrder": "post", "maxWindows": "500", "targetOverlaps": "false"})
    return shown(kwic.windows(c, c.parse("the"), **asked))


register("kwic_request", kwic_request, kwic_sql("term = 'the'", 2, 10, FORTH, "SELECT * FROM win ORDER BY doc_id, pos LIMIT 500"))


def window_visitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a term, and how many documents begin with it."""
    c = documents(spark, sf_dir)
    return kwic.visited(kwic.term_windows(c, c.parse("the"), before=0, after=1), F.sum((F.col("s") == 0).cast("long")).alias("first"), by=[F.get("post", 0).alias("following")])


register("window_visitor", window_visitor, f"WITH {TOK} SELECT following, count(*) AS n_windows, sum((pos = 0)::BIGINT)::BIGINT AS first FROM (SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM tok) WHERE term = 'the' GROUP BY following")


def kwic_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir)
    return shown(kwic.windows(c, c.parse("the"), before=5, after=5, limit=100))


register("kwic_limit", kwic_limit, kwic_sql("term = 'the'", 5, 5, BACK, "SELECT * FROM win ORDER BY doc_id, pos LIMIT 100"))


def kwic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir)
    out = kwic.deduplicated(kwic.windows(c, c.parse("of"), before=2, after=2))
    return out.select("doc_id", F.col("s").cast("long").alias("pos"), "pre", "target", "post", "count")


register(
    "kwic_dedup", kwic_dedup,
    kwic_sql("term = 'of'", 2, 2, "''", ", d AS (SELECT *, row_number() OVER (PARTITION BY lower(pre), lower(target), lower(post) ORDER BY doc_id, pos) AS k, count(*) OVER (PARTITION BY lower(pre), lower(target), lower(post)) AS \"count\" FROM win) SELECT doc_id, pos, pre, target, post, \"count\" FROM d WHERE k = 1"),
)


def kwic_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    return shown(kwic.windows(c, c.parse("+the -fox"), before=5, after=5, order="PRE", where=good))


register("kwic_filtered", kwic_filtered, kwic_sql("term = 'the' AND doc_id NOT IN (SELECT doc_id FROM off WHERE term = 'fox') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", 5, 5, BACK))


def kwic_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir)
    rows = kwic.windows(c, c.parse("con*"), before=3, after=3, metadata=["lang", "source"])
    return rows.select("doc_id", F.col("s").cast("long").alias("pos"), "target", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


register("kwic_metadata", kwic_metadata, f"WITH {TOK} SELECT doc_id, pos, regexp_extract_all(text, '{RX}')[pos + 1] AS target, lang, source FROM tok JOIN documents USING (doc_id) WHERE starts_with(term, 'con')")


def kwic_multivalued(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.values_by_key(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn")
    c = Corpus(rows, "conv_id")
    out = kwic.windows(c, c.parse("the"), before=4, after=4, order="NONE")
    return out.select("conv_id", F.col("s").cast("long").alias("pos"), "pre", "target", "post", "char_start")


register(
    "kwic_multivalued", kwic_multivalued,
    rf"""WITH v AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k, text FROM conversations WHERE len(regexp_extract_all(text, '{RX}')) > 0),
based AS (SELECT *, regexp_extract_all(text, '{RX}') AS tk, string_split_regex(text, '{RX}') AS gp,
  coalesce(sum(len(text) + 3) OVER w, 0)::BIGINT AS base, coalesce(sum(len(text) + 1) OVER w, 0)::BIGINT AS apart, coalesce(sum(len(regexp_extract_all(text, '{RX}'))) OVER w, 0)::BIGINT AS shift
  FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
placed AS (SELECT conv_id, k, base, apart, shift, unnest(tk) AS raw, unnest(range(len(tk))) AS i, unnest(list_transform(range(1, len(tk) + 1), lambda x: len(gp[x]))) AS gap FROM based),
off AS (SELECT conv_id, shift + i AS pos, raw, base, apart, (sum(gap + len(raw)) OVER (PARTITION BY conv_id, k ORDER BY i))::BIGINT AS ce FROM placed),
whole AS (SELECT conv_id, string_agg(text, ' | ' ORDER BY k) AS text, sum(len(tk))::BIGINT AS n FROM based GROUP BY conv_id)
SELECT h.conv_id, h.pos, CASE WHEN h.pos = 0 THEN '' ELSE substring(text, f.base + f.ce - len(f.raw) + 1, (h.base + h.ce - len(h.raw) - 1) - (f.base + f.ce - len(f.raw))) END AS pre, h.raw AS target,
  CASE WHEN h.pos = n - 1 THEN '' ELSE substring(text, h.base + h.ce + 1, l.base + l.ce - h.base - h.ce) END AS post, h.apart + h.ce - len(h.raw) AS char_start
FROM off h JOIN whole USING (conv_id) JOIN off f ON f.conv_id = h.conv_id AND f.pos = greatest(0, h.pos - 4) JOIN off l ON l.conv_id = h.conv_id AND l.pos = least(n - 1, h.pos + 4)
WHERE lower(h.raw) = 'the'""",
)

# Grams, targets, contrast

def cooccur(name: str, sql: str, text: str = "fox", analyzer: Analyzer = Analyzer(), **options) -> None:  # noqa: ANN003
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = documents(spark, sf_dir, analyzer=analyzer)
        rows = stats.cooccurrences(c, c.parse(text), min_tf=3, n=50, before=4, after=4, **options)
        return rows.select("term", "tf", "df", F.round("idf", 6).alias("idf"), F.round("tfidf", 5).alias("tfidf"))

    register(name, query, sql)


def gram_sql(grams: str, target: str, sides: str = "sides") -> str:
    return f"""WITH {VOC},
sides AS (SELECT h.doc_id, h.pos, list(o.term ORDER BY o.pos) FILTER (o.pos < h.pos) AS pre, list(o.term ORDER BY o.pos) FILTER (o.pos > h.pos) AS post
  FROM (SELECT * FROM tok WHERE term = '{target}') h JOIN tok o ON o.doc_id = h.doc_id AND o.pos BETWEEN h.pos - 4 AND h.pos + 4 GROUP BY h.doc_id, h.pos),
dd AS (SELECT DISTINCT pre, post FROM sides), both_sides AS (SELECT pre AS a FROM {sides} UNION ALL SELECT post FROM {sides}),
g AS ({grams}), n AS (SELECT term, count(*) AS tf FROM g GROUP BY term HAVING count(*) >= 3),
r AS (SELECT n.term, n.tf, docs, sum(ln((docs + 1.0) / CASE WHEN coalesce(df, 0) <= 0 THEN 2 ELSE df END)) AS idf FROM (SELECT term, tf, unnest(string_split(term, ' ')) AS word FROM n) n LEFT JOIN voc ON voc.term = word CROSS JOIN total GROUP BY n.term, n.tf, docs)
SELECT term, tf, greatest(1, round((docs + 1.0) / exp(idf)))::BIGINT AS df, round(idf, 6) AS idf, round(tf * idf, 5) AS tfidf FROM r ORDER BY tf * idf DESC, term LIMIT 50"""


UNI = "SELECT unnest(a) AS term FROM both_sides"
BI = "SELECT unnest(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS term FROM both_sides"
TARGET = "for"
cooccur("cooccur_unigram", gram_sql(UNI, TARGET), TARGET)
cooccur("cooccur_ngram", gram_sql(f"{UNI} UNION ALL {BI}", TARGET), TARGET, low=1, high=2)
cooccur("cooccur_wgram", gram_sql(BI, TARGET), TARGET, low=2, high=2, kind="wgram")
cooccur("cooccur_dedup", gram_sql(UNI, TARGET, "dd"), TARGET, dedup=True)
cooccur(
    "cooccur_blacklist", gram_sql(f"SELECT term FROM ({UNI}) WHERE term IN (SELECT term FROM voc, total WHERE ln((docs + 1.0) / df) > 2)", TARGET), TARGET, kind="wgram", reject_idf=2.0,
)

# Words between the ends of a w-gram that are stop words or not accepted stay in it, and count for nothing.
ENDS = "list_filter(range(1, len(a) + 1), lambda i: a[i] IS NOT NULL{more})"
WGRAM = "SELECT unnest(list_transform(range(1, len(g)), lambda k: array_to_string(list_transform(a[g[k] : g[k + 1]], lambda x: coalesce(x, '_')), ' '))) AS term FROM (SELECT a, {ends} AS g FROM both_sides)"


def stopped(sql: str) -> str:
    """The same over terms without stop words, which are null in windows."""
    return sql.replace("list(o.term ORDER BY", f"list(CASE WHEN o.term NOT IN {STOPS} THEN o.term END ORDER BY").replace("count(*) AS tf FROM tok GROUP BY term)", f"count(*) AS tf FROM tok WHERE term NOT IN {STOPS} GROUP BY term)")


cooccur("cooccur_wgram_stops", stopped(gram_sql(WGRAM.format(ends=ENDS.format(more="")), "st")), "st", analyzer=STOPPED, low=2, high=2, kind="wgram")
cooccur("cooccur_wgram_accept", gram_sql(WGRAM.format(ends=ENDS.format(more=" AND len(a[i]) > 3")), TARGET), TARGET, low=2, high=2, kind="wgram", accept=lambda t: F.length(t) > 3)
cooccur("cooccur_grammer", gram_sql("SELECT term || '+' AS term FROM (SELECT unnest(a) AS term FROM both_sides) WHERE len(term) > 3", TARGET), TARGET, kind=lambda a: F.transform(F.filter(a, lambda t: F.length(t) > 3), lambda t: F.concat(t, F.lit("+"))))


def target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir)
    return stats.target_counts(c, c.parse("con*"), n=30)


register("target_counts", target_counts, f"WITH {VOC} SELECT term AS target, df, tf FROM voc WHERE starts_with(term, 'con') ORDER BY df DESC, tf DESC, term LIMIT 30")


def contrast_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir)
    rows = stats.contrast(c, c.parse("fox* OR dog*"), min_docs=1, n=50)
    return rows.select("term", "tf", "df", F.round("idf", 6).alias("idf"), F.round("tfidf", 5).alias("tfidf"))


register(
    "contrast_corpus", contrast_corpus,
    f"""WITH {VOC}, hits AS (SELECT DISTINCT doc_id FROM tok WHERE starts_with(term, 'fox') OR starts_with(term, 'dog')), c AS (SELECT term, count(DISTINCT doc_id) AS tf FROM tok WHERE doc_id IN (SELECT doc_id FROM hits) GROUP BY term)
SELECT term, c.tf, df, round(ln((docs + 1.0) / df), 6) AS idf, round(c.tf * ln((docs + 1.0) / df), 5) AS tfidf FROM c JOIN voc USING (term), total ORDER BY c.tf * ln((docs + 1.0) / df) DESC, term LIMIT 50""",
)

# Sources


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


register(
    "field_mapper_identity", lambda s, d: pages(s, d).select("page_id", F.get(cleaned(F.array("html")), 0).alias("html")),
    r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '\r\n[ \t]*', chr(10), 'g'), '[\r\n][ \t]*', chr(10), 'g'), '\n\n+', chr(10) || chr(10), 'g') AS html FROM pages",
)
register(
    "field_mapper_capture", lambda s, d: pages(s, d).select("page_id", F.get(captured(F.array("url"), "://([^/]+)/(\\w+)", "$2 at $1", "store_as_is"), 0).alias("site")),
    r"SELECT page_id, CASE WHEN regexp_matches(url, '://([^/]+)/(\w+)') THEN regexp_extract(url, '://([^/]+)/(\w+)', 2) || ' at ' || regexp_extract(url, '://([^/]+)/(\w+)', 1) ELSE url END AS site FROM pages",
)


def char_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzer = Analyzer(WORDS, char_filters=(("<[^>]*>", " "),))
    return stats.vocabulary(Corpus(pages(spark, sf_dir), "page_id", {"html": FieldType(analyzer=analyzer)}, Options("html")), "html")


register(
    "char_filter_vocabulary", char_filtered,
    rf"SELECT term, count(DISTINCT page_id) AS df, count(*) AS tf FROM (SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '{RX}'))) AS term FROM pages) GROUP BY term",
)


def multivalue_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.values_by_key(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn")
    return rows.select("conv_id", ingest.multivalue_substring(F.col("text"), 10, 400, 3).alias("part"))


register(
    "multivalue_substring", multivalue_substring,
    """WITH v AS (SELECT conv_id, text, row_number() OVER w AS k, coalesce(sum(len(text) + 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
rest AS (SELECT * FROM v WHERE begins + len(text) > 10),
parts AS (SELECT conv_id, min(begins) AS first, string_agg(substring(text, greatest(10 - begins, 0) + 1, least(400 - begins, len(text)) - greatest(10 - begins, 0)), ' | ' ORDER BY k) FILTER (begins <= 400) AS shown FROM rest GROUP BY conv_id)
SELECT conv_id, CASE WHEN first IS NULL THEN '' ELSE CASE WHEN first > 10 THEN ' | ' ELSE '' END || coalesce(shown, '') END AS part FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) LEFT JOIN parts USING (conv_id)""",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five words around a term, by what stands before it."""
    c = documents(spark, sf_dir)
    return kwic.ordered(kwic.windows(c, c.parse("the"), before=5, after=5))
