"""Windows, grams and statistics: known results, and a plain model on random documents."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspan.functions.analysis import NON_SPACE, Analyzer
from quillspan.operators import kwic, search, stats
from quillspan.operators.search import Corpus
from quillspan.plans import ir
from quillspan.plans.parser import FieldType, Options
from quillspan.sources import ingest
from quillspan.sources.schema import IndexSchema, Mapper, SchemaError


def corpus(spark, texts, **analyzer):
    kind = "array<string>" if texts and isinstance(texts[0], list) else "string"
    rows = spark.createDataFrame(list(enumerate(texts)), f"doc_id long, f {kind}").repartition(2)
    return Corpus(rows, fields={"f": FieldType(analyzer=Analyzer(NON_SPACE, **analyzer))}, options=Options("f"))


def cut(c, q, before=10, after=10, order="PRE", **more):
    q = c.parse(q) if isinstance(q, str) else q
    return kwic.ordered(kwic.windows(c, q, "f", before, after, order, **more)).collect()


def test_simple(spark):
    c = corpus(spark, ["a b c a b c", "c b a c b a"])
    assert [(w.pre, w.post) for w in cut(c, "a")] == [("", " b c a b c"), ("c b", " c b a"), ("c b a c b", ""), ("a b c", " b c")]
    assert [w.post for w in cut(c, "a", order="POST")] == ["", " b c", " b c a b c", " c b a"]
    assert len(cut(c, "a", limit=3)) == 3 and kwic.hit_limit(c, c.parse("a"), 3) and not kwic.hit_limit(c, c.parse("a"), 4)
    t = kwic.totals(kwic.windows(c, c.parse("a"), "f"), c).first()
    assert (t.n_docs, t.n_windows, t.total_docs) == (2, 4, 2)
    assert [w.sort_key for w in cut(c, "c", 1, 1, "TARGET_PRE")] == ["c", "c a", "c b", "c b"]
    assert [(w.sort_key, w.char_start) for w in cut(c, "b", order="DOC")] == [("0", 2), ("0", 8), ("1", 2), ("1", 8)]


def test_sizes(spark):
    c = corpus(spark, ["a b c d e f g"])
    pres, posts = ["", "c", "b c", "a b c", "a b c"], ["", " e", " e f", " e f g", " e f g"]
    for b, pre in enumerate(pres):
        (w,) = cut(c, "d", b, 4 - b)
        assert (w.pre, w.post, w.target, w.char_start, w.char_end) == (pre, posts[4 - b], "d", 6, 7)
    with pytest.raises(ValueError):
        cut(c, "d", -1)


def test_stops(spark):
    c = corpus(spark, ["a b the d e the f", "g h the d the j"], stops=frozenset(["a", "the"]))
    assert [(w.pre, w.target, w.post) for w in cut(c, "d", 2, 2)] == [("b the", "d", " e"), ("h the", "d", " the j")]


@pytest.mark.parametrize(("gap", "offset", "slop", "n"), [(0, 10, 3, 1), (20, 50, 120, 1), (100, 100, 5, 0)])
def test_values(spark, gap, offset, slop, n):
    c = corpus(spark, [["a b c a b the", "clockwork", "orange b a c b a"]], position_gap=gap, offset_gap=offset)
    q = ir.NearBy(tuple(ir.TermIs("f", t) for t in ("the", "clockwork", "orange")), slop, True)
    got = cut(c, q, 3, 3)
    assert len(got) == n
    for w in got:
        assert (w.pre, w.target, w.post) == ("c a b", "the | clockwork | orange", " b a c")
        assert (w.char_start, w.char_end) == (10, 13 + offset + 9 + offset + 6)


def test_boolean_queries(spark):
    c = corpus(spark, ["a b c d e c b a", "a b d", "c a e"])
    assert len(cut(c, "a c")) == 7
    assert len(cut(c, "+a -d")) == 1 and len(cut(c, "+c +b")) == 4
    only = spark.createDataFrame([(1,)], "doc_id long")
    assert [w.doc_id for w in cut(c, "a", where=only)] == [1]
    p = corpus(spark, ["ba bb ca", "ba cc", "dd"])
    assert len(cut(p, "b*")) == 3


def test_dedup(spark):
    c = corpus(spark, ["a b c d c b a", "a B C d c b a", "a b C d C B a", "a b c d C B A", "e f g d g f e", "h i j d j i h"])
    w = kwic.windows(c, c.parse("d"), "f")
    assert sorted((r["count"], r.pre) for r in kwic.deduplicated(w).collect()) == [(1, "e f g"), (1, "h i j"), (4, "a b c")]
    assert [r.doc_id for r in kwic.deduplicated(w, limit=2).collect()] == [0, 4]


def test_overlaps_and_metadata(spark):
    c = corpus(spark, ["a b c"])
    q = ir.AnyOf((ir.TermIs("f", "a"), ir.NearBy((ir.TermIs("f", "a"), ir.TermIs("f", "b")), 0, True)))
    assert len(cut(c, q)) == 1 and len(cut(c, q, overlaps=True)) == 2
    d = Corpus(c.docs.withColumn("lang", F.lit("en")), fields=c.fields, options=c.options)
    assert cut(d, "a", metadata=["lang"])[0].metadata == {"lang": "en"}
    assert len(kwic.merged([kwic.windows(c, c.parse("a"), "f"), kwic.windows(c, c.parse("c"), "f")]).collect()) == 2


def test_random_windows(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["ab", "c", "é", " ", ", ", "\n", "x1"]) for _ in range(rng.randint(0, 40))) for _ in range(40)] + ["c " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = Corpus(rows)
    got = {(r.doc_id, r.s): r for r in kwic.windows(c, ir.TermIs("text", "c"), before=2, after=3).collect()}
    n = 0
    for d, t in enumerate(texts):
        tokens = list(re.finditer(r"[^\W_]+", t))
        for k, m in enumerate(tokens):
            if m[0].lower() == "c":
                n += 1
                r = got[d, k]
                a = tokens[max(0, k - 2)].start()
                b = tokens[min(len(tokens) - 1, k + 3)].end()
                assert (r.pre, r.target, r.post, r.char_start, r.char_end) == (t[a : max(a, m.start() - 1)] if k else "", "c", t[m.end() : b] if k < len(tokens) - 1 else "", m.start(), m.end())
    assert n == len(got)


def grams(rows):
    return {r.term: r.tf for r in rows.collect()}


def test_cooccurrence(spark):
    c = corpus(spark, ["a b c d e f", "b c d g f e"])
    d = c.parse("d")
    assert grams(stats.cooccurrences(c, d, "f", kind="wgram", min_tf=0)) == {"a": 1, "g": 1, "b": 2, "c": 2, "e": 2, "f": 2} == grams(stats.cooccurrences(c, d, "f", min_tf=0))
    assert grams(stats.cooccurrences(c, d, "f", 1, 1, min_tf=0)) == {"c": 2, "e": 1, "g": 1}
    assert grams(stats.cooccurrences(c, d, "f", 2, 2, 2, 2, min_tf=0)) == {"b c": 2, "e f": 1, "g f": 1}
    s = corpus(spark, ["a b the d the f", "b c the d the e"], stops=frozenset(["a", "the"]))
    assert grams(stats.cooccurrences(s, s.parse("d"), "f", min_tf=0)) == {"b": 2, "c": 1, "e": 1, "f": 1}
    assert grams(stats.cooccurrences(s, s.parse("d"), "f", 2, 0, 2, 2, min_tf=0)) == {"b _": 1, "c _": 1}
    twice = corpus(spark, ["x a y", "x a y", "x a z"])
    assert grams(stats.cooccurrences(twice, twice.parse("a"), "f", min_tf=0, dedup=True)) == {"x": 2, "y": 1, "z": 1}


def test_rejected_terms(spark):
    c = corpus(spark, ["a b c"] * 100 + ["d a z e b f"])
    got = grams(stats.cooccurrences(c, c.parse("z"), "f", low=1, high=2, kind="wgram", min_tf=0, reject_idf=0.9))
    assert got == {"d": 1, "e": 1, "f": 1, "e b f": 1}


def test_ranking(spark):
    c = corpus(spark, ["aa aa aa aa"] * 3 + ["zz zz"] * 96)
    row = stats.cooccurrences(c, c.parse("aa"), "f", 10, 10, 2, 2, min_tf=0).first()
    assert row.term == "aa aa" and math.isclose(row.tfidf / row.tf, 2 * math.log(100 / 3))
    with pytest.raises(ValueError):
        stats.ngrams(F.col("x"), 0, 1)


def test_vocabulary(spark):
    c = corpus(spark, ["a b a", "b c", "", None])
    assert sorted(tuple(r) for r in stats.vocabulary(c, "f").collect()) == [("a", 1, 2), ("b", 2, 2), ("c", 1, 1)]
    assert [tuple(r) for r in stats.top_terms(c, "f", 2, "tf").collect()] == [("a", 1, 2), ("b", 2, 2)]
    assert [r.term for r in stats.top_terms(c, "f", min_share=0.5).collect()] == ["b"]
    assert [r.term for r in stats.top_terms(c, "f", max_df=1, stops=["a"]).collect()] == ["c"]
    p = spark.createDataFrame([("a b",), ("nosuch a",)], "phrase string")
    got = {r.phrase: (r.sum_idf, r.min_df) for r in stats.phrase_idf(c, p, "f").collect()}
    assert got["a b"] == (pytest.approx(math.log(5) + math.log(5 / 2)), 1) and got["nosuch a"] == (pytest.approx(math.log(5 / 2) + math.log(5)), 1)
    assert [tuple(r) for r in stats.target_counts(c, c.parse("a b"), "f").collect()] == [("b", 2, 2), ("a", 1, 2)]
    assert sorted(tuple(r) for r in stats.term_counts(c, ir.StartsWith("f", "a")).collect()) == [("a", 1, 2)]
    assert search.doc_count(c, c.parse("b")).first().n_docs == 2


def test_contrast(spark):
    c = corpus(spark, ["x a b"] * 4 + ["b c"] * 6)
    assert stats.contrast(c, c.parse("x"), "f", min_docs=5).collect() == []
    got = {r.term: (r.tf, r.df) for r in stats.contrast(c, c.parse("x"), "f", min_docs=4).collect()}
    assert got == {"x": (4, 4), "a": (4, 4), "b": (4, 10)}


def test_shards(spark):
    a = spark.createDataFrame([("x", 3, 2), ("y", 1, 1)], "term string, tf long, df long")
    rows = stats.merged_cooccurrences([a, a], [10, 10]).collect()
    assert [(r.term, r.tf, r.df) for r in rows] == [("x", 6, 4), ("y", 2, 2)] and rows[0].tfidf == pytest.approx(6 * math.log(5))


@pytest.mark.parametrize(
    ("start", "end", "text"),
    [(-10, -1, ""), (1000, 1020, ""), (100, 110, " | "), (-20, 3, "abc"), (3, -20, ""), (3, 2, ""), (0, 50, "abc"), (5, 219, " | def"), (5, 300, " | def"), (5, 600, " | def | ghi"), (216, 10000, "def | ghi | jkl")],
)
def test_substring(spark, start, end, text):
    rows = spark.createDataFrame([(["abc", "def", "ghi", "jkl"],)], "v array<string>")
    assert rows.select(ingest.multivalue_substring(F.col("v"), start, end, 213).alias("x")).first().x == text


SCHEMA = {
    "analyzers": {"en": {"char_filters": [["<[^>]*>", " "]], "tokenizer": "words", "filters": ["lowercase", "fold", {"stop": ["the"]}]}},
    "fields": {"text": {"type": "text", "index_analyzer": "en", "multivalued": "false"}, "site": {"type": "string"}},
    "field_mapper": {"ignore_case": "true", "mappings": [{"f": "BODY", "t": "text"}, {"f": "url", "t": "site", "capture": {"find": "//([^/]+)", "replace": "<$1>", "fail_policy": "skip"}}]},
}


def test_schema(spark):
    schema = IndexSchema.from_json(json.dumps(SCHEMA))
    assert IndexSchema.from_json(schema.to_json()) == schema
    rows = spark.createDataFrame([(1, "  The <b>Café</b>\r\n  sat\n\n\n\nx ", "http://a.b/c"), (2, None, "no")], "doc_id long, body string, url string")
    c = schema.apply(rows)
    got = {r.doc_id: (r.text, r.site) for r in c.docs.collect()}
    assert got == {1: ("The <b>Café</b>\nsat\n\nx", ["<a.b>"]), 2: (None, [])}
    assert sorted((r.pos, r.term) for r in search.tokens(c, "text").collect()) == [(1, "cafe"), (2, "sat"), (3, "x")]
    for bad in ({"fields": {"a": {"type": "int"}}}, {"fields": {"a": {"type": "text"}}}, {"fields": {"a": {"type": "string", "multivalued": "maybe"}}}, {"field_mapper": {"mappings": []}}, {"analyzers": {"a": {}}}):
        with pytest.raises(SchemaError):
            IndexSchema.from_json(json.dumps(bad))


def test_capture_policies(spark):
    rows = spark.createDataFrame([(["k=1", "none"],)], "v array<string>")
    one = lambda policy: rows.select(Mapper("v", "t", r"k=(\d)", "$1!", policy).values(F.col("v")).alias("x")).first().x
    assert one("skip") == ["1!"] and one("store_as_is") == ["1!", "none"]
    with pytest.raises(Exception, match="none"):
        one("exception")


def test_sources(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("one\r\ntwo")
    (tmp_path / "in/deep/b.txt").write_text("three\n")
    assert sorted(r.text for r in ingest.text_directory(spark, str(tmp_path / "in")).collect()) == ["one\ntwo\n", "three\n"]
    assert sorted(r.text for r in ingest.text_lines(spark, str(tmp_path / "in/a.txt")).collect()) == ["one", "two"]
    c = corpus(spark, ["a b a", "b"])
    ingest.write_postings(c, "f", str(tmp_path / "p"), 4)
    assert sorted((r.term, r.doc_id, r.positions) for r in ingest.read_postings(spark, str(tmp_path / "p"), ["a"], 4).collect()) == [("a", 0, [0, 2])]
    stats.dump(stats.top_terms(c, "f"), str(tmp_path / "d"), ["zz"], True, True)
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).collect()] == ["zz", "b\t2\t2", "a\t1\t2"]
    (tmp_path / "w").write_text("# no\n\n the \n")
    assert stats.word_list(spark, str(tmp_path / "w")) == ["the"]
    turns = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 1, "x")], "conv_id long, turn int, text string")
    assert ingest.values_by_key(turns, "conv_id", "turn").collect()[0].text == ["a", "b"]


def test_stream(spark, tmp_path):
    from quillspan.streaming import counts

    spark.createDataFrame([(1, "a b a", "2024-01-01 00:00:10"), (2, "a", "2024-01-01 00:01:10")], "doc_id long, text string, ts string").selectExpr("doc_id", "text", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "s"))
    docs = spark.readStream.schema("doc_id long, text string, ts timestamp").parquet(str(tmp_path / "s"))
    query = counts.windowed_counts(docs, "ts", "1 minute", "0 seconds").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.term, r.tf) for r in spark.table("counted").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_windows_take_texts_apart_once(spark):
    texts = ["", None, "of", " of a, b", "x" * 70 + " of " + "y, " * 300 + "of", "a b " * 200]
    c = search.Corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for q in ('"of the"', "of", "/.+/"):
        rows = kwic.windows(c, c.parse_spans(q), before=0, after=0, order="NONE", overlaps=True)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == plan.count("split(") == 1
        if q != '"of the"':
            want = [(k, n, m.start(), m.end(), m[0], "", "") for k, t in enumerate(texts) for n, m in enumerate(re.finditer(r"\w+", t or "")) if q != "of" or m[0] == "of"]
            assert sorted(tuple(r) for r in rows.select("doc_id", "s", "char_start", "char_end", "target", "pre", "post").collect()) == want
    counted = kwic.term_windows(c, c.parse_spans("of"))._jdf.queryExecution().optimizedPlan().toString()
    assert counted.count("regexp_extract_all(") == 1 and "split(" not in counted


def test_cooccurrences_take_texts_apart_twice(spark):
    """Once for the windows, once for the vocabulary; neither makes a row's tokens structures."""
    texts = ["an oak and an oak", "", None, "Oak OAK of it", "of fir, oak"]
    c = search.Corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = stats.cooccurrences(c, c.parse("oak"), kind="wgram", low=2, high=2, min_tf=1)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2
    assert {(r.term, r.tf) for r in rows.collect()} == {("oak and", 1), ("and an", 2), ("an oak", 2), ("of it", 2), ("oak of", 1), ("of fir", 1)} - {("an oak", 2)} | {("an oak", 2)}
    voc = stats.vocabulary(c)
    assert "struct(term" not in voc._jdf.queryExecution().optimizedPlan().toString()
    assert {r.term: (r.df, r.tf) for r in voc.collect()} == {"an": (1, 2), "oak": (3, 5), "and": (1, 1), "of": (2, 2), "it": (1, 1), "fir": (1, 1)}
