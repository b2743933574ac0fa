"""Rows that repeat a key, extension points, request parameters, chained mappers, the command line."""

import pytest
from pyspark.sql import functions as F

from quillspan.__main__ import main
from quillspan.functions.analysis import Analyzer
from quillspan.operators import kwic, search, stats
from quillspan.operators.search import Corpus
from quillspan.plans import ir, requests
from quillspan.plans.parser import FieldType, Options, Parser
from quillspan.sources import ingest
from quillspan.sources.schema import IndexSchema


@pytest.fixture(scope="module")
def twice(spark):
    rows = [(1, "fir elm oak fir"), (1, "ash ash fir yew"), (1, "oak yew yew yew"), (2, "elm oak"), (None, "fir")]
    return Corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_rows_that_share_a_key(twice):
    found = {(w.doc_id, w.pre, w.target, w.post, w.char_start) for w in kwic.windows(twice, twice.parse("fir"), before=1, after=1).collect()}
    assert found == {(1, "", "fir", " elm", 0), (1, "oak", "fir", "", 12), (1, "ash", "fir", " yew", 8)}
    near = kwic.windows(twice, twice.parse("[oak fir]~>3"), before=0, after=0).collect()
    assert [(w.doc_id, w.target, w.char_start, w.char_end) for w in near] == [(1, "oak fir", 8, 15)]
    assert sorted(tuple(r) for r in search.spans(twice, twice.parse_spans("[elm yew]~>9")).collect()) == []
    assert {r.term: (r.df, r.tf) for r in stats.vocabulary(twice).collect()} == {"fir": (2, 3), "elm": (2, 2), "oak": (3, 3), "ash": (1, 2), "yew": (2, 4)}
    assert search.doc_count(twice, twice.parse("oak")).first().n_docs == 3
    assert [(r.target, r.df, r.tf) for r in stats.target_counts(twice, twice.parse("(fir yew)")).collect()] == [("yew", 2, 4), ("fir", 2, 3)]
    rows = search.matching(twice, twice.parse('+"oak fir" +elm'))
    assert [r.text for r in rows.collect()] == ["fir elm oak fir"]


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), lambda x: x.cast("long") % 7).alias("s")).select("s", kwic._running("s").alias("r"))
        one = rows.first()
        assert one.r == [sum(one.s[: k + 1]) for k in range(n)]


def test_extension_points(twice):
    built = kwic.windows(twice, twice.parse("yew"), before=1, after=1, order=lambda before, target, after: F.concat_ws("/", F.get(before, 0), F.get(target, 0)))
    assert {w.sort_key for w in built.collect()} == {"fir/yew", "oak/yew", "yew/yew"}
    w = kwic.windows(twice, twice.parse("yew"), before=1, after=0)
    one = kwic.deduplicated(w, same=lambda x: [x("target")]).collect()
    assert [(r.target, r["count"]) for r in one] == [("yew", 4)]
    both = kwic.merged([kwic.deduplicated(w), kwic.deduplicated(w)], dedup=True, limit=2).collect()
    assert [(r.pre, r["count"], r.hit_max) for r in both] == [("fir", 2, True), ("oak", 2, True)]
    assert kwic.visited(kwic.term_windows(twice, twice.parse("yew"), before=0, after=1), F.count_distinct("doc_id").alias("docs")).first()[:] == (4, 1)
    grams = stats.cooccurrences(twice, twice.parse("fir"), before=2, after=2, min_tf=1, kind=lambda a: F.transform(F.filter(a, lambda t: t != "oak"), F.upper))
    assert {(r.term, r.tf) for r in grams.collect()} == {("ELM", 2), ("ASH", 2), ("YEW", 1)}
    assert {r.term for r in search.spans(twice, search.expanded(twice, twice.parse_spans("/.*/"), 2)).join(search.tokens(twice, "text"), "doc_id").select("term").collect()} <= {"fir", "elm", "oak", "ash", "yew"}
    assert search.expanded(twice, ir.StartsWith("text", "o"), 3) == ir.TermIs("text", "oak")
    assert search.expanded(twice, ir.StartsWith("text", "x"), 3) == ir.NOTHING

    class Strange(ir.Query):
        pass

    with pytest.raises(ir.UnknownQuery):
        ir.as_spans(ir.Bool((ir.Clause("must", Strange()),)), "text")
    assert ir.as_spans(Strange(), "text", lambda q, f: ir.TermIs(f, "x")) == ir.TermIs("text", "x")

    class Backwards(Parser):
        def new_prefix(self, name, text):
            return ir.Glob(name, "*" + text)

    assert Backwards(options=Options()).parse("oa*") == ir.Glob("text", "*oa")


def test_bigrams(spark):
    rows = spark.createDataFrame([(["a", "b", None, "c", "d"],)], "t array<string>")
    assert [tuple(x) for x in rows.select(search.bigrams("t").alias("b")).first().b] == [(0, "a"), (0, "a_b"), (1, "b"), (3, "c"), (3, "c_d"), (4, "d")]
    assert [tuple(x) for x in rows.select(search.bigrams("t", False, " ").alias("b")).first().b] == [(0, "a b"), (3, "c d")]


def test_request_parameters():
    given = {"tokensBefore": "3", "kwic.tokensAfter": "0", "maxWindows": "-1", "sortOrder": "target_pre", "targetOverlaps": "TRUE", "fl": "lang, source", "minNGram": "x", "maxNGram": "2", "minTF": "-4", "numResults": "7"}
    assert requests.kwic_options(given, "kwic.") == {"before": 3, "after": 0, "limit": None, "order": "TARGET_PRE", "overlaps": True, "metadata": ["lang", "source"]}
    assert requests.cooccur_options(given) == {"before": 3, "limit": None, "high": 2, "n": 7}
    assert requests.kwic_options({"sortOrder": "up", "tokensAfter": "-1"}) == {"limit": requests.MAX_WINDOWS}
    assert requests.filters({"fq": "a"}) == ["a"] and requests.filters({}) == []


def test_chained_captures(spark):
    text = """{"analyzers": {"a": {"tokenizer": "words", "filters": ["lowercase"]}}, "fields": {"text": {"type": "text", "index_analyzer": "a"}},
      "field_mapper": {"ignore_case": "true", "mappings": [{"f": "Body", "t": "text", "capture": [{"find": "<b>(.*)</b>", "replace": "$1"}, {"find": "(\\\\w+)$", "replace": "last $1"}]}]}}"""
    schema = IndexSchema.from_json(text)
    rows = spark.createDataFrame([(1, "x <b>one two</b>"), (2, "none")], "doc_id long, body string")
    assert [r.text for r in schema.apply(rows).docs.orderBy("doc_id").collect()] == [["last two"], []]
    assert IndexSchema.from_json(schema.to_json()).to_json() == schema.to_json()


def test_postings_and_command_line(spark, tmp_path):
    table = str(tmp_path / "t")
    spark.createDataFrame([(1, "the fir the elm"), (2, "fir"), (3, "")], "doc_id long, text string").write.parquet(table)
    main(["index", table, str(tmp_path / "postings")])
    assert sorted(tuple(r) for r in ingest.read_postings(spark, str(tmp_path / "postings"), ["fir", "the"]).select("term", "doc_id", "positions").collect()) == [("fir", 1, [1]), ("fir", 2, [0]), ("the", 1, [0, 2])]
    main(["dump", table, str(tmp_path / "dump"), "--english-stops", "--df", "-n", "5"])
    assert [r.value for r in spark.read.text(str(tmp_path / "dump")).collect()] == ["fir\t2", "elm\t1"]


def test_synonyms_in_vocabulary(spark):
    c = Corpus(spark.createDataFrame([(1, "fir elm"), (2, "elm")], "doc_id long, text string"), fields={"text": FieldType(analyzer=Analyzer(synonyms={"elm": ("tree",)}))})
    assert {r.term: r.df for r in stats.vocabulary(c).collect()} == {"fir": 1, "elm": 2, "tree": 2}
