"""The pipeline's stages, each on what the one before kept, against plain versions."""

import re

import pytest

import corpus_pipeline
from quillspan.llm import decontaminate, language_id, store

SF = "/root/testdata/sf0.001"


def words(text):
    return [m[0].lower() for m in re.finditer(r"[^\W_]+", text or "")]


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def stages(spark):
    docs = [store.documents(spark, SF)]
    for name, f in corpus_pipeline.STAGES:
        docs.append(store.written(f(spark, docs[-1], SF), "test"))
    return docs


def test_stages(spark, stages):
    start, identified, distinct, dissimilar, clean, encoded = ({r.doc_id: r for r in d.collect()} for d in stages)
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    told = {r.doc_id for r in language_id.identify(stages[0], language_id.train(stages[0])).where("accepted").collect()}
    assert set(identified) == told and len(told) >= 0.9 * len([r for r in start.values() if words(r.text)])
    first = {}
    for k in sorted(identified):
        first.setdefault(identified[k].text, k)
    assert set(distinct) == set(first.values())
    ids = sorted(distinct)
    sets = {k: grams(distinct[k].text) for k in ids}
    group = {k: k for k in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= 0.5 * len(x | y) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert set(dissimilar) == {k for k in ids if group[k] == k}
    leaks = {r.doc_id for r in decontaminate.leaks(stages[3], store.documents(spark, SF, "benchmark")).collect()}
    assert set(clean) == set(dissimilar) - leaks
    for item in store.documents(spark, SF, "benchmark").collect():
        whole = " ".join(words(item.text))
        assert not any(whole in " ".join(words(r.text)) for r in clean.values())
    assert set(encoded) == set(clean) and all(encoded[k].decoded == clean[k].text.replace("▁", " ") for k in clean)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1].count()


def test_stages_on_odd_and_empty_tables(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, id long, tag long, label string"
    words_of = {"en": "the water of and house with green river stone", "de": "das wasser und haus mit grün fluss stein über"}
    rows = [(k, f"{words_of[lang]} {lang}{k} {words_of[lang]}", lang, "s", 1, None, None, None) for k, lang in enumerate(["en", "de"] * 20)]
    rows += [(None, None, "en", "s", 0, 1, 1, "x"), (100, "", "en", "s", 0, 1, 1, "x"), (101, None, None, None, None, None, None, None), (0, rows[0][1], "en", "s", 1, None, None, None), (None, rows[1][1], "de", "s", 1, None, None, None), (102, "the water of " * 9000, "en", "s", 1, None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    kept = []
    for name, f in corpus_pipeline.STAGES:
        out = store.written(f(spark, docs, SF), "odd")
        kept.append(sorted((r.doc_id for r in out.collect()), key=repr))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
        else:
            assert out.columns == ["doc_id", "ids", "n_ids", "decoded"]
        empty = spark.createDataFrame([], kind)
        assert f(spark, empty, SF).count() == 0
    assert kept[0] == sorted([0, None, 102, *range(40)], key=repr)  # a repeated row, and one without an id
    assert kept[1] == sorted([102, *range(40)], key=repr)
    assert kept[2] == kept[3] == kept[4] == sorted([0, 1, 102], key=repr)
