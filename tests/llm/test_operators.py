"""Each operator against its definition on small tables, and on odd ones."""

import gzip
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspan.llm import arc_to_warc, decontaminate, exact_dedup, language_id, ngram_join, pii, quality, sentencepiece_bpe, store, suffix_lm, token_store
from quillspan.llm import textarr as ta

EXTRA = ", id long, t string, g long, mark long, n int, tag long, digit binary, rest string, label string, lang2 string"
LONG = "lorem ipsum dolor " * 20_000


def table(spark, rows, extra=True):
    """Documents with columns whose names clash with inner ones."""
    kind = "doc_id long, text string, lang string, source string, n_chars long" + (EXTRA if extra else "")
    pad = (None,) * (EXTRA.count(",") if extra else 0)
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *pad) for i, t in rows], kind).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [(1, ""), (None, "x y z w"), (2, None), (3, "a b c d"), (3, "a b c d"), (4, LONG), (5, LONG + "!"), (6, "a b c d"), (None, None), (7, "..."), (8, "퟿ é 😀 x"), (None, "x y z w")])


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def words(text):
    return [m[0].lower() for m in re.finditer(r"[^\W_]+", text or "")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Exact dedup


def test_exact_groups(spark, odd, none):
    rng = random.Random(1)
    long = "".join(rng.choice("ab") for _ in range(5000))
    rows = [(k, rng.choice(["", None, "a", "ab", long, long + "a", long[:-1] + "c", long[:1024], long[:64], "é" * 40])) for k in range(120)]
    got = rows_of(exact_dedup.exact_groups(table(spark, rows)))
    ids = {t: [k for k, x in rows if x == t] for t in {x for _, x in rows}}
    assert got == sorted(((k, min(ids[t]), len(ids[t])) for k, t in rows), key=repr)
    assert exact_dedup.exact_groups(none).collect() == []
    kept = rows_of(exact_dedup.keep_first(table(spark, rows)).select("doc_id"))
    assert kept == sorted([(k,) for k, t in rows if t is None or k == min(ids[t])], key=repr)
    assert Counter(r[0] for r in rows_of(exact_dedup.keep_first(odd).select("doc_id"))) == Counter([None, None, 1, 2, 3, 4, 5, 7, 8])
    assert Counter(r[1:] for r in rows_of(exact_dedup.exact_groups(odd)))[3, 3] == 3
    assert exact_dedup.keep_first(odd).columns == odd.columns and exact_dedup.keep_first(none).count() == 0
    # Rows that repeat an id have texts of their own, of which the first of each stays; of rows alike in all one does.
    again = [(1, "a"), (1, "b"), (2, "b"), (2, "b"), (3, "c"), (3, "c"), (None, "d"), (None, "d"), (4, None), (4, None), (5, "a"), (None, "c"), (6, "e")]
    assert Counter((r.doc_id, r.text) for r in exact_dedup.keep_first(table(spark, again)).collect()) == Counter([(1, "a"), (1, "b"), (3, "c"), (None, "d"), (4, None), (4, None), (6, "e")])


# N-gram Jaccard join


def grams(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def similar(rows, threshold=0.5):
    out = []
    sets = [(k, grams(t)) for k, t in rows if k is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and len(x & y) / len(x | y) >= threshold - 1e-12:
                out.append((min(a, b), max(a, b), len(x & y), round(len(x & y) / len(x | y), 9)))
    return sorted(out)


def mixed(rng, n):
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    rows = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((k, " ".join(w)))
    return rows


def classes(rows, threshold=0.5):
    """(document, least of its class, links) of documents of one version each."""
    parent, links = {k: k for k, _ in rows}, Counter()

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b, *_ in similar(rows, threshold):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
        links[a] += 1
        links[b] += 1
    return sorted(((k, root(k), links[k]) for k, _ in rows), key=repr)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_jaccard_join(spark, threshold, monkeypatch):
    rows = mixed(random.Random(2), 150)
    assert rows_of(ngram_join.jaccard_join(table(spark, rows), threshold=threshold)) == classes(rows, threshold)
    least = {}
    for k, t in rows:
        least.setdefault(frozenset(grams(t)), k)
    want = [p for p in similar(rows, threshold) if p[0] in least.values() and p[1] in least.values() and p[3] < 1]
    assert sorted((r.doc_a, r.doc_b, r.overlap, round(r.jaccard, 9)) for r in ngram_join.similar_sets(table(spark, rows), threshold=threshold).collect()) == want
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)  # labels in parts
    assert rows_of(ngram_join.jaccard_join(table(spark, rows), threshold=threshold)) == classes(rows, threshold)


def test_jaccard_join_of_odd_rows(spark, odd, none):
    assert rows_of(ngram_join.jaccard_join(odd)) == [(1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 4, 1), (5, 4, 1), (6, 3, 1), (7, 7, 0), (8, 8, 0)]
    assert ngram_join.jaccard_join(none).collect() == []
    # Versions: 1 is like 2 and like 3, which therefore are of one class; the two of 3 are links of each other.
    text = {c: " ".join(f"{c}{k}" for k in range(20)) for c in "abc"}
    rows = [(1, text["a"]), (1, text["b"]), (2, text["a"] + " x"), (3, text["b"] + " y"), (3, text["b"]), (4, text["c"])]
    assert rows_of(ngram_join.jaccard_join(table(spark, rows))) == [(1, 1, 3), (2, 1, 1), (3, 1, 4), (4, 4, 0)]


def test_keep_one(spark, odd, none):
    rows = mixed(random.Random(4), 120)
    got = sorted(r.doc_id for r in ngram_join.keep_one(table(spark, rows)).collect())
    assert got == sorted(k for k, c, _ in classes(rows) if k == c)
    assert Counter(r.doc_id for r in ngram_join.keep_one(odd).collect()) == Counter([None, None, None, 1, 2, 3, 3, 4, 7, 8])
    assert ngram_join.keep_one(none).count() == 0


def test_divide_skip():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(60)]
    ns = np.array([len(s) for s in sets])
    got = {(q, int(p)): int(o) for q, ps, os in ngram_join.divide_skip(sets, ns, 0.5) for p, o in zip(ps, os, strict=True)}
    want = {}
    for i in range(60):
        for j in range(i + 1, 60):
            o = len(np.intersect1d(sets[i], sets[j]))
            if o / (ns[i] + ns[j] - o) >= 0.5:
                want[i, j] = o
    assert got == want


# Language model


def test_suffix_scores(spark, odd, none, monkeypatch):
    monkeypatch.setattr(suffix_lm, "SHARD_WORDS", 40)
    rng = random.Random(6)
    corpus = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(30)]
    texts = [(k, " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 12)))) for k in range(8)]
    got = {(r.item_id, r.pos): r for r in suffix_lm.score(spark.createDataFrame(texts, "item_id long, text string"), table(spark, list(enumerate(corpus)))).collect()}
    docs = [words(t) for t in corpus]

    def count(run):
        return sum(d[i : i + len(run)] == run for d in docs for i in range(len(d) - len(run) + 1))

    total = sum(map(len, docs))
    assert len(got) == sum(len(words(t)) for _, t in texts)
    for k, t in texts:
        w = words(t)
        for p in range(len(w)):
            n = next((n for n in range(p, 0, -1) if count(w[p - n : p])), 0)
            c, f = (count(w[p - n : p]), count(w[p - n : p + 1])) if n else (total, count(w[p : p + 1]))
            r = got[k, p]
            assert (r.context, r.context_count, r.word_count) == (n, c, f)
            assert math.isclose(r.log_prob, math.log((f + 0.5 * (count(w[p : p + 1]) + 1) / (total + 1)) / (c + 0.5)))
    items = spark.createDataFrame([(1, ""), (None, "a"), (2, None), (3, "a b"), (3, "a b")], "item_id long, text string")
    assert len(suffix_lm.score(items, odd).collect()) == 4
    assert {r.context for r in suffix_lm.score(items, none).collect()} == {0}
    assert suffix_lm.score(items.limit(0), odd).collect() == []


def test_suffix_scores_of_the_corpus_itself(spark, odd, monkeypatch):
    from quillspan.llm import queries

    monkeypatch.setattr(suffix_lm, "SHARD_WORDS", 60)
    rng = random.Random(21)
    rows = [(k * 5, " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 40)))) for k in range(40)]
    rows += [(301, rows[0][1]), (302, rows[4][1] + " z"), (320, "q " * 70), (303, "q " * 70), (340, rows[2][1]), (340, "new a b"), (360, "")]
    monkeypatch.setattr(queries, "documents", lambda *_: table(spark, rows))
    scored = queries.op2_suffix_lm(spark, "")
    got = Counter(tuple(r)[:5] for r in scored.collect())
    want = Counter()
    for k, t in rows:
        if k % 20:
            continue
        others = [words(x) for i, x in rows if i != k]

        def count(run, others=others):
            return sum(d[i : i + len(run)] == run for d in others for i in range(len(d) - len(run) + 1))

        w = words(t)
        for p in range(len(w)):
            n = next((n for n in range(p, 0, -1) if count(w[p - n : p])), 0)
            want[k, p, n, count(w[p - n : p]) if n else sum(map(len, others)), count(w[p - n : p + 1])] += 1
    assert scored.columns[0] == "doc_id" and got == want
    assert {r.item_id for r in suffix_lm.score(odd, odd, id_col="doc_id", corpus_id="doc_id").where("pos < 3").collect()} == {3, 4, 5, 6, 8}


def test_suffix_scores_look_only_stretches_up_in_shards(spark, monkeypatch):
    """Runs that are short, as nearly all are, don't go through every shard; their work would grow with the square of the corpus."""
    rng = random.Random(33)
    copied = [f"c{k}" for k in range(30)]
    rows = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(150))) for k in range(60)]
    rows += [(k, " ".join([f"x{k}", *copied, f"y{k}"])) for k in (80, 81)]
    docs = table(spark, rows)
    seen = spark.sparkContext.accumulator(0)
    visit = suffix_lm.Block.visit

    def counted(block, shard):
        seen.add(len(block.at) + len(shard.ids))
        visit(block, shard)

    monkeypatch.setattr(suffix_lm.Block, "visit", counted)
    got = {(r.item_id, r.pos): r for r in suffix_lm.score(docs.where("doc_id % 20 = 0"), docs, id_col="doc_id", corpus_id="doc_id").collect()}
    assert len(got) == 3 * 150 + 32
    # The stretch in the text, and in the file of the corpus that is the text's own and the other one, with their ends.
    assert 0 < seen.value <= 2 * (3 * 30 + 2)
    assert [(got[80, p].context, got[80, p].context_count, got[80, p].word_count) for p in range(2, 31)] == [(p - 1, 1, 1) for p in range(2, 31)]


def test_suffix_array():
    rng = np.random.default_rng(3)
    ids = np.append(rng.integers(0, 4, 300), 0)
    order = suffix_lm.suffix_array(ids, 8)
    assert sorted(order.tolist()) == list(range(301))

    def key(i):
        s = ids[i : i + 8].tolist()
        return s[: s.index(0) + 1] if 0 in s else s

    keys = [key(i) for i in order]
    assert keys == sorted(keys)


# Archives


def test_archives(spark):
    pages = spark.createDataFrame([(k, f"http://a/{k} x", f"<p>{k}</p>" * k) for k in range(600)] + [(None, None, None), (5, "http://a/5 x", "again")], "page_id long, url string, html string")
    rows = arc_to_warc.convert_archives(arc_to_warc.page_archives(pages)).collect()
    assert Counter(r.warc_type for r in rows) == {"warcinfo": 4, "response": 602} and not any(r.truncated for r in rows)
    assert len({r.record_id for r in rows}) == len(rows)
    one = next(r for r in rows if r.target_uri == "http://a/7%20x")
    assert one.warc_date == "2000-01-01T00:07:00Z" and one.ip_address == "192.0.2.8" and one.payload_digest == arc_to_warc.digest(b"<p>7</p>" * 7)
    assert arc_to_warc.convert_archives(arc_to_warc.page_archives(pages.limit(0))).collect() == []
    odd = spark.createDataFrame([("x.arc", None), (None, bytearray(b""))], "archive string, data binary")
    assert arc_to_warc.convert_archives(odd).collect() == []
    # Damaged archives give what is before, and say so; equal records differ by their place.
    plain = arc_to_warc.opening("a", 1) + b"".join(arc_to_warc.arc_record("http://h/1", "1.2.3.4", "20010231000000", bytes(range(256)) * 20, "a", 1) for _ in range(2))
    whole = gzip.compress(plain)
    rows = {}
    for name, data in (("a.arc.gz", whole), ("cut.arc.gz", whole[:-30]), ("bad.arc.gz", whole[:60] + b"????????" + whole[68:]), ("no.arc.gz", b"\x1f\x8b??"), ("two.arc.gz", gzip.compress(plain[:50]) + gzip.compress(plain[50:]))):
        rows[name] = arc_to_warc.convert_archives(spark.createDataFrame([(name, bytearray(data), 1)], "archive string, data binary, record_id long")).collect()
    assert [r.warc_type for r in rows["a.arc.gz"]] == [r.warc_type for r in rows["two.arc.gz"]] == ["warcinfo", "resource", "resource"] and len({r.record_id for r in rows["a.arc.gz"]}) == 3
    assert {r.warc_date for r in rows["a.arc.gz"][1:]} == {"1970-01-01T00:00:00Z"}
    assert all(rows[k][-1].warc_type == "metadata" and rows[k][-1].truncated for k in ("cut.arc.gz", "bad.arc.gz", "no.arc.gz"))


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>é {k}</p>" * (k % 5)) for k in range(300)], "page_id long, url string, html string")
    records = arc_to_warc.convert_archives(arc_to_warc.page_archives(pages))
    path = f"file://{tmp_path}/warc"
    assert sum(r.records for r in arc_to_warc.write_warc(records, path).collect()) == records.count() == 302
    back = {r.record_id: r for r in arc_to_warc.read_warc(spark, path).collect()}
    for r in records.collect():
        b = back[r.record_id]
        assert (b.warc_type, b.target_uri, b.warc_date, b.content_length, arc_to_warc.digest(bytes(b.content))) == (r.warc_type, r.target_uri, r.warc_date, r.content_length, r.block_digest)


@pytest.mark.parametrize("version", [1, 2])
def test_archive_bytes(version):
    bodies = [b"HTTP/1.0 200 OK\r\n\r\nhello", b"", b"\n\nraw\n" * 9, b"filedesc: no"]
    data = arc_to_warc.opening("a.arc", version) + b"".join(arc_to_warc.arc_record(f"http://h/{k}", "1.2.3.4", "19990102030405", b, "a.arc", version) for k, b in enumerate(bodies))
    got = list(arc_to_warc.read_records(data))
    assert [r.content for r in got[1:]] == bodies and [r.url for r in got[1:]] == [f"http://h/{k}" for k in range(4)]
    assert all(data[r.offset :].startswith(r.url.encode()) for r in got)
    cut = list(arc_to_warc.read_records(data[:-5]))
    assert cut[-1].truncated and b"WARC-Truncated" in arc_to_warc.to_warc(cut[-1], "a.arc")
    warc = arc_to_warc.to_warc(got[1], "a.arc")
    head, _, body = warc.partition(b"\r\n\r\n")
    assert b"Content-Length: %d" % len(bodies[0]) in head and body == bodies[0] + b"\r\n\r\n"


# Quality


def good_and_bad(rng, n):
    out = []
    for k in range(n):
        if k % 2:
            out.append((k, " ".join(rng.choice(["the", "river", "walks", "slowly", "over", "Hills", "and", "meadows,"]) for _ in range(rng.randint(20, 80))) + "."))
        else:
            out.append((k, " ".join(rng.choice(["$$$", "CLICK", "1234", "!!", "buy"]) for _ in range(rng.randint(20, 80)))))
    return out


def test_quality(spark, odd, none):
    rows = good_and_bad(random.Random(8), 400)
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows[:300]] + [(None, 1), (3, None), (99999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(table(spark, rows), labels).collect()}
    assert np.mean([got[k].keep == bool(k % 2) for k, _ in rows[300:]]) > 0.97
    pairs = sorted((r.score, r.probability) for r in got.values())
    assert all(a[1] <= b[1] for a, b in zip(pairs, pairs[1:], strict=False))
    assert quality.classify(odd, labels).count() == odd.count() and quality.classify(none, labels).count() == 0
    # The whole query against its definition: ridge by the rows themselves, folds held out.
    stats = {r.doc_id: np.array(r.stats) for r in quality.document_statistics(table(spark, rows)).collect()}
    x, y = np.stack([stats[k] for k, _ in rows]), np.array([k % 2 for k, _ in rows[:300]], float)
    gen = np.random.default_rng(11)
    d, p = gen.standard_normal((x.shape[1], quality.FEATURES)) / np.sqrt(x.shape[1]), gen.uniform(0, 2 * np.pi, quality.FEATURES)
    spread = np.where(x.std(0) < 1e-9, 1, x.std(0))
    z = np.concatenate((np.sqrt(2 / quality.FEATURES) * np.cos((x - x.mean(0)) / spread @ d + p), np.ones((len(x), 1))), 1)
    w = np.linalg.solve(z[:300].T @ z[:300] + np.eye(z.shape[1]), z[:300].T @ y)
    assert np.allclose([got[k].score for k, _ in rows], z @ w, atol=1e-6)
    unlabelled = quality.classify(odd, labels.limit(0)).collect()
    assert all(r.keep and r.score is None for r in unlabelled)


def test_statistics():
    texts = ["", "aaa!! b", "ééé é", "A! A! A!", " " * 9 + "xyz"]
    run = next(iter(ta.runs(pa.array(texts))))
    got = quality.statistics(run)
    top = [max(Counter(t).values()) / len(t) if t else 0 for t in texts]
    assert np.allclose(got[:, quality.STATISTICS.index("top_char")], top)
    assert np.allclose(got[:, quality.STATISTICS.index("punctuation")], [sum(c in ".,;:!?-'\"" for c in t) / max(1, len(t)) for t in texts])
    assert quality.bin_of(np.array([-1e9, 0.5, 1e9])).tolist() == [0, quality.BINS // 2, quality.BINS - 1]


def test_isotonic():
    rng = np.random.default_rng(1)
    y, w = rng.random(60), rng.random(60) + 0.1
    best = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(quality.isotonic(y, w), best)


def test_fourier_features_are_a_kernel():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6, 14)) * 0.3
    d, p = rng.standard_normal((14, 20000)) / np.sqrt(14), rng.uniform(0, 2 * np.pi, 20000)
    z = quality.fourier(x, np.zeros(14), np.ones(14), d, p)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 14))
    assert np.abs(z @ z.T - kernel).max() < 0.05


# Decontamination


def common(a, b):
    """Length of the longest common subsequence, bit-parallel in one integer."""
    masks = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def holds(item, w):
    """By the definition: the greatest share of the item in a stretch of w that passes, or None."""
    answer, size, have = item[-decontaminate.answer_words(len(item)) :], int(decontaminate.reach(np.array(len(item)))), Counter(item)
    best = None
    for a in range(len(w)):
        part = w[a : a + size]
        if w[a] in have and sum((Counter(part) & have).values()) >= decontaminate.MIN_LCS * len(item) - 1e-9:
            share = common(item, part) / len(item)
            if share >= decontaminate.SURE_LCS or (share >= decontaminate.MIN_LCS and common(answer, part) / len(answer) >= decontaminate.MIN_ANSWER):
                best = max(best or 0, share)
    return best


def planted(rng, prose, items, n, rates, near=None):
    """Documents, every second with a changed item in it."""
    rows = []
    for k in range(n):
        w = prose(rng.randint(40, 250))
        if k % 2 == 0:
            passage = list(items[(k // 2) % len(items)][1])
            for at in rng.sample(range(len(passage)), int(len(passage) * rng.choice(rates))):
                passage[at] = rng.choice(near or ["other", "words"])
            at = rng.randrange(len(w))
            w[at:at] = passage
        rows.append((k, w))
    return rows


def test_leaks(spark, odd, none, monkeypatch):
    rng = random.Random(10)
    vocabulary = [f"w{k}" for k in range(600)]
    weights = [1 / (k + 3) for k in range(600)]
    prose = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [(k, prose(rng.randint(15, 150))) for k in range(14)] + [(20, prose(640))]
    rows = planted(rng, prose, items, 200, [0, 0.1, 0.2, 0.3, 0.4])
    rows += [(500, prose(30) + items[-1][1][64:128] + prose(30)), (501, [])]
    want = {(k, i): share for k, w in rows for i, item in items if (share := holds(item, w)) is not None}
    assert len(want) > 70 and (500, 20) not in want
    docs = table(spark, [(k, " ".join(w)) for k, w in rows])
    benchmark = spark.createDataFrame([(i, " ".join(p)) for i, p in items] + [(None, "a b"), (77, None), (78, "")], "item_id long, text string")
    got = decontaminate.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(want)
    assert all(abs(r.lcs - want[r.doc_id, r.item_id]) < 1e-9 for r in got) and np.mean([r.cosine > decontaminate.MIN_COSINE for r in got]) > 0.5 and all(r.cosine > 0 for r in got)
    kept = sorted(r.doc_id for r in decontaminate.without_leaks(docs, benchmark).collect())
    assert kept == sorted({k for k, _ in rows} - {k for k, _ in want})
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 1500)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()} == set(want)
    monkeypatch.undo()
    assert decontaminate.without_leaks(odd, benchmark).count() == odd.count() and decontaminate.leaks(none, benchmark).count() == 0
    assert decontaminate.leaks(odd, benchmark.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "lorem ipsum dolor " * 5)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(odd, long).collect()} == {4, 5}


def test_leaks_of_short_changed_items(spark):
    rng = random.Random(31)
    vocabulary = [f"w{k}" for k in range(1500)]
    weights = [1 / (k + 5) for k in range(1500)]
    prose = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [(k, prose(rng.randint(15, 24))) for k in range(1200)]
    rows = planted(rng, prose, items, 300, [0.2, 0.3, 0.4], vocabulary)
    sure = {(k, k // 2) for k, w in rows if k % 2 == 0 and holds(items[k // 2][1], w) is not None}
    benchmark = spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id long, text string")
    found = decontaminate.leaks(table(spark, [(k, " ".join(w)) for k, w in rows]), benchmark).collect()
    assert len(sure) > 80 and sure <= {(r.doc_id, r.item_id) for r in found}
    assert all(abs(holds(items[r.item_id][1], rows[r.doc_id][1]) - r.lcs) < 1e-9 for r in found)


def test_latent_space_and_lcs():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((400, 30)) @ np.diag(0.6 ** np.arange(30))
    sketch = (rng.integers(0, 2, (decontaminate.SKETCH, 400)) * 2 - 1) / np.sqrt(decontaminate.SKETCH) @ a
    space = decontaminate.latent_space(sketch, rank=5)
    space /= np.linalg.norm(space, axis=0)
    exact = np.linalg.svd(a)[2][:5]
    assert np.linalg.norm(a @ space) > 0.98 * np.linalg.norm(a @ exact.T)
    items = decontaminate.Items.of([1, 2, 3], ["a b c d e f g h", "x " * 64, " ".join(f"k{n}" for n in range(200))])
    text = ta_words("b z d f x x h " + " ".join(f"k{n}" for n in range(20, 190, 2)))
    at = np.minimum(np.searchsorted(items.terms, text), len(items.terms) - 1)
    code = np.where(items.terms[at] == text, at, len(items.terms)).astype(np.int16)
    got, said = items.common(np.array([0, 1, 2]), code, np.array([0, 0, 0]), np.array([7, 7, len(code)]))
    assert got.tolist() == [4, 2, 85] and said.tolist() == [2, 2, 20]


def ta_words(text):
    return next(iter(ta.runs(pa.array([text])))).words().hash


# SentencePiece


def test_encoding(spark, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    rng = random.Random(12)
    rows = [(k, "".join(rng.choice(["the ", "internationalisation ", "é", "ß", "日本", " ", "  ", "\n", "\t", "😀", "x" * 90, "ing", "12345 ", ".,;", "▁", "A", "́"]) for _ in range(rng.randint(0, 40)))) for k in range(150)]
    rows += [(1000, ""), (1001, None), (1002, " a"), (1003, LONG), (1004, "a" * 5000)]
    got = {r.doc_id: r for r in sentencepiece_bpe.encode_decode(table(spark, rows)).collect()}
    for k, t in rows:
        r = got[k]
        if t is None:
            assert r.ids is r.decoded is r.n_ids is None
        else:
            assert r.ids == sp.encode(t), t
            assert r.n_ids == len(r.ids) and r.decoded == t.replace("▁", " ")
    assert sentencepiece_bpe.encode_decode(odd).count() == odd.count() and sentencepiece_bpe.encode_decode(none).count() == 0
    back = sentencepiece_bpe.decode_ids(spark.createDataFrame([(1, sp.encode("a bé")), (2, None), (3, [10**9, None])], "doc_id long, ids array<int>"))
    assert rows_of(back) == [(1, "a bé"), (2, None), (3, "")]


def test_compatible_pairs():
    v = sentencepiece_bpe.vocabulary(sentencepiece_bpe.MODEL)
    rng = np.random.default_rng(9)
    ids = np.array(sorted(v.text))
    one, two = rng.choice(ids, 6000), rng.choice(ids, 6000)
    # Pairs whose border is inside a piece are the hard ones.
    longer = [v.text[i] for i in ids.tolist() if len(v.text[i]) > 3]
    for k in range(2000):
        p = longer[rng.integers(len(longer))]
        cut = rng.integers(1, len(p))
        if p[:cut] in v.piece_id and p[cut:] in v.piece_id:
            one[k], two[k] = (v.piece_id[p[:cut]], two[k]) if k % 2 else (one[k], v.piece_id[p[cut:]])
    want = [v.merge(v.text[a] + v.text[b]) == [v.text[a], v.text[b]] for a, b in zip(one.tolist(), two.tolist(), strict=True)]
    assert v.compatible(one, two).tolist() == want and 0.1 < np.mean(want) < 0.99


# Personal data


def test_belief_propagation_on_a_chain():
    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    model = pii.Model(rng.standard_normal((pii.FEATURES, k)) * 0.3, rng.standard_normal((3, k, k)))
    x = rng.random((4, pii.FEATURES))
    g = pii.Graph(np.zeros(4, np.int64), np.arange(4), np.arange(4) + 1, x, np.array([[0, 1, 0], [1, 2, 1], [2, 3, 2]]))
    node, _ = pii.beliefs(g, model, 60)
    local = x @ model.node
    joint = local[0][:, None, None, None] + local[1][None, :, None, None] + local[2][None, None, :, None] + local[3]
    joint = np.exp(joint + model.edge[0][:, :, None, None] + model.edge[1][None, :, :, None] + model.edge[2][None, None])
    joint /= joint.sum()
    for n in range(4):
        assert np.abs(node[n] - joint.sum(tuple(a for a in range(4) if a != n))).max() < 1e-6


def test_personal_data(spark, odd, none):
    rng = random.Random(13)
    made = {
        "EMAIL": lambda: f"u{rng.randint(1, 999)}@mail{rng.randint(1, 9)}.org", "IP": lambda: ".".join(str(rng.randint(1, 250)) for _ in range(4)), "ID": lambda: f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "PHONE": lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}",
    }
    rows, truth = [], set()
    for k in range(400):
        text = ""
        for _ in range(rng.randint(1, 5)):
            text += " ".join(rng.choice(["water", "in", "1999", "room", "3.5", "2024-05-06", "stone"]) for _ in range(rng.randint(2, 9))) + " "
            if rng.random() < 0.5:
                label = rng.choice(list(made))
                value = made[label]()
                truth.add((k, len(text), len(text) + len(value), label))
                text += value + " "
        rows.append((k, text))
    docs = table(spark, rows)
    model = pii.train(docs)
    got = {(r.doc_id, r.begin, r.end, r.label) for r in pii.find(docs, model).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)
    assert pii.find(none, model).count() == 0 == pii.find(odd, None).count() and pii.train(none) is None
    assert pii.find(odd, model).columns == ["doc_id", "begin", "end", "label", "probability"]
    strange = [(None, "mail a.b@c.org now"), (9, "mail a.b@c.org now"), (9, "mail a.b@c.org now"), (10, LONG + "a.b@c.org"), (11, ""), (12, None), (13, "@ @@ 1 .")]
    got = rows_of(pii.find(table(spark, strange), model).where("label = 'EMAIL'").select("doc_id", "begin", "end"))
    assert got == sorted([(None, 5, 14), (9, 5, 14), (9, 5, 14), (10, len(LONG), len(LONG) + 9)], key=repr)


def test_secrets_of_letters_alone(spark):
    rng = random.Random(23)
    rows, truth = [], set()
    for k in range(400):
        text = ""
        for _ in range(rng.randint(1, 4)):
            text += " ".join(rng.choice(["water", "the key idea", "a secret place", "password rules", "1999", "stone"]) for _ in range(rng.randint(2, 6))) + " "
            kind = rng.random()
            if kind < 0.4:
                text += rng.choice(["password: ", "api_key=", "token = ", "secret=", "my_token=", "password :"])
                value, label = "".join(rng.choice("qwertyuiopasdf") for _ in range(rng.randint(8, 20))), "SECRET"
            elif kind < 0.6:
                value, label = "-".join(str(rng.randint(1000, 9999)) for _ in range(4)), "CARD"
            else:
                continue
            truth.add((k, len(text), len(text) + len(value), label))
            text += value + " "
        rows.append((k, text))
    docs = table(spark, rows)
    got = {(r.doc_id, r.begin, r.end, r.label) for r in pii.find(docs, pii.train(docs.where("doc_id < 200"))).where("doc_id >= 200").collect()}
    truth = {t for t in truth if t[0] >= 200}
    assert {t[3] for t in truth} == {"SECRET", "CARD"}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)


# Token store


def test_token_store(spark, odd, none, tmp_path):
    import pyarrow.parquet as pq
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    rows = [(k, f"text number {k} " * (k % 7)) for k in range(300)] + [(None, "a"), (5, None)]
    path = str(tmp_path / "tokens")
    token_store.write_tokens(token_store.tokenized(table(spark, rows)), path, 1 << 14, 1 << 10)
    got = token_store.read_tokens(spark, path).collect()
    assert sorted(((r.doc_id, r.tokens) for r in got), key=repr) == sorted(((k, None if t is None else sp.encode(t)) for k, t in rows), key=repr)
    assert all(r.n_tokens == (None if r.tokens is None else len(r.tokens)) and r.lang == "en" for r in got)
    assert sorted(r.doc_id for r in token_store.read_tokens(spark, path, ["doc_id"], 10, 20).collect()) == list(range(10, 21))
    assert {r.doc_id for r in token_store.read_tokens(spark, path, ids=[7, 250, None, 10**6]).collect()} == {7, 250}
    scan = token_store.read_tokens(spark, path, ["doc_id"], 10, 20)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(doc_id,10)" in scan and "tokens" not in scan.split("ReadSchema")[1].split("\n")[0]
    file = next((tmp_path / "tokens").glob("*.parquet"))
    meta = pq.ParquetFile(file).metadata.row_group(0)
    names = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    ids = names["doc_id"]
    assert ids.has_offset_index and ids.has_column_index and "DELTA_BINARY_PACKED" in ids.encodings
    tokens = next(c for n, c in names.items() if n.startswith("tokens"))
    assert any("DICTIONARY" in e for e in tokens.encodings)
    assert token_store.stored(odd).count() == odd.count() and token_store.stored(none).count() == 0


# Language identification

LANGUAGES = {"en": "the water of and house with green river stone", "de": "das wasser und haus mit grün fluss stein über", "fr": "l eau de la maison avec rivière pierre verte", "es": "el agua de la casa con río piedra verde años"}


def test_language(spark, odd, none):
    rng = random.Random(14)
    rows = []
    for k in range(600):
        lang = rng.choice(list(LANGUAGES))
        rows.append((k, " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(rng.randint(4, 40))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(docs.where("doc_id < 400"))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert np.mean([got[k].language == lang for k, _, lang in rows[400:]]) > 0.97
    assert np.mean(model.weights[:, :-1] != 0) < 0.2  # sparse
    unsure = {r.doc_id: r.language for r in language_id.identify(odd, model).collect()}
    assert unsure[1] == unsure[2] == unsure[7] == "und"
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and not {1, 2, 7} & {r.doc_id for r in kept.collect()}
    assert language_id.train(none) is None and language_id.identify(none, model).count() == 0
    assert language_id.keep_identified(odd, None).count() == odd.count()


def test_bounded_samples(spark, monkeypatch):
    rows = [(7, LANGUAGES["en"], "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, max_train=50)
    assert language_id.identify(docs.limit(1), model).first().language == "en"
    many = spark.createDataFrame([(k, f"{k} x", "en") for k in range(5000)], "doc_id long, text string, lang string")
    assert store.sample(many, 50, "doc_id", "text").count() == 50 and store.sample(many.limit(3), 50, "doc_id").count() == 3


def test_document_frequencies_and_scores(spark):
    rng = random.Random(15)
    texts = [" ".join(rng.choice(LANGUAGES[k % 2 and "en" or "de"].split()) for _ in range(rng.randint(0, 12))) for k in range(60)]
    docs = spark.createDataFrame([(k, t, k % 2 and "en" or "de") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(40)
    total, df = language_id.document_frequencies(docs)
    grams = []
    for t in texts:
        run = next(iter(ta.runs(pa.array([t]))))
        grams.append([b for g in language_id.buckets(run) for b in g[: len(t)].tolist()])
    want = Counter(b for g in grams for b in set(g))
    assert total == 60 and {k: int(v) for k, v in enumerate(df) if v} == want
    model = language_id.train(docs)
    for r in language_id.identify(docs, model).collect():
        g = grams[r.doc_id]
        if texts[r.doc_id]:
            logits = np.array([sum(w[b] for b in g) / len(g) for w in model.weights]) + model.bias
            p = np.exp(logits / model.temperature - max(logits / model.temperature))
            p /= p.sum()
            assert r.language == model.labels[int(p.argmax())] and abs(r.probability - p.max()) < 1e-5


def test_temperature():
    rng = np.random.default_rng(7)
    logits = rng.standard_normal((4000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(language_id.fit_temperature(logits * 3, y) - 3) < 0.3


def test_staging(spark, odd):
    path = store.shared_dir(spark)
    assert path == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    kept = store.written(odd, "x")
    assert kept.count() == odd.count()
    store.drop(kept)
