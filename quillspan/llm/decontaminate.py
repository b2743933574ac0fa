"""Benchmark decontamination by latent semantic retrieval.

Passages of documents are TF-IDF vectors over all their words, each word by a
feature of its hash; a randomised SVD (of a few random sums of passages, which
are themselves summed over partitions) gives a latent space. Windows of
documents that are close to a benchmark item in it are candidates. So are stretches that have enough of an
item's rarest words: none that would pass is without them, so that no item is
lost among the words around it. The longest common subsequence of the words of a
stretch and an item, and the share of the item's answer (its last quarter) in
it, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textarr as ta
from .sums import vector_sum

FEATURE_BITS = 13
RANK = 64
SKETCH = 128  # random sums of passages
SUMS = 4  # of which each passage is in so many
PASSAGE = 64  # words of a passage of the SVD
BLOCK = 8  # words between windows
MIN_COSINE = 0.75
MIN_LCS = 0.6
SURE_LCS = 0.8
MIN_ANSWER = 0.6
ANSWER_SHARE = 0.25
PROBES = 4  # of an item's rarest words that a stretch must have
SLICE_CHARS = 256_000


def answer_words(n: int) -> int:
    return min(n, max(3, round(n * ANSWER_SHARE)))


def reach(length: np.ndarray) -> np.ndarray:
    """Words of a stretch in which an item of so many words is looked for."""
    return length + np.maximum(8, length // 2)


def features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


class Items:
    """The items' words and, for each item and term in it, the places of the term as bits."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        self.ids, self.words = np.array(ids, np.int64), words
        self.terms = np.unique(np.concatenate(words))
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.answers = np.array([answer_words(n) for n in self.lengths.tolist()], np.int64)
        self.reach = reach(self.lengths)
        self.wide = (self.lengths + 63) // 64
        wide = int(self.wide.max())
        keys, bits, answer = [], [], []
        for k, w in enumerate(words):
            t = np.searchsorted(self.terms, w)
            u, at = np.unique(t, return_inverse=True)
            place = np.arange(len(w))
            one = np.zeros((len(u), wide), np.uint64)
            np.bitwise_or.at(one, (at, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
            last = np.zeros((len(u), wide), np.uint64)
            said = place >= len(w) - self.answers[k]
            np.bitwise_or.at(last, (at[said], place[said] >> 6), np.uint64(1) << (place[said] & 63).astype(np.uint64))
            keys.append(k * len(self.terms) + u)
            bits.append(one), answer.append(last)
        self.keys, self.bits, self.last = (np.concatenate(x) for x in (keys, bits, answer))

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Items | None:
        """Items without words are left out; None if none is left."""
        out, words = [], []
        for run in ta.runs(pa.array(texts, pa.string())):
            w = run.words()
            for d in range(run.n):
                if w.counts[d]:
                    out.append(ids[run.first + d])
                    words.append(w.hash[w.first[d] : w.first[d] + w.counts[d]])
        return cls(out, words) if words else None

    def codes(self) -> str:
        """The Arrow type of codes: terms, then features of other words."""
        return "<i2" if len(self.terms) + (1 << FEATURE_BITS) < 1 << 15 else "<i4"

    def features(self) -> np.ndarray:
        """The feature of each code."""
        return np.concatenate((features(self.terms), np.arange(1 << FEATURE_BITS)))

    def common(self, item: np.ndarray, code: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest common subsequences of each item, and of its answer, with the words begin..begin+size of code: bit-parallel, all pairs at once."""
        out = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        for wide in np.unique(self.wide[item]).tolist():
            o = np.flatnonzero(self.wide[item] == wide)
            for to, x in zip(out, self._common(item[o], code, begin[o], size[o], wide), strict=True):
                to[o] = x
        return out

    def _common(self, item: np.ndarray, code: np.ndarray, begin: np.ndarray, size: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        states = np.full((wide, len(item)), ones), np.full((wide, len(item)), ones)
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(int(size.max()) if len(size) else 0), side="left")
        with np.errstate(over="ignore"):
            for step, n in enumerate(live.tolist()):
                o = order[:n]
                t = code[begin[o] + step].astype(np.int64)
                known = t < len(self.terms)
                o = o[known]
                key = item[o] * len(self.terms) + t[known]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                o, at = o[hit], at[hit]
                for state, masks in zip(states, (self.bits, self.last), strict=True):
                    carry = np.zeros(len(o), bool)
                    for w in range(wide):
                        x = state[w, o]
                        u = x & masks[at, w]
                        total = x + u + carry
                        state[w, o] = total | (x - u)
                        carry = (total < x) | (carry & (total == x))
        left = np.clip(self.lengths[item][None, :] - 64 * np.arange(wide)[:, None], 0, 64).astype(np.uint64)
        mask = np.where(left >= 64, ones, (np.uint64(1) << np.minimum(left, np.uint64(63))) - np.uint64(1))
        return tuple(np.bitwise_count(~v & mask).astype(np.int64).sum(0) for v in states)

    def passes(self, item: np.ndarray, common: np.ndarray, said: np.ndarray) -> np.ndarray:
        share = common / self.lengths[item]
        return (share >= SURE_LCS) | ((share >= MIN_LCS) & (said / self.answers[item] >= MIN_ANSWER))


class Codes:
    """Documents as codes of words end to end; first and counts by document."""

    def __init__(self, lists: list[np.ndarray], start: int):
        self.start, self.n = start, len(lists)
        self.counts = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.code = np.concatenate(lists) if lists else np.zeros(0, np.int16)

    def units(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each unit, units of each document): a unit is so many words of one document, the last of a document shorter."""
        each = -(-self.counts // words)
        inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(self.first, each) + inside * words, each


def runs_of_codes(column: pa.Array, dtype: str, limit: int = 400_000) -> Iterator[Codes]:
    """Codes of whole documents, limit words together or one longer document."""
    held, size, start = [], 0, 0
    for k, x in enumerate(column):
        t = np.frombuffer(x.as_buffer(), dtype)
        if held and size + len(t) > limit:
            yield Codes(held, start)
            held, size, start = [], 0, k
        held.append(t)
        size += len(t)
    if held:
        yield Codes(held, start)


def code_lists(rows: DataFrame, terms: np.ndarray, dtype: str) -> DataFrame:
    """Rows (doc_id, codes) of rows (doc_id, text): texts are read once, what follows reads numbers."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Most words are told by 20 bits of their hash; equal hashes decide.
        slot = np.full(1 << 20, -1, np.int32)
        slot[(terms >> np.uint64(44)).astype(np.int64)[::-1]] = np.arange(len(terms), dtype=np.int32)[::-1]
        shared = np.zeros(1 << 20, bool)
        top, many = np.unique((terms >> np.uint64(44)).astype(np.int64), return_counts=True)
        shared[top[many > 1]] = True
        for batch in batches:
            for run in ta.runs(batch.column(1)):
                w = run.words()
                h = (w.hash >> np.uint64(44)).astype(np.int64)
                t = slot[h]
                again = np.flatnonzero(shared[h])
                t[again] = np.minimum(np.searchsorted(terms, w.hash[again]), len(terms) - 1)
                codes = np.where((t >= 0) & (terms[t] == w.hash), t, len(terms) + (h >> (20 - FEATURE_BITS))).astype(dtype)
                ends = np.append(0, np.cumsum(w.counts)) * codes.itemsize
                data = pa.Array.from_buffers(pa.binary(), run.n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.n), data], ["doc_id", "codes"])

    return rows.mapInArrow(apply, "doc_id long, codes binary")


def frequencies(lists: DataFrame, n_codes: int, dtype: str) -> tuple[int, np.ndarray]:
    """(passages, occurrences of each code) over all documents."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(n_codes + 1)
        for run in runs_of_codes(batch.column(0), dtype):
            total[:-1] += np.bincount(run.code, minlength=n_codes)
            total[-1] += (-(-run.counts // PASSAGE)).sum()
        return total

    total = vector_sum(lists.select("codes"), n_codes + 1, count)
    return (0, np.zeros(n_codes)) if total is None else (int(total[-1]), total[:-1])


def weights(passages: int, occurrences: np.ndarray) -> np.ndarray:
    """Of features, from their occurrences; one as frequent as passages weighs nothing."""
    return np.log((1.0 + passages) / (1.0 + np.minimum(occurrences, passages)))


def sketched(lists: DataFrame, feature: np.ndarray, idf: np.ndarray, dtype: str, rows: int = SKETCH, seed: int = 5) -> np.ndarray:
    """S A for the passage matrix A, whose rows are of length 1 (as if no word came twice), and a random S of SUMS signs in each column; what each partition holds is as large as the result."""
    shared = lists.sparkSession.sparkContext.broadcast((feature.astype(np.int32), idf.astype(np.float32)))
    seen = [0]

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        from pyspark import TaskContext

        feature_of, w = shared.value
        out = np.zeros(rows * len(w))
        for run in runs_of_codes(batch.column(0), dtype):
            if not len(run.code):
                continue
            seen[0] += 1  # in this task; the same whenever it is run again
            rng = np.random.default_rng([seed, TaskContext.get().partitionId(), seen[0]])
            f = feature_of[run.code]
            cut, _ = run.units(PASSAGE)
            x, size = w[f], np.diff(np.append(cut, len(f)))
            norm = np.sqrt(np.maximum(np.add.reduceat(x * x, cut), np.float32(1e-9)) * SUMS)
            to, sign = rng.integers(0, rows, (SUMS, len(cut)), np.int32), (rng.integers(0, 2, (SUMS, len(cut))) * 2 - 1) / norm
            out += np.bincount((np.repeat(to * len(w), size, axis=1) + f).ravel(), (np.repeat(sign, size, axis=1) * x).ravel(), len(out))
        return out

    total = vector_sum(lists.select("codes"), rows * len(idf), sums, "f4")
    return (np.zeros(rows * len(idf)) if total is None else total).reshape(rows, len(idf))


def latent_space(sketch: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the matrix that was sketched, each by its singular value."""
    _, values, vectors = np.linalg.svd(sketch, full_matrices=False)
    k = min(rank, int((values > values.max() * 1e-6).sum()))
    return vectors[:k].T / values[:k] if k else np.zeros((sketch.shape[1], 1))


class Search:
    """Finds the stretches of documents that pass, from two kinds of candidates."""

    def __init__(self, items: Items, feature: np.ndarray, idf: np.ndarray, occurrences: np.ndarray, space: np.ndarray, min_cosine: float):
        self.items, self.min_cosine = items, min_cosine
        self.table = (space * idf[:, None]).astype(np.float32)[feature]  # by code, and for no word
        self.table = np.concatenate((self.table, np.zeros((1, space.shape[1]), np.float32)))
        own = np.stack([self.table[np.searchsorted(items.terms, w)].sum(0) for w in items.words])
        self.own = own / np.maximum(np.linalg.norm(own, axis=1), 1e-9)[:, None]
        # A window of so many blocks holds the item wherever it begins.
        self.sizes = -(-items.lengths // BLOCK) + 1
        # Of an item's words a stretch that passes has must at least, so that of any (words - must) + need it has need.
        must = np.ceil(MIN_LCS * items.lengths - 1e-9).astype(np.int64)
        self.need = np.minimum(PROBES, must)
        who, term = [], []
        for k, w in enumerate(items.words):
            t = np.searchsorted(items.terms, w)
            t = np.unique(t[np.argsort(occurrences[t], kind="stable")][: items.lengths[k] - must[k] + self.need[k]])
            who.append(np.full(len(t), k))
            term.append(t)
        who, term = np.concatenate(who), np.concatenate(term)
        self.probe_item = who[np.argsort(term, kind="stable")]
        self.probe_count = np.bincount(term, minlength=len(self.table))
        self.probe_first = np.cumsum(self.probe_count) - self.probe_count

    def windows(self, run: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, first and last word at which a stretch may begin) of windows that are close to an item in the space."""
        cut, each = run.units(BLOCK)
        first = np.cumsum(each) - each
        doc_of = np.repeat(np.arange(run.n), each)
        last = (first + each)[doc_of]
        # Blocks of equal size, the last of a document filled with words of no weight.
        slot = np.repeat(np.arange(len(cut)) * BLOCK - cut, np.diff(np.append(cut, len(run.code)))) + np.arange(len(run.code))
        code = np.full(len(cut) * BLOCK, len(self.table) - 1, np.int32)
        code[slot] = run.code
        blocks = np.empty((len(cut), self.table.shape[1]), np.float32)
        for a in range(0, len(cut), 512):  # as much as a cache holds
            self.table[code[a * BLOCK : (a + 512) * BLOCK]].reshape(-1, BLOCK, blocks.shape[1]).sum(1, out=blocks[a : a + 512])
        total = np.concatenate((np.zeros((1, blocks.shape[1]), np.float64), np.cumsum(blocks, axis=0, dtype=np.float64)))
        at, item, end_of = [], [], []
        for size in np.unique(self.sizes).tolist():
            which = np.flatnonzero(self.sizes == size)
            end = np.minimum(np.arange(len(cut)) + size, last)
            z = (total[end] - total[:-1]).astype(np.float32)
            bound = self.min_cosine * np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-9)
            for a in range(0, len(which), 512):
                r, k = np.nonzero(z @ self.own[which[a : a + 512]].T.astype(np.float32) >= bound[:, None])
                at.append(r), item.append(which[a + k]), end_of.append(end[r])
        at, item, end = (np.concatenate(x) for x in (at, item, end_of))
        d = doc_of[at]
        begin, stop = cut[at], np.minimum(run.first[d] + run.counts[d], run.first[d] + (end - first[d]) * BLOCK)
        back = stop - self.items.reach[item]
        low, high = np.minimum(begin, back) - BLOCK, np.maximum(begin, back) + BLOCK
        return d, item, np.maximum(run.first[d], low), np.minimum(np.maximum(high, run.first[d]), run.first[d] + run.counts[d] - 1)

    def probed(self, run: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of stretches that have enough of an item's rarest words."""
        n = self.probe_count[run.code]
        x = np.flatnonzero(n)
        n = n[x]
        k = self.probe_item[ta.ragged(self.probe_first[run.code[x]], n)]
        x = np.repeat(x, n)
        order = np.argsort(k, kind="stable")
        k, x = k[order], x[order]
        doc = np.repeat(np.arange(run.n), run.counts)
        # The need-th hit from each on: of the same item and document, and within reach.
        ahead = np.arange(len(k)) + self.need[k] - 1
        at = np.flatnonzero(ahead < len(k))
        then = ahead[at]
        at = at[(k[then] == k[at]) & (x[then] - x[at] < self.items.reach[k[at]]) & (doc[x[then]] == doc[x[at]])]
        d, k, x = doc[x[at]], k[at], x[at]
        return d, k, np.maximum(run.first[d], x - self.items.reach[k] + 1), x

    def found(self, run: Codes) -> tuple[np.ndarray, ...]:
        """(document, item, cosine, share, answer) of stretches that pass."""
        if not len(run.code):
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.float64, np.float64))
        d, k, low, high = (np.concatenate(x) for x in zip(self.windows(run), self.probed(run), strict=True))
        # Candidates of one item that overlap are one, if not far longer than each.
        order = np.lexsort((low, k))
        d, k, low, high = d[order], k[order], low[order], high[order]
        same = np.zeros(len(k), bool)
        same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1]) & (low[1:] <= high[:-1] + 1) & ((low[1:] - low[0]) // 256 == (low[:-1] - low[0]) // 256 if len(k) else True)
        start = np.flatnonzero(~same)
        if len(start):
            high = np.maximum.reduceat(high, start)
        d, k, low = d[start], k[start], low[start]
        out = [self._confirmed(run, *(x[a : a + 20_000] for x in (d, k, low, high))) for a in range(0, max(1, len(k)), 20_000)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _confirmed(self, run: Codes, d: np.ndarray, k: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        # First all the words that stretches beginning at low..high have, then each stretch of those that pass.
        items, stop = self.items, run.first[d] + run.counts[d]
        common, said = items.common(k, run.code, low, np.minimum(stop, high + items.reach[k]) - low)
        may = np.flatnonzero(items.passes(k, common, said))
        n = (high - low + 1)[may]
        begin, d, k, stop = ta.ragged(low[may], n), np.repeat(d[may], n), np.repeat(k[may], n), np.repeat(stop[may], n)
        # Only one that begins with a word of the item need be tried: others have no more of it.
        code = run.code[begin].astype(np.int64)
        key = k * len(items.terms) + code
        there = (code < len(items.terms)) & (items.keys[np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)] == key)
        begin, d, k, stop = begin[there], d[there], k[there], stop[there]
        size = np.minimum(stop, begin + items.reach[k]) - begin
        common, said = items.common(k, run.code, begin, size)
        ok = np.flatnonzero(items.passes(k, common, said))
        begin, d, k, size, common, said = (x[ok] for x in (begin, d, k, size, common, said))
        z = np.zeros((len(k), self.table.shape[1]), np.float32)
        if len(k):
            flat = self.table[run.code[ta.ragged(begin, size)]]
            z = np.add.reduceat(flat, np.cumsum(size) - size, axis=0)
        cosine = np.einsum("ij,ij->i", z, self.own[k]) / np.maximum(np.linalg.norm(z, axis=1), 1e-9)
        return d, items.ids[k], cosine.astype(np.float64), common / items.lengths[k], said / items.answers[k]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_cosine: float = MIN_COSINE, rank: int = RANK) -> DataFrame:
    """Rows (doc_id, item_id, cosine, lcs, answer): documents that hold a benchmark item, exact or paraphrased.

    A document holds an item of n words if in some stretch of n + max(8, n / 2)
    of its words, that begins with one of the item, lcs >= SURE_LCS, or lcs >=
    MIN_LCS and answer >= MIN_ANSWER: the shares of the item's and of its
    answer's words that are a common subsequence with the stretch. A pair is
    told once, with its greatest lcs and the cosine of that stretch, however
    often it occurs.

    Null ids and texts, texts and items without words are in no pair; rows that
    repeat an id are one document, items that repeat one are one item. Texts and
    items may be of any length. Other columns are not read.

    Frequencies and the space are of all documents' words, whatever the
    benchmark. It is held in slices of SLICE_CHARS characters or one longer
    item, so that no task holds more; each is one more pass over the texts.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull() & (F.length(item_text) > 0)).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    rows = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slices = int(-(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // SLICE_CHARS))
    out = spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double, answer double")
    shape, space, idf = out.schema, None, None
    for s in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == s)
        got = sorted((r.i, r.t) for r in part.collect())
        known = Items.of([i for i, _ in got], [t for _, t in got])
        if known is None:
            continue
        dtype, feature = known.codes(), known.features()
        lists = store.written(code_lists(rows, known.terms, dtype), "codes")
        passages, occurrences = frequencies(lists, len(feature), dtype)
        if not passages:
            continue
        if space is None:
            idf = weights(passages, np.bincount(feature, occurrences, 1 << FEATURE_BITS))
            space = latent_space(sketched(lists, feature, idf, dtype), rank)
        shared = spark.sparkContext.broadcast(Search(known, feature, idf, occurrences, space, min_cosine))  # of a slice, and of fixed size

        def apply(batches: Iterator[pa.RecordBatch], shared=shared, dtype=dtype) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for run in runs_of_codes(batch.column(1), dtype):
                    d, *columns = shared.value.found(run)
                    ids = batch.column(0).slice(run.start, run.n).take(pa.array(d))
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], ["doc_id", "item_id", "cosine", "lcs", "answer"])

        found = lists.mapInArrow(apply, shape)
        if slices > 1:  # one slice's lists at a time
            found = store.written(found, "leaks")
            store.drop(lists)
        out = out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "answer", "cosine")).alias("m")).select("doc_id", "item_id", "m.cosine", "m.lcs", "m.answer")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs but for those that leaks() tells of; rows with a null id stay, as do null texts and texts without words."""
    return store.without(docs, leaks(docs, benchmark, id_col, text_col).select("doc_id"), id_col)
