"""Unbounded n-gram scoring: short runs by counts, long ones against sharded suffix arrays.

A word's context is the longest run of words before it that the corpus has at
all, of whatever length; its probability is the smoothed share of the context's
occurrences that the word follows.

Runs of 1, 2, ... SHORT words are counted one length after the other. Files of
the corpus give the hashes of their runs, sorted, and blocks of texts those
that they ask for; each range of hashes is one task, which answers the blocks
and tells the files which of their runs were asked for and found. A run can be
longer by a word only where it and the one that ends a word earlier were found,
so that few are left after two or three words. This work is in proportion to
the corpus.

What is found to be longer than that are stretches of copies and passages that
many texts have. The corpus's stretches make shards with a suffix array each;
those of texts are looked up in all shards, by their first words in one number
and from there by binary search, and counts of the longest are summed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from . import textarr as ta

SHARD_WORDS = 6_000_000
SMOOTHING = 0.5
BLOCK_WORDS = 1_000_000
SHORT = 8  # words of runs that are counted by hash
FILES = 12  # of the corpus, whose stretches make a shard
CHUNK = 1 << 17  # of a block's words that are looked up together
# Kinds of arrays, as they are stored: of a shard, a file of the corpus, a block (of its texts, then of their own rows in the corpus) and its questions.
KINDS = ("<u8", "<i4", "<i4", "<i8", "<i8")
CORPUS = ("<u8", "<i4", "<i8", "<i8")
GATHERED = ("<u8", "<i8", "<i8") * 2
ASKED = ("<i8", "<u8", "<u4", "<i4", "<i4", "<u4")


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ids, sorted by what follows each, to depth ids at least; prefix doubling, each round over unresolved groups only.

    ids are non-negative; 0 ends a document, and where two suffixes agree up to one their order has no meaning.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int32)
    following = np.append(ids[1:], 0)
    key = ids.astype(np.int64) * (int(ids.max()) + 1) + following
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    cut = ta.bounds(key)
    del key
    size = np.diff(cut)
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.repeat(cut[:-1].astype(np.int32), size)
    alone = np.repeat((size == 1), size)
    alone |= (ids[order] == 0) | (following[order] == 0)
    del following
    todo = np.flatnonzero(~alone)
    h = 2
    while h < depth and len(todo):
        sub = order[todo]
        second = rank[np.minimum(sub + h, n)]
        key = rank[sub].astype(np.int64) * (n + 1) + second + 1
        by = np.argsort(key)
        sub, key = sub[by], key[by]
        order[todo] = sub
        cut = ta.bounds(key)
        size = np.diff(cut)
        rank[sub] = np.repeat(todo[cut[:-1]], size)
        todo = todo[np.repeat(size > 1, size)]
        h *= 2
    return order


_STEP = 1 << 17


def _power(n: np.ndarray) -> np.ndarray:
    """Powers of an odd number, from two short tables."""
    c = ta.cache()
    if "suffix powers" not in c:
        base = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            low = np.cumprod(np.append(np.uint64(1), np.full(4095, base, np.uint64)))
            high = np.cumprod(np.append(np.uint64(1), np.full((1 << 19) - 1, pow(base, 4096, 1 << 64), np.uint64)))
        c["suffix powers"] = low, high
    low, high = c["suffix powers"]
    return low[n & 4095] * high[n >> 12]


def _sums(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sums of table[ids] before each place, by powers, so that runs can be compared; in steps, to hold no more than the result."""
    out = np.zeros(len(ids) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(ids), _STEP):
            part = table[ids[a : a + _STEP]] * _power(np.arange(a, min(a + _STEP, len(ids))))
            part[0] += out[a]
            np.cumsum(part, out=out[a + 1 : a + 1 + len(part)])
    return out


class Shard:
    """The suffix array of some documents' words, given by hash, end to end and each read backwards, so that contexts are sorted by their last words."""

    def __init__(self, known: np.ndarray, ids: np.ndarray, order: np.ndarray, keys: np.ndarray, sizes: np.ndarray):
        self.known, self.ids, self.order, self.keys, self.sizes = known, ids, order, keys, sizes
        self.words = int(sizes.sum())
        # The first words of each rank in one number; what follows an end counts for nothing.
        self.bits = max(1, len(known).bit_length())  # 31 at most, so that depth is 2 at least
        self.depth = min(3, 63 // self.bits)
        self.codes = np.empty(len(order), np.int64)
        for a in range(0, len(order), _STEP):
            at = order[a : a + _STEP]
            word = ids[at]
            code = word.astype(np.int64)
            for k in range(1, self.depth):
                word = np.where(word == 0, 0, ids[np.minimum(at + np.int32(k), len(ids) - 1)])
                code = (code << self.bits) | word
            self.codes[a : a + len(at)] = code
        self.raw = np.append(np.zeros(1, np.uint64), known)  # of an end, then of each id
        self.sums = _sums(np.append(np.full(1, 77, np.uint64), ta.mix(known)), ids)

    @classmethod
    def of(cls, hashes: list[np.ndarray], keys: list[int]) -> list[np.ndarray]:
        """The arrays of the shard of documents."""
        sizes = np.array([len(h) for h in hashes], np.int64)
        known, ids = np.unique(np.concatenate([h[::-1] for h in hashes]), return_inverse=True)
        ids = np.insert(ids.astype(np.int32) + np.int32(1), np.cumsum(sizes), 0)  # an end after each document
        order = suffix_array(ids, int(sizes.max()) + 1)
        return [np.asarray(x, t) for x, t in zip((known, ids, order, keys, sizes), KINDS, strict=True)]

    def own(self, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner and rank in one number, sorted, of all words of documents whose key is one of owners (sorted); words of each owner)."""
        at = np.minimum(np.searchsorted(owners, self.keys), max(0, len(owners) - 1))
        docs = np.flatnonzero(owners[at] == self.keys) if len(owners) else np.zeros(0, np.int64)
        words = np.bincount(at[docs], self.sizes[docs], len(owners)).astype(np.int64)
        if not len(docs):
            return np.zeros(0, np.int64), words
        rank = np.empty(len(self.order), np.int32)
        rank[self.order] = np.arange(len(self.order), dtype=np.int32)
        first = np.cumsum(self.sizes + 1) - self.sizes - 1
        place = ta.ragged(first[docs], self.sizes[docs])
        return np.sort(np.repeat(at[docs], self.sizes[docs]) * (len(self.order) + 1) + rank[place]), words


class Block:
    """Texts' words, each text backwards, looked up in one shard after the other; places are in the order of what begins at them."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], leave_out: bool):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.query = np.concatenate([t[::-1] for t in texts])
        self.pos = (np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(self.query))).astype(np.int32)
        self.names, w = np.unique(self.query, return_inverse=True)
        none = len(self.names)  # beyond a text's end
        padded = np.append(w, [none, none]).astype(np.int32)
        second = np.where(self.pos >= 1, padded[1:-1], np.int32(none))
        third = np.where(self.pos >= 2, padded[2:], np.int32(none))
        self.at = np.lexsort((third, second, padded[:-2])).astype(np.int32)
        self.w = [x[self.at] for x in (padded, second, third)]
        self.left = self.pos[self.at] + 1
        self.sums = _sums(ta.mix(self.names), w)
        self.texts, self.sizes = np.array(ids, np.int64), sizes
        self.owners, owner = np.unique(self.texts, return_inverse=True)
        self.owner = np.repeat(owner.astype(np.int32), sizes)[self.at]
        self.leave_out, n = leave_out, len(self.query)
        self.length, self.count, self.one, self.total = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(len(self.owners), np.int64)

    def _owned(self, k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many of the ranks lo..hi are those of the text's own words."""
        out = np.zeros(len(k), np.int64)
        mine = np.flatnonzero(self.here[self.owner[k]])
        base = self.owner[k[mine]].astype(np.int64) * (len(self.s.order) + 1)
        out[mine] = np.searchsorted(self.own, base + hi[mine]) - np.searchsorted(self.own, base + lo[mine])
        return out

    def _told(self, k: np.ndarray, length: np.ndarray, count: np.ndarray) -> None:
        best = self.length[k]
        self.count[k] = np.where(length > best, count, np.where(length == best, self.count[k] + count, self.count[k]))
        self.length[k] = np.maximum(best, length)

    def visit(self, s: Shard) -> None:
        self.s = s
        place = np.minimum(np.searchsorted(s.known, self.names), len(s.known) - 1)
        ids = np.append(np.where(s.known[place] == self.names, place + 1, 0), 0)
        self.own, own_words = s.own(self.owners if self.leave_out else self.owners[:0])
        self.here = own_words > 0 if self.leave_out else np.zeros(len(self.owners), bool)
        self.total += s.words - (own_words if self.leave_out else 0)
        up = 1 << (s.bits * (s.depth - 1))
        lo, hi = np.searchsorted(s.codes, ids * up), np.searchsorted(s.codes, (ids + 1) * up)
        lo[ids == 0] = hi[ids == 0] = 0
        for a in range(0, len(self.at), CHUNK):
            self._visit(np.arange(a, min(a + CHUNK, len(self.at))), ids, lo, hi)

    def _visit(self, k: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Places k; ids and ranks lo..hi are those of words."""
        s = self.s
        a, b = lo[self.w[0][k]], hi[self.w[0][k]]
        there = b > a
        k, a, b = k[there], a[there], b[there]
        n = b - a - self._owned(k, a, b)
        self.one[k] += n
        # What is there as one word, from the longest down.
        todo, ones = k[n > 0], n[n > 0]
        for depth in range(s.depth, 1, -1):
            enough = self.left[todo] >= depth
            t = todo[enough] if depth == s.depth else todo[enough & (self.length[todo] <= depth)]
            code = ids[self.w[0][t]]
            there = np.ones(len(t), bool)
            for x in self.w[1:depth]:
                i = ids[x[t]]
                there &= i > 0
                code = (code << s.bits) | i
            t, shift = t[there], s.bits * (s.depth - depth)
            code = code[there]
            a = np.searchsorted(s.codes, code << shift)
            there = s.codes[np.minimum(a, len(s.codes) - 1)] >> shift == code
            t, a, code = t[there], a[there], code[there]
            b = np.searchsorted(s.codes, (code + 1) << shift)
            n = b - a - self._owned(t, a, b)
            yes = n > 0
            t, a, b, n = t[yes], a[yes], b[yes], n[yes]
            if depth == s.depth:
                self._further(t, a, b, n)
            else:
                self._told(t, np.full(len(t), depth), n)
            keep = ~np.isin(todo, t, assume_unique=True)
            todo, ones = todo[keep], ones[keep]
        short = self.length[todo] <= 1
        self._told(todo[short], np.ones(int(short.sum()), np.int64), ones[short])

    def _below(self, x: np.ndarray, rank: np.ndarray, known: np.ndarray, length: np.ndarray, right: bool) -> np.ndarray:
        """Whether the shard's run of each rank is before (right: before or equal to) the length words from x, of which known agree."""
        s = self.s
        y = s.order[rank].astype(np.int64)
        if len(known) and int((length - known).max()) == 1:  # one word decides
            word, q = s.raw[s.ids[y + known]], self.query[x + known]
            return (word <= q) if right else (word < q)
        most = np.minimum(length, len(s.ids) - y)
        same, up_x, up_y = known.copy(), _power(x), _power(y)
        far = int((most - same).max()) if len(most) else 0
        with np.errstate(over="ignore"):
            for k in reversed(range(max(0, far).bit_length())):
                to = same + (1 << k)
                may = np.flatnonzero(to <= most)
                a, b, n = x[may], y[may], to[may]
                same[may[(self.sums[a + n] - self.sums[a]) * up_y[may] == (s.sums[b + n] - s.sums[b]) * up_x[may]]] += 1 << k
        end = same >= length
        word = s.raw[s.ids[np.minimum(y + same, len(s.ids) - 1)]]
        return np.where(end, right, word < self.query[np.minimum(x + same, len(self.query) - 1)])

    def _narrow(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, known: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the ranks lo..hi, which agree in known words, those that begin with the length words from x."""
        # A single one begins with them or not; of several the first and the last are searched for.
        one = np.flatnonzero(hi - lo == 1)
        y, n = self.s.order[lo[one]].astype(np.int64), length[one]
        far = y + n > len(self.s.ids)
        y[far] = 0
        with np.errstate(over="ignore"):
            same = (self.sums[x[one] + n] - self.sums[x[one]]) * _power(y) == (self.s.sums[np.minimum(y + n, len(self.s.ids))] - self.s.sums[y]) * _power(x[one])
        lo = lo.copy()
        lo[one[~same | far]] += 1
        several = hi - lo > 1
        first = lo
        for right in (False, True):
            a, b = first.copy(), hi.copy()
            while len(o := np.flatnonzero(several & (a < b))):
                mid = (a[o] + b[o]) // 2
                below = self._below(x[o], mid, known[o], length[o], right)
                a[o[below]] = mid[below] + 1
                b[o[~below]] = mid[~below]
            first, last = (first, np.where(several, a, hi)) if right else (a, hi)
        return first, last

    def _further(self, k: np.ndarray, lo: np.ndarray, hi: np.ndarray, count: np.ndarray) -> None:
        """The longest runs of places k, whose first words are in the ranks lo..hi; those shorter than the longest so far don't count."""
        x, best = self.at[k].astype(np.int64), self.length[k].astype(np.int64)
        length = np.full(len(k), self.s.depth)
        fail = self.left[k].astype(np.int64) + 1  # the least length known not to be there
        lo, hi = lo.copy(), hi.copy()
        # First as long as the longest so far; equal runs, as of passages that many texts have, are looked up once.
        o = np.flatnonzero(best > length)
        with np.errstate(over="ignore"):
            run = ta.mix((self.sums[x[o] + best[o]] - self.sums[x[o]]) * _power(len(self.query) - x[o])) + best[o].astype(np.uint64)
        _, one, of = np.unique(run, return_index=True, return_inverse=True)
        a, b = self._narrow(x[o[one]], lo[o[one]], hi[o[one]], length[o[one]], best[o[one]])
        lo[o], hi[o] = a[of], b[of]
        n = hi[o] - lo[o] - self._owned(k[o], lo[o], hi[o])
        length[o], count[o] = np.where(n > 0, best[o], 0), n
        fail[o[n <= 0]] = 0
        step = np.ones(len(k), np.int64)
        live = np.flatnonzero(length + 1 < fail)
        while len(live):
            to = np.minimum(length[live] + step[live], fail[live] - 1)
            a, b = self._narrow(x[live], lo[live], hi[live], length[live], to)
            n = b - a - self._owned(k[live], a, b)
            yes = n > 0
            won, lost = live[yes], live[~yes]
            length[won], count[won], lo[won], hi[won] = to[yes], n[yes], a[yes], b[yes]
            fail[lost] = to[~yes]
            # Steps of one at first, where most end; then twice as far each time until one fails, and halves of what is left.
            step[won] = np.where(length[won] < 4, 1, step[won] * 2)
            half = np.maximum(1, (fail - length) // 2)
            step[lost] = half[lost]
            far = won[length[won] + step[won] >= fail[won]]
            step[far] = half[far]
            live = live[length[live] + 1 < fail[live]]
        ok = length >= best
        self._told(k[ok], length[ok], count[ok])

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, count) of the longest run that ends at each word, with words in the order of the texts."""
        length, count = np.empty(len(self.at), np.int32), np.empty(len(self.at), np.int64)
        to = (np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes) + self.pos)[self.at]
        length[to], count[to] = self.length, self.count
        return length, count


def _save(folder: str, *arrays: np.ndarray) -> str:
    """The name of a new file of folder: how many arrays, their bytes, then these. A try that is lost leaves files that nobody names."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(np.array([len(arrays), *(x.nbytes for x in arrays)], "<i8").tobytes())
        for x in arrays:
            out.write(np.ascontiguousarray(x).view(np.uint8).data)
    return name


def _load(folder: str, name: str, *kinds: str) -> list[np.ndarray]:
    """All arrays of a file."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{base}/{name}") as f:
        sizes = np.frombuffer(f.read(8 * (len(kinds) + 1)), "<i8")[1:].tolist()
        return [np.frombuffer(f.read_buffer(n), t) for n, t in zip(sizes, kinds, strict=True)]


def _parts(folder: str, names: list[str], k: int, *kinds: str) -> Iterator[list[np.ndarray]]:
    """Part k of the arrays of each file, whose first array has the bounds of parts; an array that was left out is empty."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    for name in names:
        with system.open_input_file(f"{base}/{name}") as f:
            n = int(np.frombuffer(f.read_at(8, 0), "<i8")[0])
            sizes = np.frombuffer(f.read_at(8 * n, 8), "<i8").tolist()
            at = 8 * (n + 1)
            a, b = np.frombuffer(f.read_at(16, at + 8 * k), "<i8").tolist()
            at, out = at + sizes[0], []
            for size, t in zip(sizes[1:], kinds):
                wide = np.dtype(t).itemsize
                out.append(np.frombuffer(f.read_at((b - a) * wide, at + a * wide) if size else b"", t))
                at += size
            yield out


def _cut(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of equal ranges of hashes in these, which are sorted."""
    return np.concatenate(([0], np.searchsorted(hashes, np.array([k * 2**64 // parts for k in range(1, parts)], np.uint64)), [len(hashes)])).astype("<i8")


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words that end at each place, from the mixed hashes of words; without meaning at a text's first n - 1."""
    out = np.zeros(len(words), np.uint64)
    by = ta.mix(np.arange(1, n + 1)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(min(n, len(words))):
            out[k:] += words[: len(words) - k] * by[k]
    return ta.mix(out)


def _places(sizes: np.ndarray) -> np.ndarray:
    """Of each word in its text."""
    return (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each is in known, which is sorted."""
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)


def _longer(found: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Where runs of n words can be, given where those of one less were found."""
    out = found & (place >= n - 1)
    out[1:] &= found[:-1]
    return out


def _stretches(ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, size, text) of the longest stretches of words in runs of SHORT words, given where these end."""
    inside = np.zeros(len(ends) + 1, np.int8)
    at = np.flatnonzero(ends)
    np.add.at(inside, at - SHORT + 1, 1)
    np.add.at(inside, at + 1, -1)
    inside = np.cumsum(inside, dtype=np.int32)[:-1] > 0
    text = np.repeat(np.arange(len(sizes)), sizes)
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (text[1:] != text[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return first, np.flatnonzero(last) + 1 - first, text[first]


def _pack(folder: str):  # noqa: ANN202
    """Files of the rows (id, text) of a partition, with the words of each; documents without words are left out."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, keys = [], [], []

        def tell() -> pa.RecordBatch:
            known, ids = np.unique(np.concatenate(held), return_inverse=True)
            name = _save(folder, known, ids.astype("<i4"), np.concatenate(sizes).astype("<i8"), np.concatenate(keys).astype("<i8"))
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64())], ["file", "words"])
            held.clear(), sizes.clear(), keys.clear()
            ta.release()
            return out

        for batch in batches:
            for run in ta.runs(batch.column(1)):
                w = run.words()
                some = w.counts > 0
                held.append(w.hash), sizes.append(w.counts[some])
                keys.append(batch.column(0).slice(run.first, run.n).to_numpy(zero_copy_only=False)[some])
                if sum(map(len, held)) >= SHARD_WORDS:
                    yield tell()
        if sum(map(len, held)):
            yield tell()

    return apply


def _gather(folder: str):  # noqa: ANN202
    """Blocks of the rows (id, whether of the corpus, text) of a partition, which are in order of id; all rows of an id are in one block."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list, list] = [], []  # (id, words) of texts and of the corpus
        size, last = 0, None

        def tell() -> pa.RecordBatch:
            parts: list[np.ndarray] = []
            for side in rows:
                parts += np.concatenate([np.zeros(0, np.uint64), *(h for _, h in side)]), np.array([len(h) for _, h in side], "<i8"), np.array([i for i, _ in side], "<i8")
                side.clear()
            name = _save(folder, *parts)
            ta.release()
            return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

        for batch in batches:
            for run in ta.runs(batch.column(2)):
                w = run.words()
                of = (batch.column(k).slice(run.first, run.n).to_pylist() for k in (0, 1))
                for i, own, h in zip(*of, np.split(w.hash, w.first[1:]), strict=True):
                    if size >= BLOCK_WORDS and i != last:
                        yield tell()
                        size = 0
                    if len(h):
                        rows[own].append((i, h.copy()))
                        size += len(h) * (not own)
                    last = i
        if rows[0]:
            yield tell()

    return apply


def _tasks(spark: SparkSession, n: int, apply: Callable[[int], list[str]]) -> list[list[str]]:
    """apply's names of files for each number below n, which is a task of its own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([apply(k)], pa.list_(pa.string()))], ["k", "files"])
                ta.release()

    rows = spark.range(0, n, 1, n).mapInArrow(each, "k long, files array<string>").collect() if n else []
    return [r.files for r in sorted(rows)]


def _found(folder: str, n: int, name: list[str], answers: list[str], k: int, words: np.ndarray) -> np.ndarray:
    """The ends of a file's runs of n words that texts asked for and that other documents have."""
    out = np.zeros(len(words), bool)
    ends = np.flatnonzero(np.unpackbits(_load(f"{folder}/asked{n}", name[1], "u1")[0], count=len(words)))
    known = np.concatenate([np.zeros(0, np.uint64), *(x for x, in _parts(f"{folder}/answers{n}", [a[1] for a in answers], k, "<u8"))])
    out[ends] = _among(_runs(words, n)[ends], known)
    return out


def _give(folder: str, n: int, file: str, last: list[str], answers: list[str], k: int, parts: int) -> list[str]:
    """Round n of a file of the corpus: its runs that may be in texts, and where they end."""
    known, ids, sizes, _ = _load(f"{folder}/corpus", file, *CORPUS)
    words, place = ta.mix(known)[ids], _places(sizes)
    may = _longer(_found(folder, n - 1, last, answers, k, words), place, n) if n > 1 else np.ones(len(words), bool)
    runs = np.sort(_runs(words, n)[may])
    cut = ta.bounds(runs)
    times = np.diff(cut)
    # A run that is there more than 255 times has several entries.
    more = -(-times // 255)
    runs, few = np.repeat(runs[cut[:-1]], more), np.full(int(more.sum()), 255, np.uint8)
    few[np.cumsum(more) - 1] = times - 255 * (more - 1)
    return [_save(f"{folder}/given{n}", _cut(runs, parts), runs, few), _save(f"{folder}/asked{n}", np.packbits(may))]


def _state(folder: str, n: int, last: list[str], answers: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(words in the longest run of up to n that ends at each word of block k and that other documents have, how often they do), from the answers of round n."""
    ends, of, own = _load(f"{folder}/asked{n}", last[0], *ASKED)[3:]
    length, count = (x.copy() for x in _load(f"{folder}/states{n}", last[1], "u1", "<i8"))
    times = np.concatenate([np.zeros(0, np.int64), *(x for x, in _parts(f"{folder}/answers{n}", [a[0] for a in answers], k, "<i8"))])[of] - own
    there = times > 0
    length[ends[there]], count[ends[there]] = n, times[there]
    return length, count


def _ask(folder: str, n: int, block: str, last: list[str], answers: list[str], k: int, parts: int) -> list[str]:
    """Round n of a block: the runs that it asks for, and what it knows so far."""
    words, sizes, ids, own_words, own_sizes, own_ids = _load(f"{folder}/blocks", block, *GATHERED)
    if n > 1:
        length, count = _state(folder, n - 1, last, answers, k)
    else:
        length, count = np.zeros(len(words), np.uint8), np.zeros(len(words), np.int64)
    once = last[2] if n > 2 else _save(f"{folder}/once", count)  # how often other documents have each word
    ends = np.flatnonzero(_longer(length == n - 1, _places(sizes), n))
    mine = _runs(ta.mix(words), n)[ends]
    runs, of = np.unique(mine, return_inverse=True)
    # How often the text's own rows in the corpus have it.
    whose = np.sort((_runs(ta.mix(own_words), n) + ta.mix(np.repeat(own_ids, own_sizes)))[_places(own_sizes) >= n - 1])
    mine += ta.mix(np.repeat(ids, sizes)[ends])
    own = np.searchsorted(whose, mine, "right") - np.searchsorted(whose, mine)
    least = np.full(len(runs), 2**32 - 1, np.uint32)
    np.minimum.at(least, of, own.astype(np.uint32))
    asked = _save(f"{folder}/asked{n}", _cut(runs, parts), runs, least, ends.astype("<i4"), of.astype("<i4"), own.astype("<u4"))
    return [asked, _save(f"{folder}/states{n}", length, count), once]


def _answer(folder: str, n: int, given: list[str], asked: list[str], k: int) -> list[str]:
    """Range k of the hashes of round n: how often the corpus has what each block asks for, and which of its own each file goes on with."""
    held, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for x, t in _parts(f"{folder}/given{n}", given, k, "<u8", "u1"):
        held.append(x), times.append(t)
    runs = np.concatenate(held)
    order = np.argsort(runs)
    before = np.append(0, np.cumsum(np.concatenate(times)[order], dtype=np.int64))
    runs = runs[order]
    del order
    wanted, sizes, counts = [np.zeros(0, np.uint64)], [0], [np.zeros(0, np.int64)]
    for x, least in _parts(f"{folder}/asked{n}", asked, k, "<u8", "<u4"):
        count = before[np.searchsorted(runs, x, "right")] - before[np.searchsorted(runs, x)]
        counts.append(count), sizes.append(len(x)), wanted.append(x[count > least])
    to_blocks = _save(f"{folder}/answers{n}", np.cumsum(sizes).astype("<i8"), np.concatenate(counts))
    del runs, before, counts
    there, sizes = np.unique(np.concatenate(wanted)), [0]
    for i, x in enumerate(held):
        held[i] = x[_among(x, there)]
    return [to_blocks, _save(f"{folder}/answers{n}", np.append(0, np.cumsum([len(x) for x in held[1:]])).astype("<i8"), np.concatenate(held))]


def _shards(folder: str, files: list[str], last: list[list[str]], answers: list[list[str]], at: range) -> list[str]:
    """Shards of the stretches of files at, in which texts have runs of SHORT words or more."""
    held, keys, size, out = [], [], 0, []
    for k in at:
        known, ids, sizes, of = _load(f"{folder}/corpus", files[k], *CORPUS)
        found = _found(folder, SHORT, last[k], answers, k, ta.mix(known)[ids])
        for a, n, d in zip(*(x.tolist() for x in _stretches(found, sizes)), strict=True):
            held.append(known[ids[a : a + n]]), keys.append(int(of[d]))
            size += n
            if size >= SHARD_WORDS:
                out.append(_save(f"{folder}/shards", *Shard.of(held, keys)))
                held, keys, size = [], [], 0
                ta.release()
    if size:
        out.append(_save(f"{folder}/shards", *Shard.of(held, keys)))
    return out


def _long(folder: str, shards: list[str], texts: list[tuple], leave_out: bool) -> None:
    """Fill in the runs of more than SHORT words of texts, which are (words, sizes, ids, length, count)."""
    ids, held, to, size = [], [], [], 0

    def tell() -> None:
        block, at = Block(ids, held, leave_out), 0
        for shard in shards:
            block.visit(Shard(*_load(f"{folder}/shards", shard, *KINDS)))
            block.s = None
        found = block.found()
        for (length, count, a), words in zip(to, held, strict=True):
            n, times = (x[at : at + len(words)] for x in found)
            far = n > SHORT
            length[a : a + len(words)][far], count[a : a + len(words)][far] = n[far], times[far]
            at += len(words)

    for words, sizes, of, length, count in texts:
        for a, n, d in zip(*(x.tolist() for x in _stretches(length == SHORT, sizes)), strict=True):
            ids.append(int(of[d])), held.append(words[a : a + n]), to.append((length, count, a))
            size += n
            if size >= 1.25 * BLOCK_WORDS:
                tell()
                ids, held, to, size = [], [], [], 0
    if held:
        tell()


def _scored(words: int, gathered: list[np.ndarray], length: np.ndarray, count: np.ndarray, one: np.ndarray, smoothing: float) -> pa.RecordBatch:
    """A row for each word of a block's texts; words are the corpus's."""
    _, sizes, ids, _, own_sizes, own_ids = gathered
    owners, of = np.unique(np.concatenate((ids, own_ids)), return_inverse=True)
    own = np.bincount(of[len(ids) :], own_sizes, len(owners)).astype(np.int64)
    total = np.repeat(words - own[of[: len(ids)]], sizes)
    place = _places(sizes)
    # The run that ends at a word is its context and itself, or the context would be shorter.
    context = np.where(place > 0, np.append(0, length)[:-1], 0).astype(np.int32)
    times = np.where(context > 0, np.append(0, count)[:-1], total)
    followed = np.where(length == context + 1, count, 0)
    log = np.log((followed + smoothing * (one + 1) / (total + 1)) / (times + smoothing))
    names = ["item_id", "pos", "context", "context_count", "word_count", "log_prob"]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(ids, sizes), place, context, times, followed, log)], names)


def score(texts: DataFrame, corpus: DataFrame, id_col: str = "item_id", text_col: str = "text", corpus_text: str = "text", smoothing: float = SMOOTHING, corpus_id: str | None = None) -> DataFrame:
    """Rows (item_id, pos, context, context_count, word_count, log_prob), one for each word of each text.

    pos counts words from 0; context is the number of words in the longest
    context that the corpus has, context_count how often it has it and
    word_count how often with the word after it. With an empty context these are
    the corpus's words and the word's count in it. log_prob is the natural
    logarithm of (word_count + s p) / (context_count + s), where p is
    (count of the word + 1) / (words + 1) and s the smoothing.

    With corpus_id, texts may be of the corpus: rows of it whose corpus_id is a
    text's id are left out of the corpus for that text, which otherwise would
    be found in whole.

    Null ids and texts and texts without words have no rows; texts that repeat
    an id have rows each. Null and empty corpus texts count for nothing; with an
    empty corpus every context is empty. Very long texts are looked up whole;
    other columns are not read. Words, and runs of up to SHORT words, are told
    apart by 64 bits of a hash. Tables between steps are files of the shared
    folder; a task holds one file of the corpus of SHARD_WORDS words or one
    longer document, one range of hashes, or one shard and some blocks of
    BLOCK_WORDS words of texts, or one longer text, at a time; the driver learns
    the size of the texts and the names of files.
    """
    rows = texts.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("i"), F.lit(False).alias("own"), F.col(text_col).cast("string").alias("t"))
    corpus = corpus.where(F.length(corpus_text) > 0).select((F.col(corpus_id) if corpus_id else F.lit(None)).cast("long").alias("i"), F.lit(True).alias("own"), F.col(corpus_text).cast("string").alias("t"))
    spark, leave_out = texts.sparkSession, corpus_id is not None
    folder, cores = store.new_path(spark, "suffixes"), spark.sparkContext.defaultParallelism
    packed = corpus.select(F.coalesce("i", F.lit(0)), "t").mapInArrow(_pack(f"{folder}/corpus"), "file string, words long").collect()  # some bytes for each SHARD_WORDS words
    files, words = [r.file for r in packed], sum(r.words for r in packed)
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if leave_out:
        rows = rows.unionAll(corpus.join(store.small(rows.select("i").distinct()), "i", "left_semi"))
    rows = rows.repartition(int(chars // (6 * BLOCK_WORDS)) + 1, "i").sortWithinPartitions("i")  # a word and its space are some 6 characters
    blocks = [r.file for r in rows.mapInArrow(_gather(f"{folder}/blocks"), "file string").collect()]
    parts = min(2 * len(files), words // max(1, SHARD_WORDS // 2)) + 1  # ranges of hashes, of half a file each
    given, asked, answers = [[]] * len(files), [[]] * len(blocks), []

    for n in range(1, SHORT + 1):

        def step(k: int, n=n, given=given, asked=asked, answers=answers) -> list[str]:  # noqa: ANN001
            if k < len(files):
                return _give(folder, n, files[k], given[k], answers, k, parts)
            k -= len(files)
            return _ask(folder, n, blocks[k], asked[k], answers, k, parts)

        names = _tasks(spark, len(files) + len(blocks), step)
        for what in ("asked", "answers", "states"):
            store._delete(spark, f"{folder}/{what}{n - 1}")
        given, asked = names[: len(files)], names[len(files) :]

        def answer(k: int, n=n, given=[x[0] for x in given], asked=[x[0] for x in asked]) -> list[str]:  # noqa: ANN001, B006
            return _answer(folder, n, given, asked, k)

        answers = _tasks(spark, parts, answer)
        store._delete(spark, f"{folder}/given{n}")

    each = min(FILES, -(-len(files) // cores)) or 1
    shards = sum(_tasks(spark, -(-len(files) // each), lambda k: _shards(folder, files, given, answers, range(each * k, min(each * (k + 1), len(files))))), [])
    store._delete(spark, f"{folder}/corpus")
    some = max(1, min(4, len(blocks) // cores))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                held = []
                for k in range(first, min(first + some, len(blocks))):
                    length, count = _state(folder, SHORT, asked[k], answers, k)
                    held.append((_load(f"{folder}/blocks", blocks[k], *GATHERED), length.astype(np.int32), count, _load(f"{folder}/once", asked[k][2], "<i8")[0]))
                _long(folder, shards, [(*of[:3], length, count) for of, length, count, _ in held], leave_out)
                while held:
                    out = _scored(words, *held.pop(), smoothing)
                    for a in range(0, out.num_rows, 50_000):
                        yield out.slice(a, 50_000)
                ta.release()

    starts = spark.range(0, len(blocks), some, max(1, -(-len(blocks) // some)))
    return starts.mapInArrow(apply, "item_id long, pos int, context int, context_count long, word_count long, log_prob double")
