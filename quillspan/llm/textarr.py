"""Flat numpy views of text columns: code points, words and rolling hashes.

Texts of an Arrow batch are cut into runs of whole documents and each run is
held as one array, so that work on characters or words is vectorised over all
of its documents. No text is cut: a very long one is a run of its own.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_CHARS = 1_000_000
_TOP = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def cache() -> dict:
    """Survives between tasks of one Python worker, although functions are pickled by value."""
    return sys.__dict__.setdefault("_quillspan_cache", {})


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower, value): lower case of each code point; a random value for letters and digits, else 0."""
    c = cache()
    if "chars" not in c:
        lower = np.arange(_TOP, dtype=np.uint32)
        word = np.zeros(_TOP, bool)
        for i in range(_TOP):
            if 0xD800 <= i < 0xE000:
                continue
            ch = chr(i)
            if ch.isalnum():
                word[i] = True
            low = ch.lower()
            if low != ch and len(low) == 1:
                lower[i] = ord(low)
        value = mix(lower.astype(np.uint64) + np.uint64(0x51_7C_C1))
        value[~word] = 0
        c["chars"] = lower, value
    return c["chars"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    c = cache()
    if "powers" not in c or len(c["powers"][0]) < n:
        size = max(n, RUN_CHARS + 100_000)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(size, _BASE, np.uint64))
            down = np.cumprod(np.full(size, inverse, np.uint64))
        c["powers"] = up, down
    return c["powers"]


class Run:
    """Documents first..first+n of a batch; chars are their code points, each followed by a newline."""

    def __init__(self, texts: list[str], first: int):
        self.first, self.n = first, len(texts)
        joined = "\n".join(texts) + "\n"
        self.chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1]

    def words(self) -> "Words":
        _, value = char_tables()
        return Words(self, value[self.chars])


class Words:
    """Maximal runs of letters and digits, lower case, with 64-bit hashes; doc is each word's document in the run."""

    def __init__(self, run: Run, value: np.ndarray):
        inside = value != 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]  # the last char is a newline: every word ends
        up, down = powers(len(value))
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * up[: len(value)])))
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, run.starts)  # of each document
        self.counts = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(run.n), self.counts)


def release() -> None:
    """Give memory that is free back to the system: Python workers outlive their tasks, and an executor has few of its cores' memory."""
    pa.default_memory_pool().release_unused()
    if "trim" not in cache():
        libc = ctypes.CDLL(None)
        cache()["trim"] = getattr(libc, "malloc_trim", None)
    if cache()["trim"]:
        cache()["trim"](0)


def runs(texts: pa.Array, limit: int = RUN_CHARS) -> Iterator[Run]:
    """Runs of whole documents with up to limit characters, or one longer document; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield Run([t or "" for t in texts.slice(first, i - first).to_pylist()], first)
            first, total = i, 0
        total += int(size) + 1
    if len(sizes) > first:
        yield Run([t or "" for t in texts.slice(first).to_pylist()], first)
    release()


def gram_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each run of n words in a document; a document of 1 to n-1 words has one gram, of all its words."""
    h, count = words.hash, len(words.hash)
    grams = max(0, count - n + 1)
    with np.errstate(over="ignore"):
        value = np.zeros(grams, np.uint64)
        for j in range(n):
            value = value * _BASE + h[j : j + grams]
        value = mix(value)
        whole = words.doc[:grams] == words.doc[n - 1 : n - 1 + grams] if grams else np.zeros(0, bool)
        docs, values = words.doc[:grams][whole], value[whole]
        short = np.flatnonzero((words.counts > 0) & (words.counts < n))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for k, d in enumerate(short):
                v = 0
                for x in h[words.first[d] : words.first[d] + words.counts[d]].tolist():
                    v = (v * int(_BASE) + x) & 0xFFFFFFFFFFFFFFFF
                extra[k] = v
            docs, values = np.concatenate((docs, short)), np.concatenate((values, mix(extra ^ np.uint64(0xA5A5A5A5))))
    return docs, values


def bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in keys, and len(keys)."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of range(s, s + c) for each s, c."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
