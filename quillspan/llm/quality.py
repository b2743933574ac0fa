"""Quality classifier: random Fourier features approximate a Gaussian kernel
over document statistics; ridge scores come from normal equations summed over
partitions, and isotonic calibration of scores that rows get from the other
folds' equations turns them into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textarr as ta
from .sums import vector_sum

STATISTICS = ("log_chars", "log_words", "word_length", "upper", "digits", "spaces", "punctuation", "rare_symbols", "lines", "repeated_words", "distinct_words", "short_words", "word_length_spread", "top_char")
FEATURES = 256
RIDGE = 1.0
FOLDS = 4
BINS = 10_000  # of calibration, between scores of minus and plus infinity


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray  # (statistics, FEATURES)
    phases: np.ndarray
    weights: np.ndarray  # (FEATURES + 1)
    cuts: np.ndarray  # bins at which a calibrated step begins
    levels: np.ndarray


def _kinds() -> np.ndarray:
    """0 other, 1 upper-case letter, 2 other letter, 3 digit, 4 space, 5 . , ; : ! ? - ' ", 6 line end."""
    c = ta.cache()
    if "kinds" not in c:
        _, value = ta.char_tables()
        kinds = np.zeros(len(value), np.uint8)
        for i in np.flatnonzero(value).tolist():
            ch = chr(i)
            kinds[i] = 3 if not ch.isalpha() else 1 if ch.isupper() else 2
        for ch in " \t 　":
            kinds[ord(ch)] = 4
        for ch in ".,;:!?-'\"":
            kinds[ord(ch)] = 5
        kinds[10] = kinds[13] = 6
        c["kinds"] = kinds
    return c["kinds"]


def statistics(run: ta.Run) -> np.ndarray:
    """(documents, STATISTICS) of a run; zeros for an empty text."""
    kinds = _kinds()[run.chars]
    ends = run.starts + run.sizes
    kinds[ends] = 255  # the separators
    words = run.words()
    n, w = np.maximum(1, run.sizes), np.maximum(1, words.counts)
    share = [np.add.reduceat(kinds == k, run.starts, dtype=np.int64) for k in (1, 2, 3, 4, 5, 0, 6)]
    length = (words.end - words.start).astype(np.float64)

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc, x, run.n)

    mean_length = per_doc(length) / w
    same = np.zeros(len(words.hash))
    if len(same) > 1:
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    order = np.argsort(words.hash ^ ta.mix(words.doc.astype(np.uint64) + np.uint64(1)))
    h, d = words.hash[order], words.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=run.n)
    common = _most_common(run)
    out = np.stack(
        [
            np.log1p(run.sizes), np.log1p(words.counts), mean_length, share[0] / np.maximum(1, share[0] + share[1]), share[2] / n, share[3] / n, share[4] / n, share[5] / n,
            share[6] / n, per_doc(same) / w, distinct / w, per_doc(length <= 2) / w, np.sqrt(np.maximum(0, per_doc(length**2) / w - mean_length**2)), common / n,
        ],
        1,
    )
    out[run.sizes == 0] = 0
    return out


def _most_common(run: ta.Run) -> np.ndarray:
    """Times that the most frequent character of each document occurs in it; separators don't count."""
    inside = np.ones(len(run.chars), bool)
    inside[run.starts + run.sizes] = False
    low = inside & (run.chars < 256)
    doc = np.repeat(np.arange(run.n), run.sizes + 1)
    out = np.bincount(doc[low] * 256 + run.chars[low], minlength=run.n * 256).reshape(run.n, 256).max(1)
    high = np.flatnonzero(inside & (run.chars >= 256))
    if len(high):
        pair, times = np.unique(doc[high] << 21 | run.chars[high].astype(np.int64), return_counts=True)
        np.maximum.at(out, pair >> 21, times)
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, stats): one for each row of docs; a null text counts as empty."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in ta.runs(batch.column(1)):
                s = statistics(run)
                lists = pa.ListArray.from_arrays(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.n), lists], ["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(apply, "doc_id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def fourier(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = ((x - mean) / spread) @ directions + phases
    return np.concatenate((np.sqrt(2.0 / len(phases)) * np.cos(z), np.ones((len(x), 1))), 1)


def bin_of(score: np.ndarray) -> np.ndarray:
    """The bin of each score: narrow ones around a half, ever wider ones outwards, so that none is cut off."""
    return np.minimum(BINS - 1, ((np.arctan(4 * (score - 0.5)) / np.pi + 0.5) * BINS).astype(np.int64))


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit to y (in the order of the scores), by pooling adjacent violators."""
    value, mass, size = [], [], []
    for v, m in zip(y, weight, strict=True):
        value.append(v), mass.append(m), size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            v2, m2, s2 = value.pop(), mass.pop(), size.pop()
            value[-1] = (value[-1] * mass[-1] + v2 * m2) / (mass[-1] + m2)
            mass[-1] += m2
            size[-1] += s2
    return np.repeat(value, size)


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", seed: int = 11) -> Model | None:
    """Fit on every labelled row; None if there is none.

    Labels with a null id or value don't count; an id labelled more than once
    counts as often. Labels of ids without a document are ignored. The steps
    of calibration are fitted on scores by the equations of the other FOLDS.
    """
    d = len(STATISTICS)
    moments = vector_sum(stats.select("stats"), 1 + 2 * d, lambda b: (lambda x: np.concatenate(([len(x)], x.sum(0), (x**2).sum(0))))(_matrix(b.column(0))))
    if moments is None or not moments[0]:
        return None
    mean = moments[1 : 1 + d] / moments[0]
    spread = np.sqrt(np.maximum(moments[1 + d :] / moments[0] - mean**2, 0))
    spread[spread < 1e-9] = 1
    rng = np.random.default_rng(seed)
    directions, phases = rng.standard_normal((d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES)  # a kernel as wide as typical distances
    y_of = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("double").alias("y"))
    fold = F.pmod(F.xxhash64("lid", "stats"), F.lit(FOLDS)).cast("int").alias("fold")
    fit = stats.join(y_of, stats.doc_id == F.col("lid")).select("stats", "y", fold)
    k = FEATURES + 1
    upper = np.triu_indices(k)
    each = len(upper[0]) + k + 1

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y, of = fourier(_matrix(batch.column(0)), mean, spread, directions, phases), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        out = np.zeros((FOLDS, each))
        for f in np.unique(of):
            mine = z[of == f]
            out[f] = np.concatenate(((mine.T @ mine)[upper], mine.T @ y[of == f], [len(mine)]))
        return out.ravel()

    total = vector_sum(fit, FOLDS * each, equations)
    if total is None or not total.reshape(FOLDS, each)[:, -1].sum():
        return None
    total = total.reshape(FOLDS, each)

    def solved(t: np.ndarray) -> np.ndarray:
        full = np.zeros((k, k))
        full[upper] = t[: len(upper[0])]
        return np.linalg.solve(full + np.triu(full, 1).T + RIDGE * np.eye(k), t[len(upper[0]) : -1])

    weights = solved(total.sum(0))
    # Each row is scored by what the other folds say.
    others = np.stack([solved(total.sum(0) - t) for t in total])

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        z, of = fourier(_matrix(batch.column(0)), mean, spread, directions, phases), batch.column(2).to_numpy()
        at = bin_of((z * others[of]).sum(1))
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, batch.column(1).to_numpy(), BINS)))

    bins = vector_sum(fit, 2 * BINS, binned)
    used = np.flatnonzero(bins[:BINS])
    levels = isotonic(bins[BINS:][used] / bins[:BINS][used], bins[:BINS][used])
    first = ta.bounds(levels)[:-1]
    return Model(mean, spread, directions, phases, weights, used[first], levels[first])


def predict(x: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    score = fourier(x, m.mean, m.spread, m.directions, m.phases) @ m.weights
    return score, m.levels[np.maximum(0, np.searchsorted(m.cuts, bin_of(score), side="right") - 1)]


def score(stats: DataFrame, model: Model | None, min_probability: float = 0.5) -> DataFrame:
    """Rows (doc_id, score, probability, keep), one for each row of stats.

    keep: the probability of good quality is min_probability at least. Without
    a model (no labelled rows) score and probability are null and all is kept.
    """
    shared = stats.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m is None:
                s = p = pa.nulls(batch.num_rows, pa.float64())
                keep = pa.array(np.ones(batch.num_rows, bool))
            else:
                s, p = predict(_matrix(batch.column(1)), m)
                s, p, keep = pa.array(s), pa.array(p), pa.array(p >= min_probability)
            yield pa.RecordBatch.from_arrays([batch.column(0), s, p, keep], ["doc_id", "score", "probability", "keep"])

    return stats.select("doc_id", "stats").mapInArrow(apply, "doc_id long, score double, probability double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, min_probability: float = 0.5) -> DataFrame:
    """Statistics, model and scores of docs: rows of score().

    Texts are read once and whole; empty and null ones have statistics of 0.
    Rows that repeat an id have rows each, and count as often for the model as
    they meet labels. Equal scores have equal probabilities. Other columns are
    not read.
    """
    stats = store.written(document_statistics(docs), "statistics")
    return score(stats, train(stats, labels), min_probability)
