"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (proximal, with
elastic-net penalties), its probabilities calibrated by a temperature.

Document frequencies cover all documents. The weights are fitted on a sample
of max_train labelled documents, the classifier's bound.
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

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MAX_TRAIN = 6000
SCALE = 50.0
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (labels, buckets + 1), by idf and SCALE already
    bias: np.ndarray
    temperature: float


def buckets(run: ta.Run) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each character of the run.

    Lower case; what is neither letter nor digit counts as a space, as does what
    lies beyond a document's end. Separators get the bucket BUCKETS, of no weight.
    """
    lower, value = ta.char_tables()
    c = lower[run.chars]
    c[value[run.chars] == 0] = 32
    ends = run.starts + run.sizes
    padded = np.concatenate((c, np.full(2, 32, np.uint32)))
    third = padded[2:].copy()
    third[ends[run.sizes > 0] - 1] = 32
    out = []
    h = np.zeros(len(c), np.uint32)
    for n, (nxt, m) in enumerate(zip((c, padded[1:-1], third), _MULT, strict=True), 1):
        h = (h ^ nxt) * m
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            b = (h >> np.uint32(16)).astype(np.int32)
            b[ends] = BUCKETS
            out.append(b)
    return out


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """(documents, documents with each bucket) over all rows of docs; the result's size is fixed."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        total, seen = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1, bool)
        for run in ta.runs(batch.column(0)):
            grams = buckets(run)
            for s, e in zip(run.starts.tolist(), (run.starts + run.sizes).tolist(), strict=True):
                for g in grams:
                    seen[g[s:e]] = True
                total[:BUCKETS] += seen[:BUCKETS]
                seen[:] = False
            total[BUCKETS] += run.n
        return total

    total = vector_sum(docs.select(F.col(text_col)), BUCKETS + 1, count)
    return (0, np.zeros(BUCKETS, np.int64)) if total is None else (int(total[BUCKETS]), total[:BUCKETS].astype(np.int64))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, idx, n = batch.column(1).to_pylist(), [], []
        for run in ta.runs(batch.column(0)):
            grams = buckets(run)
            for s, e in zip(run.starts.tolist(), (run.starts + run.sizes).tolist(), strict=True):
                u, k = np.unique(np.concatenate([g[s:e] for g in grams]), return_counts=True)
                idx.append(u.astype(np.int32).tobytes())
                n.append(k.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(idx, pa.binary()), pa.array(n, pa.binary())], ["label", "idx", "n"])


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes, BUCKETS) and bias by FTRL-proximal; examples are (indices, values, class)."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))  # the last is the bias
    rng = np.random.default_rng(seed)

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            idx, x, y = examples[k]
            idx, x = np.append(idx, BUCKETS), np.append(x, 1.0)
            zz, nn = z[:, idx], n[:, idx]
            w = weights(zz, nn)
            logit = w @ x
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[:, idx] = zz + g - sigma * w
            n[:, idx] = nn + g * g
    w = weights(z, n)
    return w[:, :BUCKETS], w[:, BUCKETS]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature in 0.05..20 of least held-out cross-entropy, by golden section on its logarithm."""

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_train: int = MAX_TRAIN) -> Model | None:
    """A model of the labels in label_col; None if no row has both a text and a label.

    The sample is of max_train rows at most, the first by a hash of id and text,
    null ids among them; a tenth is held out for the temperature. With one label
    only, it is given to all.
    """
    total, df = document_frequencies(docs, text_col)
    if not total:
        return None
    sample = store.sample(docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()), max_train, id_col, text_col)
    rows = sample.select(F.col(text_col), F.col(label_col).cast("string")).mapInArrow(_counts, "label string, idx binary, n binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, r.idx, r.n))
    labels = sorted({r.label for r in rows})
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    examples = []
    for r in rows:
        idx, n = np.frombuffer(r.idx, np.int32), np.frombuffer(r.n, np.int32)
        examples.append((idx, n / max(1, n.sum()) * idf[idx] * SCALE, labels.index(r.label)))
    held, fit = [x for k, x in enumerate(examples) if k % 10 == 9], [x for k, x in enumerate(examples) if k % 10 != 9]
    w, bias = ftrl(fit, len(labels))
    temperature = 1.0
    if held:
        temperature = fit_temperature(np.array([w[:, i] @ x + bias for i, x, _ in held]), np.array([y for _, _, y in held]))
    table = np.zeros((len(labels), BUCKETS + 1), np.float32)
    table[:, :BUCKETS] = w * idf * SCALE
    return Model(labels, table, bias, temperature)


def score_run(run: ta.Run, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(label index or -1, probability) of each document of the run."""
    grams = buckets(run)
    total = np.maximum(1, run.sizes * len(grams))
    logits = np.empty((run.n, len(model.labels)))
    for k, w in enumerate(model.weights):
        logits[:, k] = sum(np.add.reduceat(w[g], run.starts) for g in grams) / total + model.bias[k]
    s = logits / model.temperature
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    _, value = ta.char_tables()
    letters = np.add.reduceat(value[run.chars] != 0, run.starts, dtype=np.int64)
    best = p.argmax(1)
    return np.where(letters > 0, best, -1), np.where(letters > 0, p[np.arange(run.n), best], 0.0)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", min_probability: float = 0.5) -> DataFrame:
    """Rows (doc_id, language, probability, accepted), one for each row of docs.

    A text without letters or digits, an empty or a null one has the language
    'und' and probability 0, as has every text if there is no model. accepted:
    the probability is min_probability at least. Equal scores go to the label
    first in the alphabet. Other columns are not read; a null id stays null, and
    rows that repeat one have rows each. Texts of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size that doesn't grow with the data

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for run in ta.runs(batch.column(1)):
                if m is None:
                    best, p = np.full(run.n, -1), np.zeros(run.n)
                else:
                    best, p = score_run(run, m)
                names = [*m.labels, "und"] if m else ["und"]
                ids = batch.column(0).slice(run.first, run.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array([names[b] for b in best], pa.string()), pa.array(p), pa.array((best >= 0) & (p >= min_probability))], ["doc_id", "language", "probability", "accepted"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(apply, "doc_id long, language string, probability double, accepted boolean")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", min_probability: float = 0.5) -> DataFrame:
    """docs without the rows that identify() does not accept: null and empty texts and those without letters or digits are among these.

    All are kept if there is no model, as nothing is known of any. Repeated
    rows each stay or go; other columns, of whatever name, are kept as they are.
    """
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in ta.runs(batch.column(at)):
                best, p = score_run(run, shared.value)
                yield batch.slice(run.first, run.n).filter(pa.array((best >= 0) & (p >= min_probability)))

    return docs.mapInArrow(apply, docs.schema)
