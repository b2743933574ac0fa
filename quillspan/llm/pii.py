"""Personal data and secrets by a skip-chain conditional random field.

Nodes are the tokens of a document that could be part of an entity: those with
a digit or an at sign, long ones of capitals and digits, and any that follow a
key word or are glued to one. All others are of
the label O by the model's definition, so that chains break there exactly.
Neighbours share chain potentials; a token also shares potentials with the
first one of the same text, and with the one before it of a similar shape,
however far away. Loopy belief propagation, until messages settle, makes the
labels of a document agree.

The model is fitted on a bounded sample of documents, labelled by strict
patterns; its own features are shapes and contexts, not those patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textarr as ta

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "ID")
MERGED = {"PHONE", "CARD", "ID"}  # successive tokens of these are one entity
CHAIN, REPEAT, SIMILAR = range(3)
ROUNDS = 8  # of messages in training
SETTLED = 1e-3
MAX_TRAIN = 6000
PATTERNS = [
    ("EMAIL", re.compile(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+")),
    ("IP", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("ID", re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")),
    ("PHONE", re.compile(r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}(?!\d)")),
    ("CARD", re.compile(r"(?<![\d\-])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})(?![\d\-])")),
    ("SECRET", re.compile(r"(?i)(?:token|password|passwd|secret|api[_\-]?key|key)\s?[=:]\s?[\"']?([\w\-/+]{8,})")),
    ("SECRET", re.compile(r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])")),
]
_SPACE = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_KEY = re.compile(r"(?i)(?:token|password|passwd|pwd|secret|api[_\-]?key|access[_\-]?key|key)")
_CALL = re.compile(r"(?i)(?:tel|telephone|telefon|phone|mobile|fax|cell|call|teléfono|téléphone)")
_NAMED = re.compile(rf"(?i)(?:^|[_\-])({_KEY.pattern[4:]}|{_CALL.pattern[4:]})$")
_WORD = re.compile(rf"(?i){_KEY.pattern[4:]}|{_CALL.pattern[4:]}")
_GLUED = re.compile(r"([^\W\d_][\w\-]*)\s*[=:][\"']?(.+)", re.S)
_OUTER = " \t\n\"'`.,;:!?*#$%&|<>[]{}"


@dataclass
class Graph:
    """Candidate tokens of the documents of a run: features, and edges (from, to, kind)."""

    doc: np.ndarray
    begin: np.ndarray  # in the document
    end: np.ndarray
    x: np.ndarray
    edges: np.ndarray  # (edges, 3)


@dataclass
class Model:
    node: np.ndarray  # (features, labels)
    edge: np.ndarray  # (3, labels, labels)


def _bucket(n: int, cuts: tuple[int, ...]) -> list[float]:
    k = sum(n >= c for c in cuts)
    return [float(k == i) for i in range(len(cuts) + 1)]


def _shape(core: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", core))


def _features(core: str, glued: str, before: str, further: str, adjacent: tuple[bool, bool]) -> list[float]:
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    parts = core.split(".")
    octets = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts)
    key = glued or before
    signs = _OUTER + "=:"
    name = _NAMED.search(key.strip(signs)) or (not before.strip(signs) and _NAMED.search(further.strip(signs)))
    keyed = bool(name) and bool(_KEY.fullmatch(name[1]))
    at = core.find("@")
    return [
        1.0, float(at > 0), float(at > 0 and "." in core[at:]), float(octets), float(digits == len(core)), float(letters == 0), float(core[:1] == "+"), float(core[:1] == "(" and core[-1:] == ")"),
        float(bool(re.fullmatch(r"\d{3}-\d{4}", core))), float(bool(re.fullmatch(r"\d{3}-\d{2}-\d{4}", core))), float(bool(re.fullmatch(r"\(?\d{3}\)?[.\-]\d{3}[.\-]\d{4}", core))), float("-" in core),
        float(len(core) >= 16 and bool(re.fullmatch(r"[0-9a-fA-F]+", core))), float(len(core) >= 16 and bool(re.fullmatch(r"[0-9A-Z]+", core)) and letters > 0), float(core[:4] == "AKIA"), float(letters > 0 and digits > 0),
        float(keyed), float(keyed and letters > 0), float(bool(_CALL.fullmatch(before.strip(_OUTER)))), float(adjacent[0]), float(adjacent[1]), float(bool(glued)), float(keyed and (bool(glued) or before[-1:] in ("=", ":"))),
        *_bucket(digits, (1, 2, 3, 4, 5, 8, 13, 20)), *_bucket(len(core), (2, 4, 8, 16, 17, 21, 32)), *_bucket(core.count("."), (1, 2, 3, 4)),
    ]


FEATURES = len(_features("1", "", "", "", (False, False)))


def _keyed(run: ta.Run, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens that follow a key word, with nothing or a sign between, or are glued to one."""
    whole = run.chars.tobytes().decode("utf-32-le", "surrogatepass")
    at = np.array([m.start() for m in _WORD.finditer(whole)], np.int64)
    out = []
    for k in np.unique(np.searchsorted(start, at, side="right") - 1).tolist():
        token = whole[start[k] : end[k]]
        if (m := _GLUED.fullmatch(token.lstrip(_OUTER))) and _NAMED.search(m[1]):
            out.append(k)
        elif _NAMED.search(token.strip(_OUTER + "=:")):
            last = np.searchsorted(run.starts, start[k], side="right") - 1
            stop = run.starts[last] + run.sizes[last]
            following = [n for n in (k + 1, k + 2) if n < len(start) and start[n] < stop]
            if following and not whole[start[following[0]] : end[following[0]]].strip(_OUTER + "=:"):
                following = following[1:]
            out += following[:1]
    return np.array(out, np.int64)


def graph(run: ta.Run) -> Graph:
    """Candidates are found on whole arrays of characters; only they are looked at one by one."""
    chars = run.chars
    c = ta.cache()
    if "spaces" not in c:
        space = np.zeros(0x110000, bool)
        space[_SPACE] = True
        c["spaces"] = space
    inside = ~c["spaces"][chars]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    tell = ((chars >= 48) & (chars <= 57)) | (chars == 64)
    caps = tell | ((chars >= 65) & (chars <= 90))
    sums = np.concatenate(([0], np.cumsum(tell)))
    cap_sums = np.concatenate(([0], np.cumsum(caps)))
    picked = np.flatnonzero((sums[end] > sums[start]) | ((end - start >= 16) & (cap_sums[end] - cap_sums[start] >= 16)))
    picked = np.union1d(picked, _keyed(run, start, end)).astype(np.int64)
    doc_of = np.searchsorted(run.starts, start[picked], side="right") - 1
    text = lambda k: chars[start[k] : end[k]].tobytes().decode("utf-32-le", "surrogatepass")
    doc, begin, stop, x, edges = [], [], [], [], []
    place: list[int] = []  # of each node among all tokens
    last: dict[tuple[int, str, str], int] = {}
    chosen = set(picked.tolist())
    for k, d in zip(picked.tolist(), doc_of.tolist(), strict=True):
        whole = text(k)
        first_of_doc = int(run.starts[d])
        before = text(k - 1) if k and start[k - 1] >= first_of_doc else ""
        further = text(k - 2) if k > 1 and start[k - 2] >= first_of_doc else ""
        offset, glued = 0, ""
        core = whole
        if m := _GLUED.fullmatch(whole.lstrip(_OUTER)):
            if name := _NAMED.search(m[1]):
                glued = name[1]
                offset = len(whole) - len(whole.lstrip(_OUTER)) + m.start(2)
                core = m[2]
        signs = _OUTER + "=" * bool(_NAMED.search(before.strip(_OUTER + "=:")))
        left = len(core) - len(core.lstrip(signs))
        core = core.lstrip(signs).rstrip(_OUTER)
        if not core:
            continue
        b = int(start[k]) - first_of_doc + offset + left
        near = (k - 1 in chosen and start[k - 1] >= first_of_doc, k + 1 in chosen and k + 1 < len(start) and start[k + 1] < first_of_doc + run.sizes[d])
        n = len(doc)
        doc.append(d), begin.append(b), stop.append(b + len(core)), place.append(k)
        x.append(_features(core, glued, before, further, near))
        if n and doc[n - 1] == d and place[n - 1] == k - 1:
            edges.append((n - 1, n, CHAIN))
        low, shape = core.lower(), _shape(core)
        same = last.get((d, "text", low))
        if same is not None:
            edges.append((same, n, REPEAT))
        alike = last.get((d, "shape", shape))
        if alike is not None and alike != same:
            edges.append((alike, n, SIMILAR))
        last.setdefault((d, "text", low), n)
        last[d, "shape", shape] = n
    return Graph(np.array(doc, np.int64), np.array(begin, np.int64), np.array(stop, np.int64), np.array(x, np.float64).reshape(-1, FEATURES), np.array(edges, np.int64).reshape(-1, 3))


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))


def beliefs(g: Graph, m: Model, rounds: int | None = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities of nodes, joint ones of edges) by loopy message passing, all messages at once in each round; None: until none changes by SETTLED, or as many rounds as there are nodes."""
    local = g.x @ m.node
    i, j, kind = g.edges.T
    theta = m.edge[kind]
    forward, back = np.zeros((len(i), len(LABELS))), np.zeros((len(i), len(LABELS)))

    def total() -> np.ndarray:
        t = local.copy()
        np.add.at(t, j, forward)
        np.add.at(t, i, back)
        return t

    def sent(t: np.ndarray, a: np.ndarray, b: np.ndarray, e: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Messages over the edges e, between places a and b of t."""
        f = _logsumexp((t[a] - back[e])[:, :, None] + theta[e], 1)
        r = _logsumexp((t[b] - forward[e])[:, None, :] + theta[e], 2)
        return (0.8 * (f - f.max(1, keepdims=True)) + 0.2 * forward[e]), (0.8 * (r - r.max(1, keepdims=True)) + 0.2 * back[e])

    if rounds is not None:
        for _ in range(rounds if len(i) else 0):
            forward, back = sent(total(), i, j, slice(None))
    live = np.arange(len(i) if rounds is None else 0)
    for _ in range(len(local)):
        if not len(live):
            break
        # Documents whose messages have settled are left as they are.
        nodes, at = np.unique(np.concatenate((i[live], j[live])), return_inverse=True)
        a, b = at[: len(live)], at[len(live) :]
        t = local[nodes]
        np.add.at(t, b, forward[live])
        np.add.at(t, a, back[live])
        f, r = sent(t, a, b, live)
        moved = np.maximum(np.abs(f - forward[live]).max(1), np.abs(r - back[live]).max(1)) >= SETTLED
        forward[live], back[live] = f, r
        live = live[np.isin(g.doc[i[live]], g.doc[i[live[moved]]])]
    t = total()
    node = np.exp(t - _logsumexp(t, 1)[:, None]) if len(t) else t
    pair = (t[i] - back)[:, :, None] + (t[j] - forward)[:, None, :] + theta
    pair = np.exp(pair - pair.max((1, 2), keepdims=True)) if len(i) else pair
    return node, pair / pair.sum((1, 2), keepdims=True)


def pattern_labels(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, label) of the patterns' matches; where they overlap, the first pattern's."""
    out: list[tuple[int, int, int]] = []
    for name, pattern in PATTERNS:
        for m in pattern.finditer(text):
            b, e = m.span(1 if name == "SECRET" and m.lastindex else 0)
            if not any(b < y and x < e for x, y, _ in out):
                out.append((b, e, LABELS.index(name)))
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in ta.runs(batch.column(0)):
            g = graph(run)
            y = np.zeros(len(g.doc), np.int64)
            for d in np.unique(g.doc):
                s = int(run.starts[d])
                spans = pattern_labels(run.chars[s : s + int(run.sizes[d])].tobytes().decode("utf-32-le", "surrogatepass"))
                for n in np.flatnonzero(g.doc == d):
                    y[n] = next((k for b, e, k in spans if g.begin[n] < e and b < g.end[n]), 0)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (g.x, g.edges, y)], ["x", "edges", "y"])


def fit(g: Graph, y: np.ndarray, steps: int = 150, rate: float = 0.5, ridge: float = 0.02) -> Model:
    """Gradient ascent (Adagrad) on the likelihood, expectations by loopy message passing; a fixed number of steps, no randomness."""
    k = len(LABELS)
    m = Model(np.zeros((FEATURES, k)), np.zeros((3, k, k)))
    seen_n, seen_e = np.full(m.node.shape, 1e-8), np.full(m.edge.shape, 1e-8)
    truth = np.eye(k)[y]
    i, j, kind = g.edges.T
    for _ in range(steps):
        node, pair = beliefs(g, m)
        dn = g.x.T @ (truth - node) - ridge * m.node
        de = -ridge * m.edge
        np.add.at(de, (kind, y[i], y[j]), 1.0)
        for t in range(3):
            de[t] -= pair[kind == t].sum(0)
        seen_n += dn**2
        seen_e += de**2
        m.node += rate * dn / np.sqrt(seen_n)
        m.edge += rate * de / np.sqrt(seen_e)
    return m


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Model | None:
    """Fitted on max_train documents at most, the first by a hash of id and text; None if these hold no candidate token."""
    parts = store.sample(docs.where(F.col(text_col).isNotNull()), max_train, id_col, text_col).select(F.col(text_col).cast("string")).mapInArrow(_examples, "x binary, edges binary, y binary").collect()
    graphs, labels, at = [], [], 0
    for r in sorted(parts, key=lambda r: (r.x, r.edges)):
        x, e = np.frombuffer(r.x).reshape(-1, FEATURES), np.frombuffer(r.edges, np.int64).reshape(-1, 3)
        graphs.append((x, e + np.array([at, at, 0])))
        labels.append(np.frombuffer(r.y, np.int64))
        at += len(x)
    if not at:
        return None
    none = np.zeros(0, np.int64)
    return fit(Graph(none, none, none, np.concatenate([x for x, _ in graphs]), np.concatenate([e for _, e in graphs])), np.concatenate(labels))


def entities(g: Graph, m: Model) -> list[tuple[int, int, int, str, float]]:
    """(doc, begin, end, label, probability) of a graph's entities; a merged one has its least certain token's probability."""
    if not len(g.doc):
        return []
    node, _ = beliefs(g, m, None)
    label, p = node.argmax(1), node.max(1)
    chained = {int(j) for _, j, kind in g.edges if kind == CHAIN}
    out: list[tuple[int, int, int, str, float]] = []
    previous = -2
    for n in np.flatnonzero(label).tolist():
        name = LABELS[label[n]]
        if out and previous == n - 1 and n in chained and name in MERGED and out[-1][3] == name:
            d, b, _, _, q = out[-1]
            out[-1] = (d, b, int(g.end[n]), name, min(q, float(p[n])))
        else:
            out.append((int(g.doc[n]), int(g.begin[n]), int(g.end[n]), name, float(p[n])))
        previous = n
    return out


def find(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, begin, end, label, probability), one for each entity; offsets count code points, end is past the last.

    Null and empty texts have no entities, nor has anything without a model.
    Null ids stay null; rows that repeat one are told of each. Texts of any
    length are read whole, and tokens of the same text however far apart bear
    on each other. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    names = ["doc_id", "begin", "end", "label", "probability"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in ta.runs(batch.column(1)) if shared.value is not None else ():
                d, b, e, label, p = zip(*found, strict=True) if (found := entities(graph(run), shared.value)) else ((),) * 5
                ids = batch.column(0).slice(run.first, run.n).take(pa.array(d, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(b, pa.int32()), pa.array(e, pa.int32()), pa.array(label, pa.string()), pa.array(p, pa.float64())], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(apply, "doc_id long, begin int, end int, label string, probability double")
