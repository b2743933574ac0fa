"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard
similarity of at least a threshold, found by T-occurrence search.

1. Grams go to shards by hash, packed by document. A shard has whole inverted
   lists; those with one document set die there. What is left goes home.
2. A set with fewer living lists than the overlap any partner must have is
   done. The others order their lists, shortest first, and post a prefix: two
   sets with the required overlap share a list of it. By these a set gets a
   label, the least set that it may be similar to, and goes to the blocks of
   the pairs of labels that meet in a list.
3. In a block each set is a query: its short lists are merged, sets with T - L
   occurrences are probed in the L long ones by binary search (DivideSkip), and
   those that reach T stay.

Documents with equal sets are one set throughout. Blocks tell how many links
each set has and a forest that spans them, so that what leaves a block is as
many rows as it has sets. Nothing is capped: hot lists only come late in the
order. Grams are told apart by 48 bits of a hash and their shard, sets by a sum
of 64 bits; what is behind equal hashes isn't compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textarr as ta

N = 3
THRESHOLD = 0.5
SHARD_BYTES = 20 << 20
BLOCK_SETS = 4000
_EPS = 1e-9


def required(n: np.ndarray | int, threshold: float) -> np.ndarray:
    """The overlap that a set of n grams has with any partner, at least."""
    return np.maximum(1, np.ceil(threshold * np.asarray(n) - _EPS)).astype(np.int64)


def required_of(nx: np.ndarray, ny: np.ndarray, threshold: float) -> np.ndarray:
    return np.maximum(1, np.ceil(threshold / (1 + threshold) * (nx + ny) - _EPS)).astype(np.int64)


def _sets(run: ta.Run, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash), sorted, without repeats."""
    doc, h = ta.gram_hashes(run.words(), n)
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _pack(values: np.ndarray) -> bytes:
    """The low 48 bits of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view("<u8").ravel()


def _join(column: pa.Array, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype)


def _pack_counts(n: np.ndarray) -> bytes:
    """Counts in as few bytes each as the greatest needs."""
    return n.astype(np.min_scalar_type(int(n.max()))).tobytes()


def _counts(column: pa.Array, tags: pa.Array) -> np.ndarray:
    out = [np.frombuffer(c, f"<u{8 * len(c) // len(t)}") for c, t in zip(column.to_pylist(), tags.to_pylist(), strict=True)]
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


_SHARD = "shard int, home int, docs binary, tags binary, ns binary, counts binary, grams binary, dfs binary"
_SHARD_NAMES = [x.split()[0] for x in _SHARD.split(", ")]
_SHARD_TYPES = [pa.int32(), pa.int32()] + [pa.binary()] * 6


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SHARD_TYPES, strict=True)], _SHARD_NAMES)


def _to_shards(shards: int, n: int):  # noqa: ANN202
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for run in ta.runs(batch.column(1)):
                doc, h = _sets(run, n)
                if not len(h):
                    continue
                size = np.bincount(doc, minlength=run.n)
                some = np.flatnonzero(size)
                with np.errstate(over="ignore"):
                    tag = np.zeros(run.n, np.uint64)
                    tag[some] = ta.mix(np.add.reduceat(ta.mix(h), (np.cumsum(size) - size)[some]) + size[some].astype(np.uint64))
                shard = ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                key = shard * run.n + doc
                order = np.argsort(key, kind="stable")
                h, key = h[order], key[order]
                cut = ta.bounds(key)
                group, count = key[cut[:-1]], np.diff(cut)
                of = group // run.n
                ends = np.searchsorted(of, np.arange(shards + 1))
                docs = group % run.n
                rows = []
                for s in range(shards):
                    a, b = ends[s], ends[s + 1]
                    if a < b:
                        d = docs[a:b]
                        rows.append((s, -1, None, tag[d].tobytes(), None, _pack_counts(count[a:b]), _pack(h[cut[a] : cut[b]]), None))
                # Who has which set: through one shard, on to the sets' homes.
                rows.append((int(tag[some[0]] % np.uint64(shards)), -2, ids[run.first + some].astype(np.int64).tobytes(), tag[some].tobytes(), size[some].astype(np.int32).tobytes(), None, None, None))
                yield _batch(rows)

    return apply


def _living(shards: int):  # noqa: ANN202
    """In a shard: lists of two sets and more, sent to their sets' homes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        owners = t.filter(pa.compute.equal(t.column("home"), -2))
        if owners.num_rows:
            docs, tags, ns = _join(owners.column("docs"), np.int64), _join(owners.column("tags"), np.uint64), _join(owners.column("ns"), np.int32)
            home = (tags % np.uint64(shards)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            ends = np.searchsorted(home[order], np.arange(shards + 1))
            rows = []
            for k in range(shards):
                o = order[ends[k] : ends[k + 1]]
                if len(o):
                    rows.append((-1, k, docs[o].tobytes(), tags[o].tobytes(), ns[o].tobytes(), None, None, None))
            yield _batch(rows)
            del rows
        del owners, tables
        t = t.filter(pa.compute.equal(t.column("home"), -1))
        shards_here = sorted(set(t.column("shard").to_pylist()))
        for shard in shards_here:
            part = t.filter(pa.compute.equal(t.column("shard"), shard)) if len(shards_here) > 1 else t
            if len(shards_here) == 1:
                del t
            tags, counts = _join(part.column("tags"), np.uint64), _counts(part.column("counts"), part.column("tags"))
            grams = _unpack(part.column("grams").to_pylist())
            del part
            ta.release()
            tags, one = np.unique(tags, return_index=True)  # equal sets are one
            starts = (np.cumsum(counts) - counts)[one]
            counts = counts[one]
            grams = grams[ta.ragged(starts, counts)]
            order = np.argsort(grams).astype(np.int32)
            sizes = np.diff(ta.bounds(grams[order])).astype(np.int32)
            df = np.empty(len(grams), np.int32)
            df[order] = np.repeat(sizes, sizes)
            del order, sizes
            alive = df > 1
            owner = np.repeat(np.arange(len(tags), dtype=np.int32), counts)[alive]
            grams, df = grams[alive], df[alive]
            rank = np.minimum(255, np.where(df < 128, df, 128 + 8 * np.log2(df / 128.0))).astype(np.uint8)
            left = np.bincount(owner, minlength=len(tags))
            first = np.cumsum(left) - left
            home = (tags % np.uint64(shards)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            order = order[left[order] > 0]
            ends = np.searchsorted(home[order], np.arange(shards + 1))
            rows = []
            for k in range(shards):
                o = order[ends[k] : ends[k + 1]]
                if len(o):
                    at = ta.ragged(first[o], left[o])
                    rows.append((shard, k, None, tags[o].tobytes(), None, _pack_counts(left[o]), _pack(grams[at]), rank[at].tobytes()))
            if rows:
                yield _batch(rows)

    return apply


def _homes(threshold: float):  # noqa: ANN202
    """At home: rows (tag, n, doc) of owners, and (tag, n, grams) of sets with enough living lists; grams in order, shortest lists first."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        names, kinds = ["tag", "n", "doc", "grams"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        owners = t.filter(pa.compute.equal(t.column("shard"), -1))
        docs, tags, ns = _join(owners.column("docs"), np.int64), _join(owners.column("tags"), np.int64), _join(owners.column("ns"), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(tags), pa.array(ns), pa.array(docs), pa.nulls(len(tags), pa.binary())], names)
        known, one = np.unique(tags.view(np.uint64), return_index=True)
        size_of = ns[one].astype(np.int64)
        t = t.filter(pa.compute.greater_equal(t.column("shard"), 0))
        if not t.num_rows:
            return
        tags, counts = _join(t.column("tags"), np.uint64), _counts(t.column("counts"), t.column("tags"))
        shard = np.repeat(np.array(t.column("shard").to_pylist(), np.uint64), [len(x) // 8 for x in t.column("tags").to_pylist()])
        total, back = np.unique(tags, return_inverse=True)
        alive, size = np.bincount(back, counts, len(total)), size_of[np.searchsorted(known, total)]  # owners' rows are at home too
        enough = alive >= required(size, threshold)
        grams, rank = _unpack(t.column("grams").to_pylist()), _join(t.column("dfs"), np.uint8)
        del t
        rows = np.flatnonzero(enough[back])
        rows = rows[np.argsort(back[rows], kind="stable")]
        at = ta.ragged((np.cumsum(counts) - counts)[rows], counts[rows])
        with np.errstate(over="ignore"):
            # The shard tells apart equal low bits; order within a list length is by hash.
            full = ta.mix(grams[at] ^ (np.repeat(shard[rows], counts[rows]) << np.uint64(48)))
        who, rank = np.repeat(back[rows], counts[rows]), rank[at]
        order = np.lexsort((full, rank, who))
        full, who = full[order], who[order]
        cut = ta.bounds(who)
        for a in range(0, len(cut) - 1, 2000):
            c = cut[a : a + 2001]
            w = who[c[:-1]]
            data = [full[x:y].tobytes() for x, y in zip(c[:-1], c[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(total[w].view(np.int64)), pa.array(size[w].astype(np.int32)), pa.nulls(len(w), pa.int64()), pa.array(data, kinds[3])], names)

    return apply


def _prefixes(threshold: float):  # noqa: ANN202
    """Rows (gram, tag, n, behind), with own if the sets have labels: the lists that each set posts, and how many of its own are behind each."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tags, ns = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            m = np.array([len(x) // 8 for x in batch.column(2).to_pylist()], np.int64)
            grams = _join(batch.column(2), np.int64)
            p = m - required(ns, threshold) + 1
            at = ta.ragged(np.cumsum(m) - m, p)
            behind = np.repeat(m, p) - (ta.ragged(np.zeros(len(p), np.int64), p)) - 1
            own = [pa.array(np.repeat(c.to_numpy(), p)) for c in batch.columns[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(grams[at]), pa.array(np.repeat(tags, p)), pa.array(np.repeat(ns, p).astype(np.int32)), pa.array(behind.astype(np.int32)), *own], ["gram", "tag", "n", "behind", "own"][: 4 + len(own)])

    return apply


class _Lists:
    """Posted lists of a shard, each by the size of its sets; lo..hi are the places in its list of those a set may be similar to, as far as itself knows."""

    def __init__(self, t: pa.Table, threshold: float):
        gram, n, behind = (t.column(c).to_numpy() for c in ("gram", "n", "behind"))
        order = np.lexsort((n, gram))
        gram, n, behind = gram[order], n[order].astype(np.int64), behind[order].astype(np.int64)
        self.order, self.cut = order, ta.bounds(gram)
        self.list = np.repeat(np.arange(len(self.cut) - 1), np.diff(self.cut))
        # Of two sets with a list in common the overlap is 1 and what is behind it in both, at most.
        most = np.minimum(np.floor(n / threshold + _EPS), np.floor((1 + behind) * (1 + threshold) / threshold + _EPS).astype(np.int64) - n).astype(np.int64)
        self.least, self.most, self.n = required(n, threshold), most, n
        self.wide = int(n.max()) + 2 if len(n) else 2

    def reach(self, group: np.ndarray, key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in key (ascending: group and size in one number) the sizes that each x may have in each group are."""
        low, high = np.minimum(self.least[x], self.wide - 1), np.clip(self.most[x], -1, self.wide - 2)
        return np.searchsorted(key, group * self.wide + low), np.searchsorted(key, group * self.wide + high + 1)


def _range_min(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of v[lo:hi], none of them empty; by tables of the least of 2^k values."""
    out, level = np.empty(len(lo), v.dtype), np.frexp((hi - lo).astype(np.float64))[1] - 1
    table = v
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[: len(table) - half], table[half:])
        o = np.flatnonzero(level == k)
        out[o] = np.minimum(table[lo[o]], table[hi[o] - (1 << k)])
    return out


def _least_partners(threshold: float):  # noqa: ANN202
    """Rows (tag, least): a set with possible partners, and the least tag among it and them."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        tags, who = np.unique(t.column("tag").to_numpy(), return_inverse=True)
        lists = _Lists(t, threshold)
        who = who[lists.order]
        lo, hi = lists.reach(lists.list, lists.list * lists.wide + lists.n, np.arange(len(who)))
        some = np.flatnonzero(hi - lo > ((lists.n >= lists.least) & (lists.n <= lists.most)))  # others than itself
        least, paired = np.arange(len(tags)), np.zeros(len(tags), bool)
        np.minimum.at(least, who[some], _range_min(who, lo[some], hi[some]))
        paired[who[some]] = True
        yield pa.RecordBatch.from_arrays([pa.array(tags[paired]), pa.array(tags[least[paired]])], ["tag", "least"])

    return apply


def _meetings(threshold: float, step: int = 2_000_000):  # noqa: ANN202
    """Rows (lo, hi, tag, own): a set must be in the block of the labels lo and hi, one of them its own and the other a possible partner's."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        tags, at, who = np.unique(t.column("tag").to_numpy(), return_index=True, return_inverse=True)
        labels, label = np.unique(t.column("own").to_numpy()[at], return_inverse=True)
        lists = _Lists(t, threshold)
        who = who[lists.order]
        own = label[who]
        # Each list's sets by label, then size; each set against each label of its list.
        order = np.lexsort((lists.n, own, lists.list))
        pair = lists.list[order] * len(labels) + own[order]
        cut = ta.bounds(pair)
        group = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        key, label_of = group * lists.wide + lists.n[order], own[order][cut[:-1]]
        list_of = lists.list[order][cut[:-1]]
        first = np.searchsorted(list_of, np.arange(len(lists.cut) - 1))
        kinds = np.diff(np.append(first, len(list_of)))
        upto = np.cumsum(kinds[lists.list])
        met, a = np.zeros(0, np.int64), 0
        while a < len(who):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + step, side="right")))
            of = lists.list[a:b]
            x, g = np.repeat(np.arange(a, b), kinds[of]), ta.ragged(first[of], kinds[of])
            lo, hi = lists.reach(g, key, x)
            alone = (label_of[g] == own[x]) & (lists.n[x] >= lists.least[x]) & (lists.n[x] <= lists.most[x])
            ok = hi - lo > alone
            met = np.union1d(met, who[x[ok]] * len(labels) + label_of[g[ok]])
            a = b
        one, other = met // max(1, len(labels)), labels[met % max(1, len(labels))]
        mine = labels[label[one]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other)), pa.array(tags[one]), pa.array(mine)], ["lo", "hi", "tag", "own"])

    return apply


def divide_skip(sets: list[np.ndarray], ns: np.ndarray, threshold: float, mu: float = 0.01) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, partners after it, their overlaps) for each set as a query over the others' inverted lists.

    sets hold distinct values each; ns are their whole sizes. The L longest of a
    query's lists are set aside; the others, each in order, are merged (by a
    sort that merges runs), and sets that T - L of them have are looked up in
    the long ones by binary search.
    """
    size = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")  # lists by value, owners ascending
    lists, cut = owner[order], np.searchsorted(flat[order], np.arange(flat.max() + 2))
    place = np.empty(len(flat), np.int64)  # of each set's own entry in its lists
    place[order] = np.arange(len(flat))
    first = np.cumsum(size) - size
    for q in range(len(sets)):
        at = slice(first[q], first[q] + size[q])
        start, stop = place[at] + 1, cut[flat[at] + 1]  # only sets after the query
        length = stop - start
        t = int(required(ns[q], threshold))
        by = np.argsort(length, kind="stable")
        start, length = start[by], length[by]
        aside = min(t - 1, int(t / (mu * np.log2(max(2, int(length[-1]))) + 1)), len(by) - 1)
        # Lists as short as the query's rarest gain nothing by being set aside.
        while aside and length[len(by) - aside] <= 4:
            aside -= 1
        short = len(by) - aside
        merged = np.sort(lists[ta.ragged(start[:short], length[:short])], kind="stable")
        ends = ta.bounds(merged)
        if len(ends) < 2:
            continue
        cand, got = merged[ends[:-1]], np.diff(ends)
        enough = got >= max(1, t - aside)
        cand, got = cand[enough], got[enough]
        for a, n in zip(start[short:].tolist(), length[short:].tolist(), strict=True):
            if not len(cand):
                break
            members = lists[a : a + n]
            where = np.minimum(np.searchsorted(members, cand), n - 1)
            got = got + (members[where] == cand)
        ok = got >= required_of(ns[q], ns[cand], threshold)
        if ok.any():
            yield q, cand[ok], got[ok]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(lo, hi, tags, own labels, sizes, copies, sets) of each block; rows come sorted."""

    def made(rows: list[tuple]) -> tuple:
        lo, hi, tag, own, n, copies, grams = zip(*rows, strict=True)
        return lo[0], hi[0], *(np.array(c, np.int64) for c in (tag, own, n, copies)), [np.frombuffer(g, np.uint64) for g in grams]

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:2] != row[:2]:
                if len(held) > 1:
                    yield made(held)
                held = []
            held.append(row)
    if len(held) > 1:
        yield made(held)


def _verify(threshold: float, pairs: bool):  # noqa: ANN202
    """Rows (a, b, na, nb, overlap) of a block's pairs, or (a, null, links) and (a, b) of a forest that spans them; a pair is told in the block of its own two labels only."""

    def of(lo: int, hi: int, own: np.ndarray, sets: list[np.ndarray], ns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for q, p, o in divide_skip(sets, ns, threshold):
            mine = (own[p] == hi) if own[q] == lo else (own[p] == lo) if own[q] == hi else np.zeros(len(p), bool)
            if mine.any():
                yield q, p[mine], o[mine]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lo, hi, tag, own, ns, copies, sets in _blocks(batches):
            found = of(lo, hi, own, sets, ns)
            if pairs:
                for q, p, o in found:
                    k = np.full(len(p), q)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (tag[k], tag[p], ns[k], ns[p], o)], ["a", "b", "na", "nb", "overlap"])
                continue
            links, tree, edges = np.zeros(len(tag), np.int64), np.arange(len(tag)), []
            for q, p, _ in found:
                links[q] += copies[p].sum()
                links[p] += copies[q]
                for k in p[tree[p] != tree[q]].tolist():
                    if tree[k] != tree[q]:
                        edges.append((q, k))
                        tree[tree == tree[k]] = tree[q]
            some = np.flatnonzero(links)
            a, b = np.array(edges, np.int64).reshape(-1, 2).T
            one, none = pa.RecordBatch.from_arrays, pa.nulls
            if len(some):
                yield one([pa.array(tag[some]), none(len(some), pa.int64()), pa.array(links[some])], ["a", "b", "links"])
                yield one([pa.array(tag[a]), pa.array(tag[b]), none(len(a), pa.int64())], ["a", "b", "links"])

    return apply


def _searched(docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str, pairs: bool) -> tuple[DataFrame, DataFrame]:
    """(rows (tag, n, doc), one for each document with words and its set; rows of _verify)."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    shards = store.partitions_for(docs, SHARD_BYTES, 4, 2.0)
    kind = "tag long, n int, doc long, grams binary"
    sent = rows.mapInArrow(_to_shards(shards, n), _SHARD).repartitionById(shards, F.col("shard"))
    home = sent.mapInArrow(_living(shards), _SHARD).repartitionById(shards, F.col("home"))
    found = store.written(home.mapInArrow(_homes(threshold), kind), "sets")
    owners = store.written(found.where("grams is null").select("tag", "n", "doc").distinct(), "owners")
    sets = found.where("grams is not null").select("tag", "n", "grams")
    posted = sets.mapInArrow(_prefixes(threshold), "gram long, tag long, n int, behind int")
    # No table of candidate pairs is made: what moves are sets' labels, the least tag among their possible partners.
    least = posted.repartition(shards, "gram").mapInArrow(_least_partners(threshold), "tag long, least long")
    label = store.written(least.groupBy("tag").agg(F.min("least").alias("label")), "labels")
    parts = label.groupBy("label").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("k"))
    # A label with very many sets is cut into parts; pairs of labels or parts are the blocks.
    part = F.when(F.col("k") == 1, F.col("label")).otherwise(F.xxhash64("label", F.pmod(F.hash("tag"), F.col("k"))))
    label = label.join(parts, "label").select("tag", part.alias("own"))
    again = sets.join(label, "tag").select("tag", "n", "grams", "own").mapInArrow(_prefixes(threshold), "gram long, tag long, n int, behind int, own long")
    met = again.repartition(shards, "gram").mapInArrow(_meetings(threshold), "lo long, hi long, tag long, own long").distinct()
    copies = owners.groupBy("tag").agg(F.count("*").alias("copies"))
    blocks = met.join(sets.join(copies, "tag"), "tag").select("lo", "hi", "tag", "own", "n", "copies", "grams").repartition(shards, "lo", "hi").sortWithinPartitions("lo", "hi", "tag")
    out = store.written(blocks.mapInArrow(_verify(threshold, pairs), "a long, b long, na long, nb long, overlap long" if pairs else "a long, b long, links long"), "similar")
    store.drop(found)
    return owners, out


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_a, doc_b, overlap, jaccard), doc_a < doc_b, of all pairs of different similar sets, each named by the least id that has it."""
    owners, pairs = _searched(docs, n, threshold, id_col, text_col, True)
    name = lambda t, d: owners.groupBy(F.col("tag").alias(t)).agg(F.min("doc").alias(d))
    rows = pairs.join(name("a", "da"), "a").join(name("b", "db"), "b")
    return rows.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"), "overlap", (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("jaccard"))


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, class_id, links), one for each document: how many others are similar to it, and the least id of those that chains of similar ones connect it with.

    A gram is n successive words (runs of letters and digits, lower case); a
    document of fewer words has one gram, of them all. Rows with a null id have
    no row. A document whose texts are null or without words is of its own
    class and has no links. Rows that repeat an id are versions of one
    document: those with equal sets are one; each version has the versions of
    other sets or documents that it is similar to as links, and a document the
    sum of its versions'; their classes are one class. Very long texts are one set
    as any other. Other columns are not read.
    """
    owners, found = _searched(docs, n, threshold, id_col, text_col, False)
    links = found.where("b is null").groupBy(F.col("a").alias("tag")).agg(F.sum("links").alias("links"))
    equal = owners.groupBy("tag").agg((F.count("*") - 1).alias("equal"))
    of = owners.join(equal, "tag").join(links, "tag", "left").groupBy("doc").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("equal")).alias("links"))
    grouped = _groups(owners, found)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    out = out.join(of.join(grouped, "doc").withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    out = store.written(out.select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    store.drop(owners), store.drop(found)
    return out


def _groups(owners: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc, class): the least document that chains of similar sets, and of versions of a document, connect each with."""
    versions = owners.groupBy("doc").agg(F.min("tag").alias("a"), F.max("tag").alias("z"), F.count("*").alias("c")).where("c > 1").select("doc", "a")
    edges = found.where("b is not null").select("a", "b").unionByName(owners.join(versions, "doc").where("a <> tag").select("a", F.col("tag").alias("b")))
    group = owners.join(components(edges), "tag", "left").select("doc", F.coalesce("label", "tag").alias("comp")).distinct()
    least = group.groupBy("comp").agg(F.min("doc").alias("class"))
    return group.join(least, "comp").select("doc", "class")


def components(edges: DataFrame) -> DataFrame:
    """Rows (tag, label) of the nodes of edges (a, b): the least tag of its connected component.

    Least labels of neighbours, then of labels, until nothing changes; each round is written.
    """
    both = store.written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels = store.written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("tag"), F.least("u", "m").alias("label")), "components")
    while True:
        of = labels.select(F.col("tag").alias("v"), F.col("label").alias("near"))
        best = both.join(of, "v").groupBy("u").agg(F.min("near").alias("near"))
        near = store.written(labels.join(best, labels.tag == best.u).select("tag", F.least("label", "near").alias("label"), F.col("label").alias("was")), "components")
        far = labels.select(F.col("tag").alias("label"), F.col("label").alias("further"))
        step = store.written(near.join(far, "label").select("tag", F.least("label", "further").alias("label"), "was"), "components")
        store.drop(near), store.drop(labels)
        labels = step.select("tag", "label")
        if step.where("label <> was").isEmpty():
            store.drop(both)
            return labels


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, that of the least id, of each class of jaccard_join().

    Rows with a null id or text and texts without words all stay. Rows that
    repeat an id are one document and stay or go together. Other columns, of
    whatever name, are kept as they are.
    """
    owners, found = _searched(docs, n, threshold, id_col, text_col, False)
    out = store.without(docs, _groups(owners, found).where("doc <> class").select("doc"), id_col)
    store.drop(owners), store.drop(found)  # the ids that go are a table of their own by now
    return out
