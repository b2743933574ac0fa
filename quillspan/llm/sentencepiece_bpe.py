"""SentencePiece (merge-type) encoding and decoding with a prefix table.

For each prefix of a text the table stores the one token that ends the
prefix's encoding. Candidates are the pieces that end there, longest first, as
an Aho-Corasick automaton finds them; one is right if it and the last token of
the prefix before it are a compatible pair, that is, merging their joint text
gives just the two. Ids are then read off backwards. The table is filled for
all distinct segments of a run of texts at once, a character at a time.

Segments end where no piece can go on: before a space mark that follows
another character, and around characters that are in no longer piece. If a
piece of the vocabulary has a space mark after another character, texts are
cut at unknown characters only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarr as ta

SPACE = 0x2581
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RUN_CHARS = 400_000
LONG = 64
_SLOTS = 1 << 20


class Vocabulary:
    """Pieces of a merge-type model, with the automaton that finds them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.size = size
        self.byte_id = {}
        self.piece_id: dict[str, int] = {}
        self.bytes = [b""] * size
        for i in range(size):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[value] = i
                self.bytes[i] = bytes([value])
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                p = sp.id_to_piece(i)
                self.piece_id[p] = i
                self.bytes[i] = p.replace(chr(SPACE), " ").encode()
        self.unknown = sp.unk_id()
        self.score = [sp.get_score(i) for i in range(size)]
        self.text = {i: p for p, i in self.piece_id.items()}
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.blob_len = np.array([len(b) for b in self.bytes], np.int64)
        self.blob_start = np.cumsum(self.blob_len) - self.blob_len
        longer = [p for p in self.piece_id if len(p) > 1]
        self.cut_at_spaces = not any(p[j] == chr(SPACE) and p[j - 1] != chr(SPACE) for p in longer for j in range(1, len(p)))
        letters = sorted(set("".join(longer)))
        self.symbol = np.zeros(0x110000, np.int32)  # 0: in no longer piece
        for k, ch in enumerate(letters):
            self.symbol[ord(ch)] = k + 1
        self.scalar_only = {ch for ch in letters if ch not in self.piece_id}  # never so in a trained vocabulary
        self._automaton(longer, letters)
        self._splits(longer)
        self.pair_key = np.full(_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(_SLOTS, bool)

    def _automaton(self, longer: list[str], letters: list[str]) -> None:
        index = {ch: k for k, ch in enumerate(letters)}
        pieces = longer + [ch for ch in letters if ch in self.piece_id]
        prefixes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}, key=len)
        state = {"": 0} | {p: k + 1 for k, p in enumerate(prefixes)}
        go = np.zeros((len(state), len(letters)), np.uint16 if len(state) < 1 << 16 else np.int32)
        fail = np.zeros(len(state), np.int32)
        self.longest = np.full(len(state), -1, np.int32)  # id of the longest piece that ends here
        self.shorter = np.full(self.size, -1, np.int32)  # the next shorter piece that ends where this one ends
        self.chars = np.ones(self.size, np.int64)
        for p in pieces:
            self.chars[self.piece_id[p]] = len(p)
        children: dict[int, list[tuple[int, int]]] = {}
        for p in prefixes:
            children.setdefault(state[p[:-1]], []).append((index[p[-1]], state[p]))
        name = [""] + prefixes
        for s in range(len(state)):  # by length: shorter states are done before
            if s:
                go[s] = go[fail[s]]
                own, below = self.piece_id.get(name[s], -1), self.longest[fail[s]]
                self.longest[s] = own if own >= 0 else below
                if own >= 0:
                    self.shorter[own] = below
            for k, child in children.get(s, ()):
                fail[child] = go[s, k] if s else 0
                go[s, k] = child
        self.go = go

    def _splits(self, longer: list[str]) -> None:
        """rank: the order in which pieces are made, 0 for characters; left and right: of what two a piece is made last, itself for characters; joint_*: all pairs of pieces whose joint text is one."""
        self.rank = np.zeros(self.size, np.int64)
        for k, p in enumerate(sorted(longer, key=lambda p: -self.score[self.piece_id[p]])):
            self.rank[self.piece_id[p]] = k + 1
        self.left = np.arange(self.size, dtype=np.int64)
        self.right = self.left.copy()
        # False for pieces that merging never makes.
        self.made = np.ones(self.size, bool)
        found = [(i, self.piece_id[p[:k]], self.piece_id[p[k:]]) for p in longer for i in (self.piece_id[p],) for k in range(1, len(p)) if p[:k] in self.piece_id and p[k:] in self.piece_id]
        joint, one, two = np.array(found, np.int64).reshape(-1, 3).T
        key = one * self.size + two
        order = np.argsort(key)
        self.joint_key, self.joint_rank = key[order], self.rank[joint[order]]
        self.made[[self.piece_id[p] for p in longer]] = False
        length = self.chars[joint]
        for n in range(2, int(length.max()) + 1 if len(length) else 2):  # of shorter pieces all is known
            o = np.flatnonzero(length == n)
            o = o[self._stay(one[o], two[o], self.rank[joint[o]])]
            self.left[joint[o]], self.right[joint[o]], self.made[joint[o]] = one[o], two[o], True

    def merge(self, text: str) -> list[str]:
        """The definition: again and again join the neighbours whose joint piece has the best score, the leftmost first."""
        parts, ids, score = list(text), self.piece_id, self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay(self, one: np.ndarray, two: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether merging the joint text of each pair gives the two, with no piece of a rank below limit across their border.

        Their merges are undone, the last made first: at each step nothing that
        was to be made before may join what is at the border.
        """
        ok = self.made[one] & self.made[two]
        a, b, limit = one.copy(), two.copy(), limit.copy()
        live = np.flatnonzero(ok)
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.joint_key, key), len(self.joint_key) - 1)
            joined = (self.joint_key[at] == key) & (self.joint_rank[at] < limit[live])
            ok[live[joined]] = False
            live, x, y = live[~joined], x[~joined], y[~joined]
            rx, ry = self.rank[x], self.rank[y]
            first = rx > ry  # the later one is undone; of equal ones the right, which merges after the left
            live = live[(rx > 0) | (ry > 0)]
            keep = (rx > 0) | (ry > 0)
            x, y, rx, ry, first = x[keep], y[keep], rx[keep], ry[keep], first[keep]
            limit[live] = np.where(first, rx, ry + 1)
            a[live], b[live] = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        slot = (key * 0x9E3779B1 >> 7) & (_SLOTS - 1)
        ok = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair_key[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            said = self._stay(new // self.size, new % self.size, np.full(len(new), 1 << 60))
            at = (new * 0x9E3779B1 >> 7) & (_SLOTS - 1)
            self.pair_key[at], self.pair_ok[at] = new, said
            ok[miss] = said[back]
            # Two new pairs in one slot: the later one's key must go with its own answer.
            self.pair_ok[at] = said
            lost = self.pair_key[at] != new
            self.pair_key[at[lost]] = -1
        return ok

    def single(self, ch: str) -> list[int]:
        if ch in self.piece_id:
            return [self.piece_id[ch]]
        if self.byte_id:
            return [self.byte_id[b] for b in ch.encode("utf-8", "replace")]
        return [self.unknown]

    def scalar(self, text: str) -> list[int]:
        """The prefix table of one text whose characters are all in longer pieces."""
        last, state, codes = [], 0, self.symbol[np.array([ord(c) for c in text])] - 1
        for pos, k in enumerate(codes.tolist()):
            state = int(self.go[state, k])
            t = int(self.longest[state])
            while True:
                before = pos - int(self.chars[t])
                if before < 0 or bool(self.compatible(np.array([last[before]]), np.array([t]))[0]):
                    break
                t = int(self.shorter[t])
            last.append(t)
        out, pos = [], len(last) - 1
        while pos >= 0:
            out.append(last[pos])
            pos -= int(self.chars[last[pos]])
        return out[::-1]

    def segments(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, their number) of segments that are parts of symbols, none 0, none longer than LONG."""
        order = np.argsort(-size, kind="stable")
        start, n = start[order], size[order]
        rows, width = len(n), int(n[0]) if len(n) else 0
        last = np.zeros((width, rows), np.int32)
        state = np.zeros(rows, np.int32)
        live = np.searchsorted(-n, -np.arange(width), side="left")
        for pos in range(width):
            k = int(live[pos])
            s = self.go[state[:k], symbols[start[:k] + pos] - 1]
            state[:k] = s
            row, t = np.arange(k), self.longest[s]
            while len(row):
                before = pos - self.chars[t]
                inner = np.flatnonzero(before >= 0)
                bad = inner[~self.compatible(last[before[inner], row[inner]], t[inner])]
                last[pos, row] = t
                row, t = row[bad], self.shorter[t[bad]]
        found = np.zeros((width, rows), np.int32)
        count, pos, row = np.zeros(rows, np.int64), n - 1, np.arange(rows)
        while len(row):
            t = last[pos, row]
            found[count[row], row] = t
            count[row] += 1
            pos = pos - self.chars[t]
            going = pos >= 0
            row, pos = row[going], pos[going]
        counts = np.empty(rows, np.int64)
        counts[order] = count
        first = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int32)
        for k in range(int(count.max()) if rows else 0):
            r = np.flatnonzero(count > k)
            ids[first[order[r]] + count[r] - 1 - k] = found[k, r]
        return ids, counts

    def encode_run(self, run: ta.Run) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, their number in each document)."""
        c = np.concatenate((np.array([10], np.uint32), run.chars[:-1]))
        c[c == 32] = SPACE
        full = run.sizes > 0
        c[run.starts[full]] = SPACE
        used = np.ones(len(c), bool)
        used[run.starts[~full]] = False
        sym = self.symbol[c]
        edge = np.ones(len(c) + 1, bool)
        if self.cut_at_spaces:
            edge[1:-1] = (c[1:] == SPACE) & (c[:-1] != SPACE)
        else:
            edge[1:-1] = False
        edge[1:-1] |= (sym[1:] == 0) | (sym[:-1] == 0)
        edge[run.starts] = True
        at = np.flatnonzero(edge)
        start, size = at[:-1], np.diff(at)
        start, size = start[used[start]], size[used[start]]
        up, down = ta.powers(len(c))
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value()[c] * up[: len(c)])))
            key = (total[start + size] - total[start]) * down[start]
        _, where, back = np.unique(key, return_index=True, return_inverse=True)
        s, n = start[where], size[where]
        usual = (sym[s] > 0) & (n <= LONG) if not self.scalar_only else np.zeros(len(s), bool)
        ids, counts = self.segments(sym, s[usual], n[usual])
        all_counts = np.zeros(len(s), np.int64)
        all_counts[usual] = counts
        rest: dict[int, list[int]] = {}
        for k in np.flatnonzero(~usual).tolist():
            text = c[s[k] : s[k] + n[k]].tobytes().decode("utf-32-le", "surrogatepass")
            if sym[s[k]] == 0:
                rest[k] = [i for ch in text for i in self.single(ch)]
            elif self.scalar_only:
                rest[k] = [i for p in self.merge(text) for i in ([self.piece_id[p]] if p in self.piece_id else self.single(p))]
            else:
                rest[k] = self.scalar(text)
            all_counts[k] = len(rest[k])
        first = np.zeros(len(s), np.int64)
        first[usual] = np.cumsum(counts) - counts
        if rest:
            extra = np.cumsum([len(x) for x in rest.values()])
            first[list(rest)] = len(ids) + extra - [len(x) for x in rest.values()]
            ids = np.concatenate((ids, np.array([i for x in rest.values() for i in x], np.int32)))
        doc_first = np.searchsorted(start, run.starts)
        per_segment = all_counts[back]
        ends = np.concatenate(([0], np.cumsum(per_segment)))
        out = ids[ta.ragged(first[back], per_segment)]
        return out, np.diff(ends[np.append(doc_first, len(start))])

    def value(self) -> np.ndarray:
        c = ta.cache()
        if "piece values" not in c:
            c["piece values"] = ta.mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x1234567))
        return c["piece values"]

    def decode_run(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes end to end, their number in each document), without the space that encoding puts before a text."""
        n = self.blob_len[ids]
        first = np.cumsum(counts) - counts
        begins = self.blob_start[ids].copy()
        lead = first[counts > 0]
        lead = lead[self.blob[begins[lead]] == 32] if len(lead) else lead
        begins[lead] += 1
        n = n.copy()
        n[lead] -= 1
        data = self.blob[ta.ragged(begins, n)]
        ends = np.concatenate(([0], np.cumsum(n)))
        return data, np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])


def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker and path."""
    known = ta.cache().setdefault("pieces", {})
    if path not in known:
        known[path] = Vocabulary(path)
    return known[path]


def _lists(ids: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))


def encode_texts(texts: pa.Array, path: str, decode: bool) -> Iterator[tuple[ta.Run, pa.Array, pa.Array, pa.Array | None]]:
    """(run, ids, their number, decoded texts) of each run; null for null texts."""
    v = vocabulary(path)
    for run in ta.runs(texts, RUN_CHARS):
        null = texts.slice(run.first, run.n).is_null().to_numpy(zero_copy_only=False)
        ids, counts = v.encode_run(run)
        back = None
        if decode:
            data, sizes = v.decode_run(ids, counts)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            back = pa.StringArray.from_buffers(run.n, pa.py_buffer(offsets), pa.py_buffer(data), pa.array(~null).buffers()[1] if null.any() else None, int(null.sum()))
        yield run, _lists(ids, counts, null), pa.array(counts.astype(np.int32), mask=null), back


def encode_decode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids, n_ids, decoded), one for each row of docs.

    Ids are those of the model's own encoder. decoded is the text that the ids
    give: the text itself, but for space marks (U+2581) in it, which read as
    spaces. An empty text has no ids and decodes to itself; a null one has null
    throughout. Null and repeated ids stay as they are; other columns are not
    read. model_path must exist on every executor.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, ids, n, text in encode_texts(batch.column(1), model_path, True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.n), ids, n, text], ["doc_id", "ids", "n_ids", "decoded"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(apply, "doc_id long, ids array<int>, n_ids int, decoded string")


def decode_ids(rows: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, text): the texts of lists of ids. A null list gives null; ids outside the vocabulary and null ones give nothing; bytes that are not UTF-8 read as U+FFFD."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                data = None if ids is None else b"".join(v.bytes[i] for i in ids if i is not None and 0 <= i < v.size)
                texts.append(None if data is None else (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(apply, "doc_id long, text string")
