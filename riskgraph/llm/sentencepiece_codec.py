"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is read directly (protocol-buffer wire format): pieces, scores and kinds.
Text is escaped as the library does (a leading U+2581, spaces as U+2581), cut into pieces
of text that no merge can cross, and each distinct cut is encoded once for a batch. The
merging itself is numpy only: the symbols of all cuts lie in one flat array; a round finds
each cut's lowest pair rank by a segmented minimum, merges the leftmost disjoint
occurrences of it in all cuts at once, compacts the array and goes on until no pair
remains. Where a merge makes a pair that ranks no later than the one just merged, order
within the cut matters; such cuts are done over, one leftmost merge at a time, by a heap.

Nulls count as empty texts; an empty text has only the begin and end ids. Texts of any
length are encoded whole. Models other than BPE with the identity normaliser are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskgraph.llm.words import free_name, trimmed

SPACE = "▁"
#: Cuts whose ids one task remembers; beyond it the memory starts anew.
REMEMBERED = 200_000
#: Symbols merged together in one flat array.
FLAT_SYMBOLS = 1 << 20

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol-buffer message."""
    i, n = 0, len(buf)

    def varint(i: int) -> tuple[int, int]:
        r = s = 0
        while True:
            c = buf[i]
            i += 1
            r |= (c & 127) << s
            s += 7
            if c < 128:
                return r, i

    while i < n:
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = buf[i : i + size], i + size
        else:
            size = 4 if kind == 5 else 8
            value, i = buf[i : i + size], i + size
        yield key >> 3, value


class PieceModel:
    """Pieces, merge ranks and byte ids of one model file."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        scores, self.kinds = [], []
        trainer: dict = {}
        normal: dict = {}
        for field, value in _fields(raw):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode("utf-8"))
                scores.append(float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0)
                self.kinds.append(p.get(3, _NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if trainer.get(3) != 2 or normal.get(2) or not trainer.get(35):
            raise ValueError("only BPE models with byte fallback and the identity normaliser are supported")
        if _USER in self.kinds or normal.get(3, 1) != 1 or normal.get(4, 1) != 0:
            raise ValueError("only a leading-space model without user symbols that keeps white space is supported")
        self.bos, self.eos = trainer.get(41, 1), trainer.get(42, 2)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == _NORMAL}
        by_score = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        self.byte_ids = [0] * 256
        for i, k in enumerate(self.kinds):
            if k == _BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        left, right, rank, merged = [], [], [], []
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(by_score[scores[i]]), merged.append(i)
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.merged = key[order], np.array(rank, np.int64)[order], np.array(merged, np.int64)[order]
        self._hashed()
        self.pairs = {int(k): (int(r), int(m)) for k, r, m in zip(self.key, self.rank, self.merged)}
        normal_pieces = [p for p in self.ids if len(p) > 1]
        #: Text is cut before each space, and around line ends, if no piece crosses these.
        self.cut_space = not any(SPACE in p.lstrip(SPACE) for p in normal_pieces)
        self.cut_line = not any("\n" in p for p in normal_pieces)
        self.table = [
            b"" if k == _CONTROL
            else bytes([int(p[3:5], 16)]) if k == _BYTE
            else " ⁇ ".encode() if k == _UNKNOWN
            else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds)
        ]

    def _hashed(self) -> None:
        """An open-addressed table of the pairs: a few gathers find a pair, where a sorted search takes many."""
        size = 1 << (len(self.key) * 4).bit_length()
        self.mask = np.int64(size - 1)
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_at = np.zeros(size, np.int64)
        left = np.arange(len(self.key))
        at = self._slot(self.key)
        while len(left):
            free = self.slot_key[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = first[free[first]]
            self.slot_key[at[won]] = self.key[left[won]]
            self.slot_at[at[won]] = left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        k = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (k >> np.uint64(33)).astype(np.int64) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair of symbols in rank and merged, or -1."""
        out = np.full(len(a), -1, np.int64)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[todo] << 32 | b[todo]
        at = self._slot(key)
        while len(todo):
            got = self.slot_key[at]
            hit = got == key
            out[todo[hit]] = self.slot_at[at[hit]]
            on = ~hit & (got != -1)
            todo, key, at = todo[on], key[on], (at[on] + 1) & self.mask
        return out

    # -- encoding of cuts ---------------------------------------------------------------

    def encode_cuts(self, cuts: list[str]) -> list[bytes]:
        """Ids of each escaped cut as little-endian 32-bit integers."""
        out: list[bytes] = []
        start = size = 0
        for i, c in enumerate(cuts):
            if size and size + len(c) > FLAT_SYMBOLS:
                out += self._merge(cuts[start:i])
                start, size = i, 0
            size += len(c)
        return out + self._merge(cuts[start:])

    def _merge(self, cuts: list[str]) -> list[bytes]:
        n = len(cuts)
        if not n:
            return []
        length = np.fromiter(map(len, cuts), np.int64, n)
        points = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, inverse = np.unique(points, return_inverse=True)
        known = np.array([self.ids.get(chr(c), -1 - int(c)) for c in chars], np.int64)
        sym = known[inverse] if len(points) else np.zeros(0, np.int64)
        word = np.repeat(np.arange(n), length)
        done_sym: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        again = np.zeros(n, bool)
        none = np.iinfo(np.int64).max
        at = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            at[:-1] = np.where(word[:-1] == word[1:], self.find(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = np.where(at >= 0, self.rank[at], none)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            over = np.repeat(low == none, size)
            if over.any():
                done_sym.append(sym[over]), done_word.append(word[over])
                on = ~over
                sym, word, at, rank = sym[on], word[on], at[on], rank[on]
                size, low = size[low != none], low[low != none]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, size)
            # of touching occurrences every second one merges, from the left
            run = np.flatnonzero(hit)
            head = np.r_[True, np.diff(run) != 1]
            begin = run[np.flatnonzero(head)][np.cumsum(head) - 1]
            take = run[(run - begin) % 2 == 0]
            sym[take] = self.merged[at[take]]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, at = sym[keep], word[keep], at[keep]
            spot = place[take]
            fresh = np.unique(np.r_[spot, spot[spot > 0] - 1])
            fresh = fresh[fresh < len(sym) - 1]
            at[-1] = -1
            at[fresh] = np.where(word[fresh] == word[fresh + 1], self.find(sym[fresh], sym[fresh + 1]), -1)
            # where several merged at once, a new pair that ranks no later may have had to come first
            new = fresh[at[fresh] >= 0]
            if len(new):
                merges = np.bincount(word[spot], minlength=n)
                floor = np.full(n, -1, np.int64)
                floor[word[spot]] = np.repeat(low, size)[take]
                odd = (self.rank[at[new]] <= floor[word[new]]) & (merges[word[new]] > 1)
                if odd.any():
                    again[word[new[odd]]] = True
                    on = ~again[word]
                    sym, word, at = sym[on], word[on], at[on]
        ids = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        owner = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        # a cut leaves the rounds whole, so its symbols are together and in order
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(n + 1))
        flat = ids.astype("<u4").tobytes()
        has_unknown = np.zeros(n, bool)
        has_unknown[owner[ids < 0]] = True
        out = [flat[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for w in np.flatnonzero(has_unknown & ~again).tolist():
            out[w] = self._spell(ids[bounds[w] : bounds[w + 1]].tolist())
        for w in np.flatnonzero(again).tolist():
            out[w] = self._one_by_one(cuts[w])
        return out

    def _spell(self, symbols: list[int]) -> bytes:
        """Ids of symbols where -1 - code point stands for a character without a piece."""
        ids: list[int] = []
        for s in symbols:
            if s >= 0:
                ids.append(s)
            else:
                ids += [self.byte_ids[b] for b in chr(-1 - s).encode("utf-8", "surrogatepass")]
        return np.array(ids, "<u4").tobytes()

    def _one_by_one(self, cut: str) -> bytes:
        """The same by a heap of pairs: lowest rank first, then leftmost."""
        sym = [self.ids.get(c, -1 - ord(c)) for c in cut]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and sym[i] >= 0 and sym[j] >= 0:
                found = self.pairs.get(sym[i] << 32 | sym[j])
                if found:
                    heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j], after[i] = m, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return self._spell([s for s, g in zip(sym, gone) if not g])

    # -- decoding -----------------------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of ids given as little-endian 32-bit integers; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if raw[:1] == b" ":
            raw = raw[1:]
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode("utf-8")
        return raw


class Encoder:
    """Encodes whole texts; remembers the ids of the cuts it has met, up to a bound."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[str, bytes] = {}
        stop = "\n" if model.cut_line else ""
        if model.cut_space:
            self.cutter = re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + (f"|{stop}" if stop else ""))
        else:
            self.cutter = re.compile(f"[^{stop}]+|{stop}" if stop else "(?s:.+)")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with begin and end ids, as little-endian 32-bit integers."""
        cut = self.cutter.findall
        rows = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({c for r in rows for c in r if c not in known})
        known.update(zip(new, self.model.encode_cuts(new)))
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.model.bos, self.model.eos))
        get = known.__getitem__
        return [b"".join((begin, *map(get, r), end)) for r in rows]


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _text_blocks(texts: list[str | None], limit: int = 2 << 20) -> Iterator[list[str | None]]:
    block: list[str | None] = []
    size = 0
    for t in texts:
        if block and size + len(t or "") > limit:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t or "")
    if block:
        yield block


def encode_column(
    df: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None,
    ids: str | None = "ids", decoded: str | None = "decoded", digests: bool = False,
) -> DataFrame:
    """Adds the ids of a text column, the text decoded from them again, or digests of both.

    ``model`` holds the bytes of the model file (fixed size, sent with the plan). ``keep``
    names the input columns to return, all by default; a new column takes the place of one
    of the same name. Nulls count as empty. Rows neither move nor multiply: no shuffle.
    ``digests`` adds n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (of the decoded UTF-8).
    """
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] if ids else []
    if decoded:
        added.append(T.StructField(decoded, T.StringType()))
    if digests:
        added += T._parse_datatype_string(SCHEMA).fields
    names = {f.name for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    fields = [df.schema[c] for c in kept] + added
    source = df.select(*[df[c] for c in kept], df[text].cast("string").alias(free_name(df.columns, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(PieceModel(model))
        decode = coder.model.decode
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            at = 0
            for block in _text_blocks(texts):
                enc = coder.encode(block)
                columns = [batch.column(i).slice(at, len(block)) for i in range(len(kept))]
                at += len(block)
                if ids:
                    flat = np.frombuffer(b"".join(enc), "<u4").astype(np.int32)
                    offsets = np.cumsum([0, *(len(e) // 4 for e in enc)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                plain = [decode(e) for e in enc] if decoded or digests else []
                if decoded:
                    columns.append(pa.array([p.decode("utf-8") for p in plain], pa.string()))
                if digests:
                    columns.append(pa.array([len(e) // 4 for e in enc], pa.int64()))
                    columns.append(pa.array([hashlib.sha256(e).hexdigest() for e in enc]))
                    columns.append(pa.array([hashlib.sha256(p).hexdigest() for p in plain]))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return source.mapInArrow(trimmed(run), T.StructType(fields))


def decode_column(df: DataFrame, model: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text that an ids column stands for; a null list counts as empty."""
    kept = [c for c in df.columns if c != decoded]
    fields = [df.schema[c] for c in kept] + [T.StructField(decoded, T.StringType())]
    source = df.select(*[df[c] for c in kept], df[ids].cast("array<int>").alias(free_name(df.columns, "__ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = PieceModel(model).decode
        for batch in batches:
            out = [decode(np.array(i or [], "<u4").tobytes()).decode("utf-8") for i in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(out, pa.string())], [f.name for f in fields])

    return source.mapInArrow(trimmed(run), T.StructType(fields))


def read_model(path: str) -> bytes:
    """The bytes of a local model file, read on the driver."""
    with open(path, "rb") as f:
        return f.read()
