"""Scores texts by online logistic context mixing over bits, beside a unigram base score.

The model predicts a text's UTF-8 bytes and an end mark, bit by bit. For each order k in
``ORDERS`` it knows how often either bit followed the last k bytes and the bits of the byte
so far in training, exactly and for every context. Its prediction enters a logistic
mix: the weights are gated by bit position, by the longest context seen, and for each
input by how well its own context is known. The mix is refined by an adaptive map over
(bits so far, mixed prediction), and both are averaged.

Training is distributed and covers every training text:

1. Each distinct window of bytes (the longest context and the byte) is counted, in
   training and over all.
2. Windows are dealt into packs by their last three context bytes, so a pack has all
   counts of its windows' contexts of orders 3 to 5. The number of packs follows the
   number of windows. Counts of order 2, at most 2**24 whatever the corpus, are broadcast.
3. Mixing weights learn online from the windows, one learner per pack, which begins with
   the common weights, and are averaged by the mass they saw, for a few rounds; a window's
   own occurrence is taken out of the counts it is predicted from, so contexts seen once are
   not trusted. Packs do not depend on how rows lie in partitions, so weights do not either.
4. The refining map is counted in the same way under these weights.
5. Each distinct window of any text is predicted once. A text's score is the sum over its
   windows: predictions of the ``FREQUENT_WINDOWS`` most frequent are broadcast, the other
   windows meet theirs in a join.

The learning is what is online: texts are scored with the weights and the map as learnt, so
a text's score depends on neither its neighbours nor the order of rows.

The base score is sum of log10((c + 0.5) / (N + 0.5 * (V + 1))) over lower-cased words and
one end per text. The ``FREQUENT`` most frequent words are broadcast; the rest of the
words meets its counts in a join.

Nulls count as empty texts (only the end); a null id is one of training. Rows that repeat
an id and text are scored alike, each. Without training texts all counts are zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.durable import Stage
from riskgraph.llm.words import WordHashes, blocks, mix, text_bytes, trimmed

ORDERS = (2, 3, 4, 5)
WINDOW = ORDERS[-1] + 1
#: Sizes for made-up tables, as tests use; a trained model's have a row for every context and byte.
SLOT_BITS = (19, 20, 21, 22)
#: Windows of a pack on average.
PACK = 1 << 17
#: Words whose counts, and windows whose predictions, are broadcast.
FREQUENT = 1 << 18
FREQUENT_WINDOWS = 1 << 21
#: Bytes that no UTF-8 text has: before the start, and the end mark.
BEFORE, END = 0xFE, 0xFF
GATES = 8 * (len(ORDERS) + 1)
KNOWN = 8
RATE = 0.08
#: Windows in one step of learning, and rounds of learning and averaging.
BATCH = 256
ROUNDS = 2
EDGES = 33
DELTA = 0.4
#: Hash of the end token among the words; words hash by xxh3.
END_WORD = 0x5EED0FE4D
MASK = (1 << 64) - 1


# -- windows of bytes -----------------------------------------------------------------------


def byte_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte and end mark with the bytes before it, and the symbols of each text."""
    pad = bytes([BEFORE]) * (WINDOW - 1)
    joined = np.frombuffer(b"".join([pad + t + bytes([END]) for t in texts]), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    if not len(texts):
        return np.zeros(0, np.uint64), size
    code = np.zeros(len(joined) - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        code = code << np.uint64(8) | joined[i : i + len(code)]
    # what starts within the last symbols of a text runs over into the next one
    starts = np.concatenate([[0], np.cumsum(size + WINDOW - 1)[:-1]])
    flat = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return code[flat], size


def suffixes(code: np.ndarray, k: int) -> np.ndarray:
    """The byte of each window with its context of the k-th order."""
    return code & np.uint64((1 << 8 * (ORDERS[k] + 1)) - 1)


def tables(code: np.ndarray, n: np.ndarray, orders: range) -> list[np.ndarray]:
    """Per order, ascending rows (suffix, count) of all training windows given."""
    out = []
    for k in orders:
        key, at = np.unique(suffixes(code[n > 0], k), return_inverse=True)
        sums = np.zeros(len(key), np.int64)
        np.add.at(sums, at, n[n > 0])
        out.append(np.stack([key.view(np.int64), sums], axis=1))
    return out


def bit_counts(table: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often 0 and 1 followed the context and the byte's bits before, for each suffix (rows) and bit (columns)."""
    key, back = np.unique(suffix.astype(np.int64), return_inverse=True)
    known = np.ascontiguousarray(table[:, 0]).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(table[:, 1], dtype=np.int64)])
    path = np.empty((9, len(key)), np.int64)
    for b in range(9):
        first = key >> (8 - b) << (8 - b)
        path[b] = upto[np.searchsorted(known, first + (1 << (8 - b)))] - upto[np.searchsorted(known, first)]
    bits = _bits(key.view(np.uint64)) > 0
    own, other = path[1:].T, (path[:-1] - path[1:]).T
    return np.where(bits, other, own).astype(np.float32)[back], np.where(bits, own, other).astype(np.float32)[back]


def _bits(code: np.ndarray) -> np.ndarray:
    return (code[:, None] >> np.arange(7, -1, -1, dtype=np.uint64) & np.uint64(1)).astype(np.float32)


class Mixer:
    """Tables, weights and the refining map; predicts windows."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables  # per order: ascending suffixes and how often each occurs
        self.begin(np.full((GATES, len(ORDERS), KNOWN), 0.4, np.float32))
        self.map: np.ndarray | None = None  # (256 nodes, EDGES, 2) counts

    def begin(self, weights: np.ndarray) -> None:
        self.weights = weights.copy()
        self.squares = np.full(weights.shape, 1e-2, np.float32)  # of the steps so far: they grow smaller

    def inputs(self, code: np.ndarray, out_one: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretched predictions (order, window, bit), how well each is known, gates, and bits."""
        bits = _bits(code)
        x = np.empty((len(ORDERS), len(code), 8), np.float32)
        known = np.empty(x.shape, np.int8)
        longest = np.zeros(bits.shape, np.int8)
        for k in range(len(ORDERS)):
            n0, n1 = bit_counts(self.tables[k], suffixes(code, k))
            if out_one:
                n1 -= bits
                n0 -= 1 - bits
                np.maximum(n0, 0, out=n0), np.maximum(n1, 0, out=n1)
            x[k] = np.log((n1 + DELTA) / (n0 + DELTA))
            total = n0 + n1
            known[k] = np.minimum(np.frexp(total)[1] * 0.75, KNOWN - 1)
            longest = np.where(total >= 2, np.int8(k + 1), longest)
        gate = longest.astype(np.int64) * 8 + np.arange(8)
        return x, known, gate, bits

    def mixed(self, x: np.ndarray, known: np.ndarray, gate: np.ndarray) -> np.ndarray:
        dot = np.zeros(gate.shape, np.float32)
        for k in range(len(ORDERS)):
            at = (gate * len(ORDERS) + k) * KNOWN + known[k]
            dot += self.weights.ravel().take(at) * x[k]
        return np.clip(dot, -14, 14)

    def learn(self, code: np.ndarray, count: np.ndarray) -> None:
        """One online pass, window by window in small batches."""
        mean = count.mean() if len(count) else 1
        for i in range(0, len(code), BATCH):
            at = i % 65536
            if at == 0:
                slab = self.inputs(code[i : i + 65536], out_one=True)
            x, known = (a[:, at : at + BATCH] for a in slab[:2])
            gate, bits = (a[at : at + BATCH] for a in slab[2:])
            p = 1 / (1 + np.exp(-self.mixed(x, known, gate)))
            error = (bits - p) * (count[i : i + BATCH] / mean)[:, None]  # steps are bounded by their squares, however large a count
            flat_gate = gate.ravel()
            for k in range(len(ORDERS)):
                at = (flat_gate * len(ORDERS) + k) * KNOWN + known[k].ravel()
                step = np.bincount(at, (error * x[k]).ravel(), minlength=self.weights.size).reshape(self.weights.shape).astype(np.float32)
                self.squares += step * step
                self.weights += RATE * step / np.sqrt(self.squares)

    def tally(self, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Counts of the refining map."""
        out = np.zeros(256 * EDGES * 2)
        for i in range(0, len(code), 65536):
            c = code[i : i + 65536]
            x, known, gate, bits = self.inputs(c, out_one=True)
            dot = self.mixed(x, known, gate)
            low, share = self._place(dot)
            node = self._nodes(c)
            weight = np.broadcast_to(count[i : i + 65536, None], bits.shape)
            for step, part in ((0, 1 - share), (1, share)):
                at = ((node * EDGES + low + step) * 2 + bits.astype(np.int64)).ravel()
                out += np.bincount(at, (weight * part).ravel(), minlength=len(out))
        return out

    @staticmethod
    def _nodes(code: np.ndarray) -> np.ndarray:
        byte = code & np.uint64(255)
        return np.stack([(np.uint64(1 << b) | byte >> np.uint64(8 - b)).astype(np.int64) for b in range(8)], axis=1)

    @staticmethod
    def _place(dot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (dot + 14) * ((EDGES - 1) / 28)
        low = np.minimum(at.astype(np.int64), EDGES - 2)
        return low, at - low

    def refined(self, tally: np.ndarray) -> None:
        """Sets the refining map; an edge without counts keeps the mixed prediction."""
        n = tally.reshape(256, EDGES, 2)
        prior = 1 / (1 + np.exp(-np.linspace(-14, 14, EDGES)))
        self.map = ((n[..., 1] + 8 * prior) / (n.sum(axis=2) + 8)).astype(np.float32)

    def log2(self, code: np.ndarray) -> np.ndarray:
        """log2 of the probability of each window's last byte given the others."""
        out = np.empty(len(code))
        for i in range(0, len(code), 65536):
            c = code[i : i + 65536]
            x, known, gate, bits = self.inputs(c, out_one=False)
            dot = self.mixed(x, known, gate)
            p = 1 / (1 + np.exp(-dot.astype(np.float64)))
            if self.map is not None:
                low, share = self._place(dot)
                node = self._nodes(c)
                p = (p + self.map[node, low] * (1 - share) + self.map[node, low + 1] * share) / 2
            p = np.clip(p, 1e-6, 1 - 1e-6)
            out[i : i + 65536] = np.log2(np.where(bits > 0, p, 1 - p)).sum(axis=1)
        return out


# -- counting over the corpus -----------------------------------------------------------------


class _Sums:
    """Counts by key within a task, handed on when they grow too many."""

    MOST = 1 << 20

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        at, k = pd.factorize(keys)  # hashing takes half the time of sorting
        self.keys.append(k), self.counts.append(np.bincount(at, minlength=len(k)))
        self.size += len(k)
        if self.size > self.MOST:
            self._merge()

    def _merge(self) -> None:
        if len(self.keys) > 1:
            k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(self.counts), minlength=len(k)).astype(np.int64)
            self.keys, self.counts, self.size = [k], [n], len(k)

    def out(self, kind: int, flush: bool) -> Iterator[pa.RecordBatch]:
        if self.size and (flush or self.size > self.MOST):
            self._merge()
            k, n = self.keys[0], self.counts[0].astype(np.int64)
            for i in range(0, len(k), 1 << 18):
                part = slice(i, i + (1 << 18))
                kinds = np.full(len(k[part]), kind, np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(k[part].view(np.int64)), pa.array(n[part])], ["kind", "key", "n"])
            self.keys, self.counts, self.size = [], [], 0


def _count(texts: DataFrame) -> DataFrame:
    """Rows (kind, key, n, every) of texts and whether to learn from them: words (0) and windows of bytes (1), counted in training and, windows only, in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words, windows, others = WordHashes(), _Sums(), _Sums(), _Sums()
        for batch in batches:
            rows = list(zip(map(text_bytes, batch.column(0).to_pylist()), batch.column(1).to_pylist()))
            texts = [t for t, learnt in rows if learnt]
            for s in blocks(texts):
                h, _ = hashes.flat(t.lower() for t in texts[s])
                words.add(np.concatenate([h, np.full(s.stop - s.start, END_WORD, np.uint64)]))
                windows.add(byte_windows(texts[s])[0])
                yield from words.out(0, False)
                yield from windows.out(1, False)
            texts = [t for t, learnt in rows if not learnt]
            for s in blocks(texts):
                others.add(byte_windows(texts[s])[0])
                yield from others.out(2, False)
        yield from words.out(0, True)
        yield from windows.out(1, True)
        yield from others.out(2, True)

    rows = texts.mapInArrow(trimmed(run), "kind byte, key long, n long")
    learnt = F.sum(F.when(F.col("kind") < 2, F.col("n")).otherwise(0))
    return rows.groupBy(F.least("kind", F.lit(1).cast("byte")).alias("kind"), "key").agg(learnt.alias("n"), F.sum("n").alias("every"))


def packs(windows: DataFrame) -> DataFrame:
    """Rows (code, n, every): arrays of all windows that share their last three context bytes with one of the pack, well mixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            columns = [np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(3)]
            # neighbours are alike; what learns online must meet them mixed
            order = np.argsort(mix(columns[0].view(np.uint64), 7))
            yield pa.RecordBatch.from_arrays([pa.array([c[order].tobytes()], pa.binary()) for c in columns], ["code", "n", "every"])

    count = max(1, -(-windows.count() // PACK))
    context = F.shiftright("key", 8).bitwiseAND(0xFFFFFF)
    return windows.select("key", "n", "every").repartition(count, context).mapInArrow(trimmed(run), "code binary, n binary, every binary")


def second_order(windows: DataFrame) -> np.ndarray:
    """The table of order 2, gathered: two bytes of context and one more, so its size is bounded whatever the corpus."""
    rows = windows.filter("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    table = np.stack([rows["key"].to_numpy(), rows["n"].to_numpy()], axis=1).astype(np.int64)
    return table[np.argsort(table[:, 0])]


def opened(batches: Iterator[pa.RecordBatch], second: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Tables, windows, and their counts in training and over all, of each pack."""
    for b in batches:
        for row in range(b.num_rows):
            code, n, every = (np.frombuffer(b.column(i)[row].as_py(), t) for i, t in enumerate((np.uint64, np.int64, np.int64)))
            # of order 2 the part with the pack's contexts
            contexts = np.unique(code >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)
            yield [second[np.isin(second[:, 0] >> 8, contexts)], *tables(code, n, range(1, len(ORDERS)))], code, n, every


def train(rows: DataFrame, second: np.ndarray) -> Mixer:
    """Weights and refining map, without tables, of packs and the table of order 2."""
    spark = rows.sparkSession
    mixer = Mixer([])
    shared = spark.sparkContext.broadcast(second)

    def summed(rows: DataFrame, value: str) -> np.ndarray:
        """Sums arrays place by place on the executors; one row comes back."""
        parts = rows.select(F.posexplode(value).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(int(np.max(parts["i"].to_numpy())) + 1 if parts.num_rows else 0)
        if parts.num_rows:
            out[parts["i"].to_numpy()] = parts["x"].to_numpy()
        return out

    for _ in range(ROUNDS):
        start = mixer.weights

        def learn(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            mine, total = Mixer([]), np.zeros(1 + start.size)
            for mine.tables, code, n, _ in opened(batches, shared.value):
                mine.begin(start)
                mine.learn(code[n > 0], n[n > 0].astype(np.float64))
                total += float(n.sum()) * np.r_[1.0, mine.weights.astype(np.float64).ravel()]
            if total[0]:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["w"])

        sums = summed(rows.mapInArrow(trimmed(learn), "w array<double>"), "w")
        if len(sums):
            mixer.weights = (sums[1:] / sums[0]).reshape(mixer.weights.shape).astype(np.float32)
    weights = mixer.weights

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Mixer([])
        mine.weights = weights
        total = np.zeros(256 * EDGES * 2)
        for mine.tables, code, n, _ in opened(batches, shared.value):
            total += mine.tally(code[n > 0], n[n > 0].astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["t"])

    sums = summed(rows.mapInArrow(trimmed(tally), "t array<double>"), "t")
    mixer.refined(sums if len(sums) else np.zeros(256 * EDGES * 2))
    shared.destroy()
    return mixer


def predictions(rows: DataFrame, second: np.ndarray, mixer: Mixer) -> DataFrame:
    """Rows (key, every, bits): log2 of the probability of every window of packs, in training or not."""
    shared = rows.sparkSession.sparkContext.broadcast((second, mixer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mine = shared.value
        for mine.tables, code, _, every in opened(batches, table):
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(every), pa.array(mine.log2(code))], ["key", "every", "bits"])

    return rows.mapInArrow(trimmed(run), "key long, every long, bits double")


def most_frequent(values: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending windows and their predictions: all that occur at least so often that no more than ``most`` do."""
    sizes = sorted(((r["every"], r["count"]) for r in values.groupBy("every").count().collect()), reverse=True)
    least, total = None, 0
    for every, n in sizes:
        total += n
        if total > most:
            break
        least = every
    top = values.filter(F.col("every") >= least if least is not None else F.lit(False)).select("key", "bits").toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["bits"].to_numpy()[order]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted keys among ascending ones, and which are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _listed(row: np.ndarray, key: np.ndarray, rows: int) -> pa.ListArray:
    """Per row, its distinct keys and how often it has each."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]) if len(row) else np.zeros(0, np.int64)
    times = np.diff(np.r_[new, len(row)])
    pairs = pa.StructArray.from_arrays([pa.array(key[new].view(np.int64)), pa.array(times.astype(np.int32))], ["w", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[new], np.arange(rows + 1)).astype(np.int32)), pairs)


def score_texts(
    docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", frequent: int | None = None, frequent_windows: int | None = None,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``training``: a condition on the column doc_id; texts that meet it are learnt from.
    ``frequent``, ``frequent_windows``: how many words and windows are broadcast rather than
    joined (``FREQUENT``, ``FREQUENT_WINDOWS``); they change no score.
    """
    frequent = FREQUENT if frequent is None else frequent
    frequent_windows = FREQUENT_WINDOWS if frequent_windows is None else frequent_windows
    spark = docs.sparkSession
    stage = Stage(spark, "lm")
    plain = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    plain = plain.withColumn("train", training)
    counts = stage.keep(_count(plain.select("text", "train")))
    words = counts.filter("kind = 0").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    windows = counts.filter("kind = 1")
    second = second_order(windows)
    packed = stage.keep(packs(windows))
    predicted = stage.keep(predictions(packed, second, train(packed, second)))
    often_met = most_frequent(predicted, frequent_windows)
    top = words.orderBy(F.desc("n"), "key").limit(frequent).toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((often_met, keys[order], top["n"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (windows, of_window), frequent, often = shared.value
        value, of_window = np.log10(np.append(often, 0) + 0.5), np.append(of_window, 0.0)
        hashes = WordHashes()
        for batch in batches:
            texts = [text_bytes(t) for t in batch.column(3).to_pylist()]
            for s in blocks(texts):
                part = texts[s]
                code, size = byte_windows(part)
                place, distinct_codes = pd.factorize(code)
                order = np.argsort(distinct_codes)
                at, hit = _found(windows, distinct_codes[order])
                values, met = np.empty(len(order)), np.empty(len(order), bool)
                values[order], met[order] = np.where(hit, of_window[at], 0.0), hit
                bits = np.add.reduceat(values[place], np.concatenate([[0], np.cumsum(size)[:-1]]))
                # other windows and words, once per text
                far = np.flatnonzero(~met[place])
                far = _listed(np.searchsorted(np.cumsum(size), far, side="right"), code[far], len(part))
                h, n = hashes.flat(t.lower() for t in part)
                row = np.repeat(np.arange(len(part)), n)
                h, row = np.concatenate([h, np.full(len(part), END_WORD, np.uint64)]), np.concatenate([row, np.arange(len(part))])
                u, back = np.unique(h, return_inverse=True)
                at, hit = _found(frequent, u)
                known = hit[back]
                base = np.bincount(row[known], value[np.where(hit, at, -1)[back[known]]], minlength=len(part))
                n_known = np.bincount(row[known], minlength=len(part))
                rare = _listed(row[~known], h[~known], len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(s.start, len(part)) for i in range(3)), pa.array(n + 1), pa.array(n_known), pa.array(base),
                        pa.array(bits), pa.array(np.fromiter(map(len, part), np.int64, len(part))), rare, far,
                    ],
                    ["doc_id", "mark", "train", "n_tokens", "n_known", "base", "bits", "n_bytes", "rare", "far"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, mark long, train boolean, n_tokens long, n_known long, base double, bits double, n_bytes long, rare array<struct<w:long,n:int>>, far array<struct<w:long,n:int>>"
    mark = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("string"), F.col("text").isNull(), "text")
    rows = stage.keep(plain.select("doc_id", mark.alias("mark"), "train", "text").mapInArrow(trimmed(run), schema))
    # words that are not frequent: those that training has are told from the others by a join
    rare = rows.select("mark", F.explode("rare").alias("r")).select("mark", F.col("r.w").alias("key"), F.col("r.n").alias("times"))
    rare = rare.join(words, "key", "left")
    rare = rare.groupBy("mark").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_base"),
    )
    twins = rows.groupBy("mark").agg(F.count("*").alias("rows_alike"))
    rare = rare.join(twins, "mark").select("mark", (F.col("rare_known") / F.col("rows_alike")).cast("long").alias("rare_known"), (F.col("rare_base") / F.col("rows_alike")).alias("rare_base"))
    # every window of any text has a prediction
    far = rows.select("mark", F.explode("far").alias("r")).select("mark", F.col("r.w").alias("key"), F.col("r.n").alias("times"))
    far = far.join(predicted.select("key", F.col("bits").alias("each")), "key").groupBy("mark").agg(F.sum(F.col("times") * F.col("each")).alias("far_bits"))
    far = far.join(twins, "mark").select("mark", (F.col("far_bits") / F.col("rows_alike")).alias("far_bits"))
    out = rows.drop("rare", "far").join(rare, "mark", "left").join(far, "mark", "left")
    out = out.withColumn("bits", F.col("bits") + F.coalesce("far_bits", F.lit(0.0)))
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(total + 0.5 * (distinct + 1)))
    score = F.col("bits") * float(np.log10(2))
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
        (-F.col("bits") / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
