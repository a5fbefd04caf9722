"""Removes passages of words that recur, found by Aho-Corasick automata over words.

A window is ``width`` consecutive words of a text; it recurs if its words also start at
another place of any text. Confirming which do, over all texts:

1. Of the runs of half a window, those that are the least by hash in some window
   (minimizers, about one word in nine) are counted; equal windows have equal ones.
2. Windows whose minimizer occurs more than once are hashed and counted in full.

Each distinct recurring window has one home among its occurrences, chosen by hash: a piece,
of up to ``PIECE`` window starts, of some text. What the windows of a piece cover is a
passage, and passages are what is located:

3. Texts that have a recurring half window, and no others can hold a passage, are dealt into
   blocks, texts alike side by side as far as one block holds them; each block gets the
   distinct pieces that its texts' windows name, once each.
4. A block compiles its passages into an Aho-Corasick automaton over word numbers and
   streams its texts through it. The automaton's keys are a passage's consecutive runs of
   half a window, so it has a node for each word of a passage and not for each word of each
   window; any window holds a whole one. Around each match the words beside it are compared
   with the passage's, and where a window's length agrees these words go. Nothing else
   marks words, and a hash removes none.

Blocks are a few megabytes of text and their passages about as many, so an automaton's size
is bounded; no automaton or passage list reaches the driver, and a passage that is common
goes once to each block.

Counts are pre-aggregated and equal texts are one row with a multiplicity, so neither a
common passage nor a group of copies meets in one task. Null texts have no words. Ids are
whole numbers; others stop the job. Texts shorter than a window lose nothing. Rows that
repeat an id are rows like others. Texts are told apart, and windows counted, by 64-bit
hashes; among n windows one is taken for a recurring one by mistake with odds of about n /
2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.durable import Stage
from riskgraph.llm.words import WordHashes, blocks, free_name, mix, release, text_bytes, trimmed, windows

#: Window starts of a piece, and bytes of text that one automaton serves.
PIECE = 256
BLOCK = 2 << 20
#: Places of matches that are compared with passages together.
TOGETHER = 1 << 20


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best() of x[i : i + width]; shorter at the end."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = best(out[:-step], out[step:]) if step < len(out) else out[:-step]
        have += step
    return out


class Minimizers:
    """Hashes of windows and of the half windows that stand for them, in the texts of a block."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, width: int):
        self.half = (width + 1) // 2
        self.span = width - self.half + 1
        self.words, self.counts = hashes.flat(texts)
        self.width = width
        half, _ = windows(self.words, self.counts, self.half)
        self.half_hash = half | np.uint64(1)
        self.ends = np.cumsum(self.counts)
        left = np.repeat(self.ends, self.counts) - np.arange(len(self.words))
        self.fits = left >= width
        #: Least half-window hash of each window, 0 where no window starts.
        self.least = np.where(self.fits, _slide(self.half_hash, self.span, np.minimum), np.uint64(0))

    def chosen(self) -> np.ndarray:
        """Places of half windows that are the least of a window."""
        back = _slide(self.least[::-1], self.span, np.maximum)[::-1]
        return np.flatnonzero((back == self.half_hash) & (back > 0))

    def places(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and place within the text of flat places."""
        text = np.searchsorted(self.ends, flat, side="right")
        return text, flat - (self.ends - self.counts)[text]

    def under(self, flat: np.ndarray) -> np.ndarray:
        """Starts of the windows whose least half window is at one of the flat places."""
        starts = (flat[:, None] - np.arange(self.span)).ravel()
        want = np.repeat(self.half_hash[flat], self.span)
        ok = starts >= 0
        starts, want = starts[ok], want[ok]
        return np.unique(starts[self.least[starts] == want])


def _lists(flat: pa.Array, text: np.ndarray, n: int) -> pa.Array:
    """Per text the list of its values; ``text`` is ascending."""
    offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """Per row its digest, should it stay whole, and its minimizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = [text_bytes(t) for t in batch.column(2).to_pylist()]
            for s in blocks(texts):
                part = texts[s]
                m = Minimizers(part, hashes, width)
                at = m.chosen()
                text, place = m.places(at)
                pairs = pa.StructArray.from_arrays([pa.array(m.half_hash[at].view(np.int64)), pa.array(place.astype(np.int32))], ["h", "p"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.start, len(part)), batch.column(1).slice(s.start, len(part)), pa.array(m.counts),
                        pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in part]), _lists(pairs, text, len(part)),
                    ],
                    ["doc_id", "mark", "n_words", "sha", "halves"],
                )

    return docs.mapInArrow(trimmed(run), "doc_id long, mark long, n_words long, sha string, halves array<struct<h:long,p:int>>")


def _candidates(texts: DataFrame, width: int) -> DataFrame:
    """Rows (w, start, piece, mark, times) of the windows that a recurring half window stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            marks, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = [text_bytes(t) for t in batch.column(2).to_pylist()]
            found = batch.column(3)
            for s in blocks(texts):
                m = Minimizers(texts[s], hashes, width)
                begin = m.ends - m.counts
                lists = found.slice(s.start, s.stop - s.start)
                size = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(begin, size)
                starts = m.under(np.sort(flat))
                full, _ = windows(m.words, m.counts, width)
                text, place = m.places(starts)
                text += s.start
                piece = mix(marks[text].view(np.uint64) ^ mix((place // PIECE).astype(np.uint64), 21), 22).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full[starts].view(np.int64)), pa.array(place.astype(np.int32)), pa.array(piece), pa.array(marks[text]), pa.array(times[text])],
                    ["w", "start", "piece", "mark", "times"],
                )

    return texts.mapInArrow(trimmed(run), "w long, start int, piece long, mark long, times long")


def _blocks(texts: DataFrame, named: DataFrame) -> DataFrame:
    """Rows (mark, block) of texts that name pieces.

    Texts alike mostly name the same least piece; these come into one block, where a piece is
    wanted once for all of them. What would be too large is dealt out by the texts' hashes.
    """
    first = named.groupBy("mark").agg(F.min("home").alias("home"))
    rows = texts.select("mark", F.length("text").alias("size")).join(first, "mark")
    total = rows.agg(F.sum("size")).first()[0] or 0
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("home"), F.lit(total // BLOCK + 1)))
    parts = rows.groupBy("bucket").agg(F.ceil(F.sum("size") / (2 * BLOCK)).alias("parts"))
    return rows.join(parts, "bucket").select("mark", F.xxhash64("bucket", F.pmod(F.xxhash64("mark"), F.greatest("parts", F.lit(1)))).alias("block"))


def _passages(texts: DataFrame, width: int) -> DataFrame:
    """Rows (home, passages) of rows (text, pieces): the runs of words that the windows of a piece cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes, passages = [], []
            for text, pieces in zip(batch.column(0), batch.column(1)):
                words = text_bytes(text.as_py()).split()
                for piece in pieces.as_py():
                    starts = np.unique(np.array(piece["starts"], np.int64))
                    runs = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
                    homes.append(piece["home"]), passages.append([b" ".join(words[r[0] : r[-1] + width]) for r in runs])
            yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), pa.array(passages, pa.list_(pa.binary()))], ["home", "passages"])

    return texts.mapInArrow(trimmed(run), "home long, passages array<binary>")


class Passages:
    """An automaton over the runs of half a window of passages, and the passages behind them."""

    def __init__(self, passages: list[bytes], width: int):
        self.width, self.half = width, (width + 1) // 2
        self.beside = width - self.half  # words of a window on either side of its run, at most
        self.numbers: dict[bytes, int] = {}  # from 1; 0 is a word that no passage has
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        number = self.numbers.setdefault
        coded = [tuple([number(w, len(self.numbers) + 1) for w in p.split()]) for p in passages]
        self.flat, begin = self._line(coded, -1)
        keys: dict[tuple[int, ...], int] = {}
        key, at = [], []
        for codes, b in zip(coded, begin):
            for i in range(0, len(codes) - self.half + 1, self.half):
                k = codes[i : i + self.half]
                key.append(keys.setdefault(k, len(keys))), at.append(b + i)
        for k, number in keys.items():
            self.automaton.add_word(k, number)
        self.automaton.make_automaton()
        # the places of each key in the passages, one key after the other
        order = np.argsort(np.array(key, np.int64), kind="stable")
        self.at = np.array(at, np.int64)[order]
        self.first = np.searchsorted(np.array(key, np.int64)[order], np.arange(len(keys) + 1))

    def _line(self, coded: list[tuple[int, ...]], gap: int) -> tuple[np.ndarray, list[int]]:
        """All words on one line with gaps that nothing agrees with, and where each row begins."""
        pad = np.full(self.beside + 1, gap, np.int32)
        parts, begin, at = [pad], [], len(pad)
        for codes in coded:
            begin.append(at)
            parts += [np.fromiter(codes, np.int32, len(codes)), pad]
            at += len(codes) + len(pad)
        return np.concatenate(parts), begin

    def covered(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Which words of each text lie in a window of a passage."""
        number = self.numbers.get
        coded = [tuple([number(w, 0) for w in t]) for t in texts]
        line, begin = self._line(coded, -2)
        step = np.zeros(len(line) + 1, np.int64)
        for codes, b in zip(coded, begin):
            found = [x for pair in self.automaton.iter(codes) for x in pair] if len(self.first) > 1 else []
            found = np.fromiter(found, np.int64, len(found)).reshape(-1, 2)
            at, key = found[:, 0] + (b - self.half + 1), found[:, 1]
            times = self.first[key + 1] - self.first[key]
            upto = np.cumsum(times)
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + TOGETHER, side="right")))
                self._mark(line, at[i:j], key[i:j], times[i:j], step)
                i = j
        gone = np.cumsum(step[:-1]) > 0
        return [gone[b : b + len(codes)] for codes, b in zip(coded, begin)]

    def _mark(self, line: np.ndarray, at: np.ndarray, key: np.ndarray, times: np.ndarray, step: np.ndarray) -> None:
        """Marks what agrees with a passage around each match, where that makes a window."""
        at = np.repeat(at, times)
        there = self.at[np.repeat(self.first[key], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]
        left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for side, sign, edge in ((left, -1, 0), (right, 1, self.half - 1)):
            same = np.arange(len(at))  # matches that agree as far as looked at
            for i in range(1, self.beside + 1):
                same = same[line[at[same] + sign * i + edge] == self.flat[there[same] + sign * i + edge]]
                side[same] += 1
        hit = left + self.half + right >= self.width
        # counted per place, since many matches may begin or end at one
        for edge, sign in (((at - left)[hit], 1), ((at + self.half + right)[hit], -1)):
            place, times = np.unique(edge, return_counts=True)
            step[place] += sign * times


def _locate(texts: DataFrame, passages: DataFrame, width: int, text_out: bool) -> DataFrame:
    """Per text of rows (block, mark, text) what the automaton of its block's passages, rows (into, passages), leaves of it."""

    def block(docs: pa.Table, mine: pa.Table) -> pa.Table:
        found = Passages([p for row in mine["passages"].to_pylist() for p in row], width)
        mine = mine.slice(0, 0)
        rows = [text_bytes(t) for t in docs["text"].to_pylist()]
        removed, sha, left = [], [], []
        for s in blocks(rows, BLOCK):
            words = [r.split() for r in rows[s]]
            for ws, gone in zip(words, found.covered(words)):
                kept = b" ".join([w for w, g in zip(ws, gone.tolist()) if not g]) if not gone.all() else b""
                removed.append(int(gone.sum())), sha.append(hashlib.sha256(kept).hexdigest()), left.append(kept.decode("utf-8", "replace") if text_out else None)
        release()
        return pa.table({"mark": docs["mark"], "n_removed": pa.array(removed, pa.int64()), "kept_sha": pa.array(sha, pa.string()), "kept": pa.array(left, pa.string())})

    return texts.groupBy("block").cogroup(passages.groupBy("into")).applyInArrow(block, "mark long, n_removed long, kept_sha string, kept string")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 35, text_out: bool = False) -> DataFrame:
    """Per row: doc_id, mark (hash of its text), n_words, n_removed, kept_sha256 and, with text_out, kept.

    kept: the words that stay, joined by one space; null where the text loses none.
    """
    stage = Stage(docs.sparkSession, "passages")
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    plain = plain.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    rows = stage.keep(_scan(plain, width))
    halves = rows.select("mark", F.explode("halves").alias("x")).select("mark", F.col("x.h").alias("h"), F.col("x.p").alias("p"))
    # written first, so that the join shuffles for itself and a common phrase's rows can be split
    recurring = stage.keep(halves.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    found = stage.keep(halves.join(recurring, "h").groupBy("mark").agg(F.collect_set("p").alias("places")))
    stage.free()
    once = plain.groupBy("mark").agg(F.count("*").alias("times"), F.first("text").alias("text"))
    some = stage.keep(once.join(found, "mark").select("mark", "times", "text", "places"))
    stage.drop(found, recurring)
    seen = stage.keep(_candidates(some, width))
    again = stage.keep(seen.groupBy("w").agg(F.sum("times").alias("n"), F.min("piece").alias("home")).filter("n > 1").select("w", "home"))
    stage.free()
    # the pieces that each text names, and the starts of those that it is home to
    named = seen.join(again, "w").groupBy("mark", "home").agg(F.collect_list(F.when(F.col("piece") == F.col("home"), F.col("start"))).alias("starts"))
    named = stage.keep(named)
    stage.drop(seen, again)
    pieces = named.filter(F.size("starts") > 0).groupBy("mark").agg(F.collect_list(F.struct("home", "starts")).alias("pieces"))
    passages = stage.keep(_passages(some.join(pieces, "mark").select("text", "pieces"), width))
    block = stage.keep(_blocks(some, named))
    wanted = named.select("mark", "home").join(block, "mark").select(F.col("block").alias("into"), "home").distinct().join(passages, "home").select("into", "passages")
    texts = some.join(block, "mark").select("block", "mark", "text")
    left = stage.keep(_locate(texts, wanted, width, text_out))
    stage.drop(some, named, passages, block)
    out = rows.drop("halves").join(left, "mark", "left")
    return out.select(
        "doc_id", "mark", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"), *(["kept"] if text_out else []),
    )


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 35) -> DataFrame:
    """All rows of docs; a text that loses words becomes the rest of them, joined by one space."""
    stage = Stage(docs.sparkSession, "rest")
    found = repeated_passages(docs, doc_id, text, width, text_out=True).filter("n_removed > 0")
    mark, kept = free_name(docs.columns, "__mark"), free_name(docs.columns, "__kept")
    rest = stage.keep(found.groupBy(F.col("mark").alias(mark)).agg(F.first("kept").alias(kept)))
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))))
    out = marked.join(rest, mark, "left").withColumn(text, F.coalesce(kept, F.col(text)))
    return out.select(*docs.columns)
