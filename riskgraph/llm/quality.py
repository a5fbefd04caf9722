"""Quality by co-training: a text view and a metadata view teach each other.

Two questions are learnt from labels: is the text of quality, and is it toxic. The text
view sees which of ``words`` selected words and word marks (trailing signs, capitals) a
text has, and its layout (lines, shares of kinds of signs, repetition); the metadata view
sees length, stated length, language and source, and nothing of the text's content. Each
view is a logistic classifier.

In every round both views score all unlabelled documents, on the executors. Of those that a
view is sure of (by its calibrated probability) the ``taught`` most certain ones of each
answer become labels for the other view, which is then fitted again with them; where many
are equally certain, a hash chooses. In the end both views are calibrated on labelled rows
kept aside, a fifth of each answer's, and their calibrated log odds are combined by a third
logistic fit on these rows.

The classifiers are fitted on the driver on at most ``labelled`` labelled documents, picked
by a hash of the id, and what the views teach; words are selected on the same labelled
documents. What the views see of a document is worked out once, over its whole text, and
kept as a fixed number of bytes beside its columns.

Nulls: a null text is an empty one; null language, source and length are values of their
own; label rows with a null are left out, and of repeated ones the least quality and the
greatest toxicity count. Of documents that repeat a labelled id one is learnt from, that of
the least hash; all are scored. With labels of one answer only, that answer is given
throughout; an answer with one label is both fitted and calibrated on it; labels of no
document at all keep every document, as do no labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.durable import Stage
from riskgraph.llm.words import WordHashes, blocks, free_name, text_bytes, trimmed

SIGNS = b".,;:!?*#$%&|()[]{}<>\"'`~^_=+-/\\@"
_BINS = 16
#: Log odds are counted in so many steps from -30 to 30.
_STEPS = 600
LAYOUT, METADATA = 9, 4 + 2 * _BINS


def word_features(text: bytes, hashes: WordHashes) -> set[int]:
    """Hashes of the distinct lower-cased words without signs, and of marks."""
    out = set()
    for w in set(text.split()):
        core = w.strip(SIGNS)
        if core:
            out.add(hashes[core.lower()])
            if len(core) > 3 and core.isupper():
                out.add(hashes[b"\x00upper"])
        if len(core) < len(w) and (tail := w[len(w.rstrip(SIGNS)) :]):
            out.add(hashes[b"\x00tail " + tail[:4]])
    return out


def layout_features(text: bytes) -> tuple[float, ...]:
    """Lines, shares of kinds of signs, and repetition."""
    n = max(1, len(text))
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = text.count(b"\n") + 1
    again = 1 - len(set(words)) / max(1, len(words))
    return (
        np.log1p(len(words)), np.log1p(lines), len(words) / lines / 50, kinds[65:91].sum() / n * 5, kinds[48:58].sum() / n * 5,
        kinds[list(SIGNS)].sum() / n * 5, kinds[124] / n * 20, again, len(text) / max(1, len(words)) / 10,
    )


def metadata_features(n_bytes: int, n_chars: int | None, lang: str | None, source: str | None) -> np.ndarray:
    """Lengths, and language and source in hashed bins."""
    out = np.zeros(METADATA, np.float32)
    stated = n_chars if n_chars is not None and n_chars > 0 else 0
    out[:4] = np.log1p(n_bytes), np.log1p(stated), n_chars is None, np.log1p(abs(n_bytes - stated))
    out[4 + zlib.crc32(repr(lang).encode()) % _BINS] = 1
    out[4 + _BINS + zlib.crc32(repr(source).encode()) % _BINS] = 1
    return out


class Views:
    """What both views see of some documents: words (0 or 1), layout, and metadata."""

    def __init__(self, seen: np.ndarray, layout: np.ndarray, meta: np.ndarray):
        self.seen, self.layout, self.meta = seen, layout, meta

    def __len__(self) -> int:
        return len(self.seen)

    def at(self, rows) -> "Views":
        return Views(self.seen[rows], self.layout[rows], self.meta[rows])

    def x(self, view: int) -> np.ndarray:
        """A new matrix of a view's inputs."""
        return self.meta.copy() if view else np.concatenate([self.seen, self.layout], axis=1, dtype=np.float32)

    @classmethod
    def of(cls, texts: list[bytes], chars: list, langs: list, sources: list, words: dict[int, int], hashes: WordHashes) -> "Views":
        seen = np.zeros((len(texts), max(1, len(words))), np.uint8)
        for i, t in enumerate(texts):
            seen[i, [words[h] for h in word_features(t, hashes) if h in words]] = 1
        layout = np.array([layout_features(t) for t in texts], np.float32).reshape(-1, LAYOUT)
        meta = [metadata_features(len(t), *row) for t, *row in zip(texts, chars, langs, sources)]
        return cls(seen, layout, np.array(meta, np.float32).reshape(-1, METADATA))

    def packed(self) -> tuple[pa.Array, pa.Array]:
        numbers = np.concatenate([self.layout, self.meta], axis=1)
        return pa.array([r.tobytes() for r in np.packbits(self.seen, axis=1)], pa.binary()), pa.array([r.tobytes() for r in numbers], pa.binary())

    @classmethod
    def unpacked(cls, seen, numbers, width: int) -> "Views":
        bits = np.frombuffer(b"".join(seen.to_pylist()), np.uint8).reshape(len(seen), -(-width // 8))
        rest = np.frombuffer(b"".join(numbers.to_pylist()), np.float32).reshape(len(seen), LAYOUT + METADATA)
        return cls(np.unpackbits(bits, axis=1)[:, :width], rest[:, :LAYOUT], rest[:, LAYOUT:])


class Logistic:
    """Logistic classifier by Adam on the mean loss with a small ridge; inputs from ``first`` on are scaled."""

    def __init__(self, width: int, first: int | None = None):
        self.w, self.b = np.zeros(width, np.float32), 0.0
        self.first = width if first is None else first
        self.shift, self.scale = np.zeros(width - self.first, np.float32), np.ones(width - self.first, np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> "Logistic":
        """Changes x, which is of float32 and may be wide."""
        if len(self.shift):
            self.shift, self.scale = x[:, self.first :].mean(axis=0), np.maximum(x[:, self.first :].std(axis=0), 1e-3)
        self._scaled(x)
        weight, y = (weight / weight.sum()).astype(np.float32), y.astype(np.float32)
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for t in range(1, steps + 1):
            error = (1 / (1 + np.exp(-np.clip(x @ self.w + np.float32(self.b), -30, 30))) - y) * weight
            g = np.append(error @ x + ridge * self.w, error.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w -= step[:-1].astype(np.float32)
            self.b -= float(step[-1])
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        x[:, self.first :] -= self.shift
        x[:, self.first :] /= self.scale
        return x

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Changes x, too."""
        return np.clip(self._scaled(x) @ self.w + self.b, -30, 30)


class Question:
    """Both views' classifiers for one yes-or-no label, and how they are combined."""

    def __init__(self, constant: float | None = None):
        self.constant = constant

    def fit(self, views: Views, y: np.ndarray, taught: list[tuple[Views, np.ndarray] | None]) -> "Question":
        """``taught``: for each view what the other one has labelled, if it has."""
        aside = np.zeros(len(y), bool)
        fitted = np.ones(len(y), bool)
        for answer in (0, 1):
            at = np.flatnonzero(y == answer)
            aside[at[::5]] = True
            fitted[at[::5]] = len(at) < 2
        held = views.at(aside)
        self.models, self.scales = [], []
        for v in (0, 1):
            x, labels, weight = views.at(fitted).x(v), y[fitted], np.ones(fitted.sum())
            if taught[v] is not None:
                more, guess = taught[v]
                x = np.concatenate([x, more.x(v)])
                labels, weight = np.r_[labels, guess], np.r_[weight, np.full(len(guess), 0.5)]
            self.models.append(Logistic(x.shape[1], 0 if v else views.seen.shape[1]).fit(x, labels, weight))
            self.scales.append(Logistic(1).fit(self.models[v].odds(held.x(v))[:, None].astype(np.float32), y[aside], np.ones(aside.sum()), ridge=1e-3))
        both = np.stack([self.sure(v, held) for v in (0, 1)], axis=1).astype(np.float32)
        self.top = Logistic(2)
        self.top.w[:] = 0.5
        self.top.fit(both, y[aside], np.ones(aside.sum()), ridge=1e-3)
        return self

    def sure(self, v: int, views: Views) -> np.ndarray:
        """Calibrated log odds of a view."""
        return self.scales[v].odds(self.models[v].odds(views.x(v))[:, None].astype(np.float32))

    def probability(self, views: Views) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(views), self.constant)
        both = np.stack([self.sure(v, views) for v in (0, 1)], axis=1).astype(np.float32)
        return 1 / (1 + np.exp(-self.top.odds(both)))


class Table:
    """All documents, with the named columns and what the views see; answers where a document is a labelled one of the sample."""

    def __init__(self, docs: DataFrame, labels: DataFrame, columns: list[str], labelled: int, words: int):
        spark = docs.sparkSession
        self.stage = Stage(spark, "quality")
        self.columns = columns
        self.names = {n: free_name(docs.columns, f"__{n}") for n in ("id", "text", "n_chars", "lang", "source", "quality", "toxic", "lot", "seen", "numbers", "key")}
        name = self.names
        known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"), labels["toxic"].cast("int").alias("toxic")).dropna()
        known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        sample = known.orderBy(F.xxhash64(F.lit(31), "doc_id"), "doc_id").limit(labelled).toArrow()
        self.answers = {i: (q, t) for i, q, t in zip(*(sample[c].to_pylist() for c in ("doc_id", "quality", "toxic")))}
        if not self.answers:
            return
        chosen = spark.createDataFrame([(i, *a) for i, a in self.answers.items()], f"`{name['key']}` long, `{name['quality']}` int, `{name['toxic']}` int")
        kinds = {"text": "string", "n_chars": "long", "lang": "string", "source": "string"}
        plain = [(docs[c] if c in docs.columns else F.lit(None)).cast(k).alias(name[c]) for c, k in kinds.items()]
        rows = docs.select(*[docs[c] for c in columns], docs["doc_id"].cast("long").alias(name["id"]), *plain)
        rows = rows.withColumn(name["lot"], F.xxhash64(F.lit(32), name["id"], name["text"])).join(F.broadcast(chosen), F.col(name["id"]) == F.col(name["key"]), "left").drop(name["key"])
        self.words = self._selected(rows.filter(F.col(name["quality"]).isNotNull()).select(*(name[c] for c in ("text", "quality", "toxic"))), words)
        self.width = max(1, len(self.words))
        self.rows = self.stage.keep(self._seen(rows))

    def _selected(self, rows: DataFrame, most: int) -> dict[int, int]:
        """The words that tell most about either answer, and their places."""

        def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                for text, q, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                    h = np.fromiter(word_features(text_bytes(text), hashes), np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), q, np.int32)), pa.array(np.full(len(h), t, np.int32))], ["h", "q", "t"])

        counts = rows.mapInArrow(trimmed(distinct_words), "h long, q int, t int").groupBy("h").agg(F.count("*").alias("n"), F.sum("q").alias("q"), F.sum("t").alias("t"))
        counts = self.stage.keep(counts.filter(F.col("n") >= 5))
        total = len(self.answers)
        quality, toxic = (sum(a[i] for a in self.answers.values()) for i in (0, 1))

        def gain(yes: str, share: float):
            # chi-square of having the word against the answer, for words
            expected = F.col("n") * share
            return (F.col(yes) - expected) ** 2 / F.greatest(expected * (1 - share) * (1 - F.col("n") / total), F.lit(1e-6))

        picked: list[int] = []
        for yes, share in (("q", quality / total), ("t", toxic / total)):
            if 0 < share < 1:
                picked += [r["h"] for r in counts.orderBy(gain(yes, share).desc(), "h").limit(most // 2).collect()]
        return {h & 0xFFFFFFFFFFFFFFFF: i for i, h in enumerate(dict.fromkeys(picked))}

    def _seen(self, rows: DataFrame) -> DataFrame:
        words, kept = self.words, self.columns + [self.names[c] for c in ("id", "lot", "quality", "toxic")]
        fields = [rows.schema[c] for c in kept] + [T.StructField(self.names[c], T.BinaryType()) for c in ("seen", "numbers")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                texts = [text_bytes(t) for t in b.column(len(kept)).to_pylist()]
                for s in blocks(texts):
                    for i in range(s.start, s.stop, 256):
                        part = slice(i, min(i + 256, s.stop))
                        others = (b.column(len(kept) + c).slice(i, part.stop - i).to_pylist() for c in (1, 2, 3))
                        views = Views.of(texts[part], *others, words, hashes)
                        yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, part.stop - i) for c in range(len(kept))), *views.packed()], [f.name for f in fields])

        return rows.select(*kept, *(self.names[c] for c in ("text", "n_chars", "lang", "source"))).mapInArrow(trimmed(run), T.StructType(fields))

    def _columns(self, rows: DataFrame, *names: str) -> DataFrame:
        return rows.select(*(F.col(self.names[n]).alias(n) for n in names))

    def labelled(self) -> tuple[list, Views]:
        """Ids and views of the labelled documents, one of each id, in a mixed order that is the same in every run."""
        rows = self._columns(self.rows.filter(F.col(self.names["quality"]).isNotNull()), "id", "lot", "seen", "numbers")
        rows = rows.groupBy("id").agg(F.min(F.struct("lot", "seen", "numbers")).alias("r")).select("id", "r.*").toArrow()
        ids = rows["id"].to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (zlib.crc32(str(ids[k]).encode()), ids[k]))
        views = Views.unpacked(rows["seen"], rows["numbers"], self.width)
        return [ids[k] for k in order], views.at(order)

    def most_certain(self, questions: list[Question], most: int, sure: float) -> list[list[tuple[Views, np.ndarray] | None]]:
        """For each question and each view, what the other view is most certain of among all unlabelled documents."""
        spark, width = self.rows.sparkSession, self.width
        rows = self._columns(self.rows.filter(F.col(self.names["quality"]).isNull()), "lot", "seen", "numbers")
        asked = [(q, v) for q in (0, 1) if questions[q].constant is None for v in (0, 1)]
        shared = spark.sparkContext.broadcast(questions)
        bar = float(np.log(sure / (1 - sure)))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    part = b.slice(i, 1024)
                    views = Views.unpacked(part.column(1), part.column(2), width)
                    yield part, [shared.value[q].sure(v, views) for q, v in asked]

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(asked), _STEPS), np.int64)
            for _, odds in scored(batches):
                for k, o in enumerate(odds):
                    total[k] += np.bincount(_step(o), minlength=_STEPS)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["n"])

        sums = rows.mapInArrow(trimmed(counted), "n array<long>").select(F.posexplode("n").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        count = np.zeros(len(asked) * _STEPS, np.int64)
        count[sums["i"].to_numpy()] = sums["n"].to_numpy()
        # per view and answer: how far from even odds, and which share of those beyond
        limits = []
        for n in count.reshape(-1, _STEPS):
            for up in (False, True):
                beyond = np.cumsum(n[::-1] if up else n)
                far = int(np.searchsorted(beyond, most)) if beyond[-1] >= most else _STEPS - 1
                far = min(far, int(_step(np.array([-bar]))[0]))
                limits.append((far, min(1.0, 1.2 * most / max(1, beyond[far]))))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, odds in scored(batches):
                lot = (part.column(0).to_numpy().view(np.uint64) >> np.uint64(11)) / float(1 << 53)
                for k, o in enumerate(odds):
                    for up in (0, 1):
                        far, share = limits[2 * k + up]
                        step = _step(o)
                        at = np.flatnonzero(((_STEPS - 1 - step if up else step) <= far) & ((o > 0) == up) & (lot <= share))
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2 * k + up, np.int32)), *(part.column(c).take(pa.array(at)) for c in range(3))], ["of", "lot", "seen", "numbers"])

        found = rows.mapInArrow(trimmed(chosen), "of int, lot long, seen binary, numbers binary")
        first = W.partitionBy("of").orderBy(F.xxhash64("lot"), "seen", "numbers")
        found = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most).drop("rank").toArrow()
        shared.destroy()
        of = found["of"].to_numpy()
        views = Views.unpacked(found["seen"], found["numbers"], width)
        out: list[list[tuple[Views, np.ndarray] | None]] = [[None, None], [None, None]]
        for k, (q, v) in enumerate(asked):
            at = np.flatnonzero(of // 2 == k)
            if len(at):
                out[q][1 - v] = (views.at(at), (of[at] % 2).astype(float))
        return out


def _step(odds: np.ndarray) -> np.ndarray:
    return np.minimum(((odds + 30) * (_STEPS / 60)).astype(np.int64), _STEPS - 1)


def train(table: Table, rounds: int = 3, taught: int = 1000, sure: float = 0.98) -> list[Question]:
    """The two questions (quality, toxic)."""
    ids, views = table.labelled()
    y = [np.array([table.answers[d][i] for d in ids], float) for i in (0, 1)]
    fixed = [Question(float(y[i][0]) if len(y[i]) else 1.0 - i) if len(set(y[i])) < 2 else None for i in (0, 1)]
    given: list[list] = [[None, None], [None, None]]
    for r in range(rounds):
        questions = [fixed[i] or Question().fit(views, y[i], given[i]) for i in (0, 1)]
        if all(fixed) or r == rounds - 1:
            break
        given = table.most_certain(questions, taught, sure)
    return questions


def classify(
    docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, labelled: int = 20_000, words: int = 1024, rounds: int = 3, taught: int = 1000, sure: float = 0.98
) -> DataFrame:
    """All rows of docs, with the named columns (all by default), quality_score, toxic_score and keep.

    keep: quality_score of 0.5 or more and toxic_score below 0.5. The new columns take the
    place of columns of the same names. ``labelled``: labelled documents that are fitted on,
    at most; ``taught``: documents that a view hands on in a round, for each answer;
    ``sure``: the calibrated probability from which it does.
    """
    new = ["quality_score", "toxic_score", "keep"]
    kept = [c for c in (docs.columns if columns is None else columns) if c not in new]
    table = Table(docs, labels, kept, labelled, words)
    if not table.answers:
        return docs.select(*[docs[c] for c in kept], F.lit(1.0).alias("quality_score"), F.lit(0.0).alias("toxic_score"), F.lit(True).alias("keep"))
    shared, width = docs.sparkSession.sparkContext.broadcast(train(table, rounds, taught, sure)), table.width
    fields = [table.rows.schema[c] for c in kept] + [T.StructField(n, T.BooleanType() if n == "keep" else T.DoubleType()) for n in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                views = Views.unpacked(part.column(len(kept)), part.column(len(kept) + 1), width)
                q, t = (question.probability(views) for question in shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(kept))), pa.array(q.astype(float)), pa.array(t.astype(float)), pa.array((q >= 0.5) & (t < 0.5))], [f.name for f in fields])

    return table.rows.select(*kept, table.names["seen"], table.names["numbers"]).mapInArrow(trimmed(run), T.StructType(fields))
