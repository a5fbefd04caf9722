"""Language of texts by a linear-chain conditional random field over their words.

A word's features are its byte n-grams and affixes (n-grams that touch a word's end, up to
four bytes), hashed, and a lexicon: for frequent words of each language how the word is
shared among languages. Weights and transitions are learnt from spans of labelled texts
put together to code-switched sequences, by gradients from forward-backward. A text's
words are labelled by their posteriors, again by forward-backward over the whole text; its
language has the greatest sum of posteriors, its score is the share of that sum.

The lexicon counts all training texts and has as many words of every language: its most
frequent ones, ``lexicon`` of them, or an equal share of ``16 * lexicon`` if there are more
than 16 languages. The field is fitted on the driver: of ``fit_rows`` training rows of each
language, those of the least hashes, the whole texts are cut into spans, of which the
``fit_spans`` of the least hashes are taken. Prediction reads the text alone.

Nulls: a null text has no letter; texts without a letter are ``und`` with score 0, as are
all texts if nothing was learnt. Rows without a language, or whose id is outside of the
training condition, are not learnt from. Words without letters neither carry evidence nor
count. Texts of any length are read whole; ties go to the language first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.durable import Stage
from riskgraph.llm.words import WordHashes, blocks, free_name, text_bytes, trimmed

BUCKETS = 1 << 16
SPAN_WORDS = 16
SEQUENCE_SPANS = 6
STEPS = 60
#: Languages that a model may have; they are gathered on the driver.
MOST_LANGUAGES = 1000
REMEMBERED = 300_000
#: Bytes of text whose words are labelled together; each word takes a few hundred bytes then.
LABEL_BYTES = 1 << 20


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words, one after the other, and the word of each."""
    flat = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in words]), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
    buckets, owner = [], []
    code = flat.copy()
    for n in range(2, 6):
        code = (code[:-1] << np.uint64(8)) | flat[n - 1 :] if len(flat) >= n else code[:0]
        ok = left[: len(code)] >= n
        if n == 5:  # affixes only
            ok &= (flat[: len(code)] == 2) | (flat[n - 1 :] == 3)
        at = np.flatnonzero(ok)
        h = (code[at] + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        buckets.append((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64))
        owner.append(word[at])
    buckets, owner = np.concatenate(buckets), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return buckets[order], owner[order]


class Field:
    """Weights, transitions and lexicon for a list of languages."""

    def __init__(self, languages: list[str], lexicon: dict[int, np.ndarray]):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((BUCKETS, n))
        self.lex = 0.5
        self.moves = np.full((n, n), 0.0) + 2.0 * np.eye(n)

    def lexical(self, words: list[bytes], hashes: WordHashes) -> np.ndarray:
        zero = np.zeros(len(self.languages))
        return np.stack([self.lexicon.get(hashes[w], zero) for w in words]) if words else np.zeros((0, len(self.languages)))

    def evidence(self, words: list[bytes], hashes: WordHashes) -> np.ndarray:
        """Log evidence of each lower-cased word for each language."""
        bucket, owner = word_features(words)
        first = np.searchsorted(owner, np.arange(len(words)))
        return np.add.reduceat(self.weights[bucket], first, axis=0) + self.lex * self.lexical(words, hashes)


class Chains:
    """Sequences side by side, longest first, so that a step takes a place of all that reach it."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max() if len(sizes) else 0), side="right")
        offset = np.concatenate([[0], np.cumsum(self.active)])
        self.slices = [slice(a, b) for a, b in zip(offset[:-1].tolist(), offset[1:].tolist())]
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        seq = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(seq)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        #: Where each word of the sequences, one after the other, lies by steps.
        self.at = offset[place] + rank[seq]

    def posteriors(self, evidence: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """Posterior of each word (in the sequences' order), expected moves, log likelihood's norm."""
        n = evidence.shape[1]
        steps = np.empty_like(evidence)
        steps[self.at] = evidence
        top = steps.max(axis=1, keepdims=True)
        e = np.exp(steps - top)
        a = np.exp(moves)
        alpha = np.empty_like(e)
        norm = float(top.sum())
        for t, s in enumerate(self.slices):
            x = e[s] if t == 0 else (alpha[self.slices[t - 1]][: s.stop - s.start] @ a) * e[s]
            total = x.sum(axis=1, keepdims=True)
            np.divide(x, total, out=alpha[s])
            if pairs:
                norm += float(np.log(total).sum())
        expected = np.zeros((n, n))
        beta = np.empty((0, n))
        for t in range(len(self.slices) - 1, -1, -1):
            s = self.slices[t]
            mine = np.ones((s.stop - s.start, n))
            if len(beta):
                nxt = beta * e[self.slices[t + 1]]
                back = nxt @ a.T
                total = back.sum(axis=1, keepdims=True)
                mine[: len(beta)] = back / total
                if pairs:
                    joint = alpha[s][: len(beta)]
                    z = np.einsum("ij,jk,ik->i", joint, a, nxt)
                    expected += a * ((joint / z[:, None]).T @ nxt)
            beta = mine
            both = alpha[s] * mine
            steps[s] = both / both.sum(axis=1, keepdims=True)
        return steps[self.at], expected, norm


def fit(spans: list[list[list[bytes]]], languages: list[str], lexicon: dict[int, np.ndarray], seed: int = 5) -> Field:
    """A field of spans of words, given by language."""
    rng = np.random.default_rng(seed)
    field = Field(languages, lexicon)
    n = len(languages)
    if n < 2:
        return field
    # as many words of each language, put together in random order
    most = max(map(len, spans))
    picks = [(k, s) for k in range(n) for s in ((spans[k] * (most // len(spans[k]) + 1))[:most] if spans[k] else [])]
    picks = [picks[i] for i in rng.permutation(len(picks))]
    seqs = [picks[i : i + SEQUENCE_SPANS] for i in range(0, len(picks), SEQUENCE_SPANS)]
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for q in seqs for _, s in q for w in s])
    labels = np.array([k for q in seqs for k, s in q for _ in s])
    sizes = np.array([sum(len(s) for _, s in q) for q in seqs])
    seq = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(seq[1:] == seq[:-1])
    seen_moves = np.zeros((n, n))
    np.add.at(seen_moves, (labels[inside], labels[inside + 1]), 1)
    distinct = list(number)
    bucket, owner = word_features(distinct)
    first = np.searchsorted(owner, np.arange(len(distinct)))
    lexical = field.lexical(distinct, WordHashes())
    used, bucket = np.unique(bucket, return_inverse=True)
    weights = np.zeros((len(used), n))
    chains = Chains(sizes)
    seen = np.zeros((len(distinct), n))
    np.add.at(seen, (words, labels), 1)
    state = {k: [0.0, 0.0] for k in ("w", "m", "l")}

    def step(name: str, gradient, t: int, rate: float):
        s = state[name]
        s[0] = 0.9 * s[0] + 0.1 * gradient
        s[1] = 0.99 * s[1] + 0.01 * gradient * gradient
        return rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.99**t)) + 1e-8)

    total = len(words)
    for t in range(1, STEPS + 1):
        ev = np.add.reduceat(weights[bucket], first, axis=0) + field.lex * lexical
        gamma, expected, _ = chains.posteriors(ev[words], field.moves, pairs=True)
        mean = np.stack([np.bincount(words, gamma[:, k], minlength=len(distinct)) for k in range(n)], axis=1)
        error = (seen - mean) / total
        spread = error[owner]
        g = np.stack([np.bincount(bucket, spread[:, k], minlength=len(used)) for k in range(n)], axis=1)
        weights += step("w", g - 1e-6 * weights, t, 0.08)
        field.moves = field.moves + step("m", (seen_moves - expected) / total, t, 0.1)
        field.lex += float(step("l", float((error * lexical).sum()), t, 0.05))
    field.weights[used] = weights
    return field


def _count(rows: DataFrame) -> DataFrame:
    """Rows (lang, h, n): how often each language's texts have each lower-cased word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                for i in range(0, len(h), 1 << 17):
                    s = slice(i, i + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h[s])), pa.array(h[s].view(np.int64)), pa.array(n[s])], ["lang", "h", "n"])
            held.clear()

        for batch in batches:
            texts = [text_bytes(t, lower=True) for t in batch.column(0).to_pylist()]
            langs = batch.column(1).to_pylist()
            for s in blocks(texts):
                by: dict[str, list[bytes]] = {}
                for t, lang in zip(texts[s], langs[s]):
                    by.setdefault(lang, []).append(t)
                for lang, some in by.items():
                    h, n = np.unique(hashes.flat(some)[0], return_counts=True)
                    held.setdefault(lang, []).append((h, n))
                    size += len(h)
                if size > 1 << 20:
                    yield from out()
                    size = 0
        yield from out()

    return rows.mapInArrow(trimmed(run), "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))


def _spans(rows: DataFrame) -> DataFrame:
    """Rows (lang, at, span): whole texts cut into spans of 4 to ``SPAN_WORDS`` words, and the last of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text_bytes(t, lower=True).split()
                sizes = 4 + np.random.default_rng(len(words)).integers(0, SPAN_WORDS - 3, len(words) // 4 + 1)
                starts = [0, *np.cumsum(sizes).tolist()]
                spans = [b" ".join(words[a:b]) for a, b in zip(starts, starts[1:]) if a < len(words)]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(spans), pa.string()), pa.array(range(len(spans)), pa.int64()), pa.array(spans, pa.binary())], ["lang", "at", "span"])

    return rows.mapInArrow(trimmed(run), "lang string, at long, span binary")


def _fit_rows(rows: DataFrame, most: int) -> DataFrame:
    """Rows (text, lang) to fit on: ``most`` of each language, or all it has where it has fewer.

    Each language is filtered by its own share first, so few of its rows are ranked; where
    that leaves fewer than ``most`` of more, all rows of the language are ranked.
    """
    span = 1 << 30
    pick = F.pmod(F.xxhash64(F.lit(8), "text"), F.lit(span))
    counted = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    limits = {g: span if n <= 2 * most else int(span * 2 * most / n) for g, n in counted.items()}

    def below(of: dict[str, int]) -> DataFrame:
        bounds = rows.sparkSession.createDataFrame(list(of.items()), "lang string, most long")
        return rows.withColumn("pick", pick).join(F.broadcast(bounds), "lang").filter("pick < most")

    got = {r["lang"]: r["count"] for r in below(limits).groupBy("lang").count().collect()}
    for g, n in counted.items():
        if got.get(g, 0) < min(most, n):  # many copies of one text share a hash
            limits[g] = span
    ranked = below(limits).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("pick", "text")))
    return ranked.filter(F.col("rank") <= most).select("text", "lang")


def _lexicon(rows: DataFrame, languages: list[str], most: int) -> dict[int, np.ndarray]:
    """For the most frequent words of each language, how they are shared among all languages."""
    counts = Stage(rows.sparkSession, "langid").keep(_count(rows))
    each = max(1, min(most, 16 * most // len(languages)))
    # the count from which a language has enough words, of how many words have each count; few rows are ranked then
    often = counts.groupBy("lang", F.col("n").alias("least")).agg(F.count("*").alias("words"))
    upto = Window.partitionBy("lang").orderBy(F.desc("least")).rowsBetween(Window.unboundedPreceding, -1)
    often = often.withColumn("above", F.coalesce(F.sum("words").over(upto), F.lit(0))).filter(F.col("above") < each).groupBy("lang").agg(F.min("least").alias("least"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "h")
    frequent = counts.join(F.broadcast(often), "lang").filter("n >= least")  # a row for each language
    chosen = frequent.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= each).select("h").distinct()
    got = counts.join(chosen, "h", "left_semi").toArrow()
    number = {g: i for i, g in enumerate(languages)}
    keys, at = np.unique(got["h"].to_numpy(), return_inverse=True)
    shares = np.full((len(keys), len(languages)), 0.5)
    np.add.at(shares, (at, np.array([number[g] for g in got["lang"].to_pylist()], int)), got["n"].to_numpy())
    logs = np.log(shares / shares.sum(axis=1, keepdims=True))
    return dict(zip(keys.view(np.uint64).tolist(), logs - logs.mean(axis=1, keepdims=True)))


def train(
    docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", lexicon: int = 4000, fit_rows: int = 400, fit_spans: int = 2400, most_languages: int = MOST_LANGUAGES
) -> Field | None:
    """A field learnt from the rows that meet the condition and have a language and a text.

    More than ``most_languages`` languages are an error.
    """
    rows = docs.filter(training).select(docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).dropna()
    languages = sorted((r[0] for r in rows.select("lang").distinct().limit(most_languages + 1).collect()), key=lambda v: v.encode())
    if not languages:
        return None
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    words = _lexicon(rows, languages, lexicon)
    number = {g: i for i, g in enumerate(languages)}
    # as many rows of every language, those of the least hashes of their texts
    first = Window.partitionBy("lang").orderBy(F.xxhash64("span", "at"), "span")
    cut = _spans(_fit_rows(rows, fit_rows)).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= fit_spans)
    spans: list[list[list[bytes]]] = [[] for _ in languages]
    for r in cut.orderBy("lang", "rank").select("lang", "span").collect():
        if w := bytes(r["span"]).split():
            spans[number[r["lang"]]].append(w)
    return fit(spans, languages, words)


class Labeller:
    """Posteriors of the words of whole texts; remembers evidence of words, up to a bound."""

    def __init__(self, field: Field):
        self.field, self.hashes = field, WordHashes()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(self.field.languages)))
        self.lettered = np.zeros(1024, bool)

    def _learn(self, words: list[bytes]) -> None:
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            at = len(self.known)
            while at + len(some) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.lettered = np.concatenate([self.lettered, np.zeros_like(self.lettered)])
            letters = np.array([any(map(str.isalpha, w.decode("utf-8", "replace"))) for w in some])
            self.table[at : at + len(some)] = self.field.evidence(some, self.hashes) * letters[:, None]
            self.lettered[at : at + len(some)] = letters
            self.known.update(zip(some, range(at, at + len(some))))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors of all words of lower-cased texts, which words have letters, words per text."""
        if len(self.known) > REMEMBERED:
            self._forget()
        rows = [t.split() for t in texts]
        flat = [w for r in rows for w in r]
        self._learn(flat)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        if not len(flat):
            return np.zeros((0, len(self.field.languages))), np.zeros(0, bool), sizes
        gamma, _, _ = Chains(sizes).posteriors(self.table[at], self.field.moves)
        return gamma, self.lettered[at], sizes

    def texts(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each lower-cased text."""
        gamma, lettered, sizes = self.words(texts)
        owner = np.repeat(np.arange(len(texts)), sizes)[lettered]
        sums = np.stack([np.bincount(owner, g, minlength=len(texts)) for g in gamma[lettered].T], axis=1)
        total = sums.sum(axis=1)
        best = sums.argmax(axis=1)
        score = np.where(total > 0, sums[np.arange(len(texts)), best] / np.maximum(total, 1e-300), 0.0)
        return [self.field.languages[b] if t > 0 else "und" for b, t in zip(best, total)], np.clip(score, 0, 1)


def predict(docs: DataFrame, field: Field | None, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """All rows with the named columns (all by default), lang_pred and score."""
    new = ["lang_pred", "score"]
    kept = [c for c in (docs.columns if columns is None else columns) if c not in new]
    fields = [docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    source = docs.select(*[docs[c] for c in kept], docs[text].cast("string").alias(free_name(docs.columns, "__text")))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value else None
        for batch in batches:
            texts = [text_bytes(t, lower=True) for t in batch.column(len(kept)).to_pylist()]
            langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            # texts of like length side by side: a step along them then moves many at once
            order = np.argsort(np.fromiter(map(len, texts), np.int64, len(texts)), kind="stable")
            texts = [texts[i] for i in order]
            for s in blocks(texts, LABEL_BYTES) if labeller else ():
                langs[order[s]], scores[order[s]] = labeller.texts(texts[s])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(langs, pa.string()), pa.array(scores)], [f.name for f in fields])

    return source.mapInArrow(trimmed(run), T.StructType(fields))
