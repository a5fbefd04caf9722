"""Operators use all they counted, at every size."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgraph.llm import langid_crf, lm_mixing, substring_dedup


def test_lm_has_the_counts_of_every_context(spark, monkeypatch):
    monkeypatch.setattr(lm_mixing, "PACK", 3000)
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 300).astype(np.uint8).tobytes() for _ in range(40)]
    df = spark.createDataFrame([(t.decode(), i % 4 > 0) for i, t in enumerate(texts)], "text string, train boolean")
    windows = lm_mixing._count(df).filter("kind = 1")
    seen = Counter(c for i, t in enumerate(texts) if i % 4 for c in lm_mixing.byte_windows([t])[0].tolist())
    second, packed = lm_mixing.second_order(windows), lm_mixing.packs(windows).toArrow()
    assert packed.num_rows > 2
    codes = set()
    for tables, code, n, every in lm_mixing.opened(packed.to_batches(), second):
        codes |= set(code.tolist())
        assert n.tolist() == [seen[c] for c in code.tolist()] and (every >= np.maximum(n, 1)).all()
        for k, order in enumerate(lm_mixing.ORDERS):
            counts = Counter()
            for c, times in seen.items():
                for b in range(8):
                    counts[(c & (1 << 8 * (order + 1)) - 1) >> 7 - b, b] += times
            n0, n1 = lm_mixing.bit_counts(tables[k], lm_mixing.suffixes(code[:300], k))
            for i, c in enumerate(code[:300].tolist()):
                path = [(c & (1 << 8 * (order + 1)) - 1) >> 7 - b for b in range(8)]
                assert n0[i].tolist() == [counts[p & ~1, b] for b, p in enumerate(path)]
                assert n1[i].tolist() == [counts[p | 1, b] for b, p in enumerate(path)]
    assert codes == {c for t in texts for c in lm_mixing.byte_windows([t])[0].tolist()}


def test_lm_scores_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    texts = [f"text {i * i} of words {i % 7} " * (i % 5) for i in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (59, texts[59]), (60, None)], "doc_id long, text string").coalesce(1)
    training = F.col("doc_id") % 3 > 0

    def scores():
        return sorted((r["doc_id"], r["score"]) for r in lm_mixing.score_texts(df, training).collect())

    whole = scores()
    monkeypatch.setattr(lm_mixing, "FREQUENT_WINDOWS", 40)
    part = scores()
    assert [i for i, _ in part] == [i for i, _ in whole]
    assert [v for _, v in part] == pytest.approx([v for _, v in whole])


def test_every_language_is_fitted_on_as_many_rows_as_it_has(spark, monkeypatch):
    got = {}
    monkeypatch.setattr(langid_crf, "fit", lambda spans, languages, lexicon: got.update(zip(languages, map(len, spans))))
    rows = [(f"w{i} a b", "hot") for i in range(20_000)] + [(f"v{i} c d", "rare") for i in range(300)] + [(f"u{i} e f", "middle") for i in range(450)]
    rows += [("same text here", "copies")] * 900  # one span each
    langid_crf.train(spark.createDataFrame(rows, "text string, lang string"), F.lit(True))
    assert got == {"copies": 400, "hot": 400, "middle": 400, "rare": 300}


def test_passages_are_located_by_the_automaton():
    rng = np.random.default_rng(9)
    for width in (5, 8):
        passages = [b" ".join(b"%d" % x for x in rng.integers(0, 4, n)) for n in (width, width + 3, 40)] + [b"7 " * 30]
        texts = [[b"%d" % x for x in rng.integers(0, 4, n)] for n in (0, 3, 200, 400)] + [passages[2].split()[7:], [b"7"] * 50, [b"7"] * (width - 1)]
        windows = {tuple(p.split()[i : i + width]) for p in passages for i in range(len(p.split()) - width + 1)}
        found = substring_dedup.Passages(passages, width)
        for t, got in zip(texts, found.covered(texts)):
            want = np.zeros(len(t), bool)
            for i in range(len(t) - width + 1):
                if tuple(t[i : i + width]) in windows:
                    want[i : i + width] = True
            assert got.tolist() == want.tolist()
        nothing = substring_dedup.Passages([], width)
        assert not any(g.any() for g in nothing.covered(texts))


def test_repeated_passages_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 4000)  # many blocks; on the driver alone, where they are counted
    rng = np.random.default_rng(10)
    make = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    long, passage = make(700_000), make(300)
    rows = [(1, long), (2, long), (3, passage + " " + make(50)), (4, make(50) + " " + " ".join(passage.split()[100:200]) + " x"), (5, " ".join(long.split()[-40:])), (6, make(80))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 700_000, 2: 700_000, 3: 100, 4: 100, 5: 40, 6: 0}


def test_lm_counts_of_rare_words(spark):
    """With next to nothing broadcast, words meet their counts in the join; rows alike, and null ids, too."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 50, i % 9))) for i in range(40)]
    rows += [rows[7], rows[7], (None, "5"), (5, None), (None, None), (1, "never seen elsewhere")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    training = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    few, all_ = (sorted(map(tuple, lm_mixing.score_texts(df, training, **k).collect()), key=str) for k in ({"frequent": 2, "frequent_windows": 5}, {}))
    counts = Counter(w for i, t in rows if (i or 0) % 3 != 1 for w in [*(t or "").split(), None])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        words = [*(t or "").split(), None]
        want.append((i, (i or 0) % 3 == 1, len(words), sum(w in counts for w in words), total, sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)))
    for got in (few, all_):
        assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=str)]
        assert sorted(g[5] for g in got) == pytest.approx(sorted(w[5] for w in want))
    assert [g[6] for g in few] == pytest.approx([g[6] for g in all_])


def test_lm_weights_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_mixing, "PACK", 2000)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    try:
        got = []
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m" if n == "3" else "4k")
            got.append([r["score"] for r in lm_mixing.score_texts(df.repartition(int(n)), F.col("doc_id") % 4 != 1).orderBy("doc_id").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == pytest.approx(got[1], rel=1e-5)
