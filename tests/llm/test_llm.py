"""Corpus operators against brute force on small tables with awkward rows."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from riskgraph.llm import ann_tree, langid_crf, lm_mixing, mixing, near_dedup, quality, sentencepiece_codec, substring_dedup, topk_search, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, LONG + " tail one", "en", "a"), (2, "head two " + LONG, "en", "a"), (3, None, None, None), (4, "", "en", None), (5, "  \n\t ", "fr", "b"),
    (6, "One two", "fr", "b"), (7, "one TWO", "fr", "b"), (8, LONG, "en", "a"), (8, LONG, "en", "a"), (None, "un texte étranger ▁ \U0001f389", "fr", "b"),
    (10, "x" * 3000, "en", "c"), (11, " ".join(["again"] * 200), "en", "c"), (12, "  two  spaces\n\nlines \x00", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names the operators use themselves
    return spark.createDataFrame(TEXTS, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).withColumn("mark", F.lit("m")).withColumn("node", F.lit(0)).withColumn("__text", F.lit("t")).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")


def words(text):
    return (text or "").encode().split()


def test_encoding_equals_library(spark, docs):
    raw, lib = sentencepiece_codec.read_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = sentencepiece_codec.encode_column(docs, raw, digests=True)
    for r in out.collect():
        want = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == want and r["decoded"] == lib.decode(want) and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    again = sentencepiece_codec.decode_column(out.drop("decoded"), raw)
    assert again.join(out.select("ids", F.col("decoded").alias("d")), "ids").filter("decoded <> d").count() == 0
    assert sentencepiece_codec.encode_column(empty(spark), raw).count() == 0


@pytest.mark.parametrize("text", ["▁" * 9 + "a", " " * 700, "ab" * 900, "\r\n\r\n  x", "\U0001d518" * 40, "a ▁b"])
def test_odd_texts_encode_as_the_library(text):
    model = sentencepiece_codec.PieceModel(sentencepiece_codec.read_model(MODEL))
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sentencepiece_codec.Encoder(model).encode([text])[0]
    want = lib.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(got, "<u4").tolist() == want and model.decode(got).decode() == lib.decode(want)


def crc(value):
    return zlib.crc32(("" if value is None else str(value)).encode())


def test_scores(spark, docs):
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    got = lm_mixing.score_texts(docs, training).collect()
    counts = {}
    for i, t, *_ in TEXTS:
        if crc(i) % 5 != 1:
            for w in [*words((t or "").lower()), None]:
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    want = {}
    for i, t, *_ in TEXTS:
        w = [*words((t or "").lower()), None]
        want[i] = (crc(i) % 5 == 1, len(w), sum(x in counts for x in w), sum(math.log10((counts.get(x, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for x in w))
    assert len(got) == len(TEXTS)
    for r in got:
        held, n, known, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert lm_mixing.score_texts(empty(spark), F.lit(True)).count() == 0


def test_model_is_a_probability():
    mixer = lm_mixing.Mixer([np.zeros((1 << b, 3), np.uint16) for b in lm_mixing.SLOT_BITS])
    mixer.refined(np.zeros(256 * lm_mixing.EDGES * 2))
    context = np.uint64(0x6162636465) << np.uint64(8)
    p = 2 ** mixer.log2(context | np.arange(256, dtype=np.uint64))
    assert p.sum() == pytest.approx(1, abs=1e-6)


def shingles(text, n):
    w = words((text or "").lower())
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in rng.integers(0, 5000, 120)]
    rows = [(i, " ".join(b if rng.random() > rate else f"e{rng.integers(9999)}" for b in base)) for i, rate in enumerate(np.linspace(0, 0.12, 60))]
    rows += [(100, None), (101, ""), (102, "a b"), (103, "A  b"), (104, "b a"), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("comp", F.lit(1)).withColumn("n", F.lit("x"))
    sets = [shingles(t, 3) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (least.get(r), i) != (None, None) else None
    want = sorted(((i, len(s), least[r]) for (i, _), r, s in zip(rows, root, sets)), key=str)
    got = near_dedup.near_duplicates(df, width=3, percent=85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    one = near_dedup.one_of_each(df, width=3, percent=85)
    assert one.count() == len({r for r, s in zip(root, sets) if s}) + 2
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_exact_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(200)] + [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [0.0] * 8), (304, [1.0, 2.0]), (None, [0.5] * 8)]
    rows += [(i, rows[0][1]) for i in range(400, 460)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)).withColumn("score", F.lit("s"))
    got = topk_search.exact_top_k(df, F.col("vec_id") % 20 == 0, k=5, block_rows=64).collect()
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v and len(v) == 8 and None not in v and not np.isnan(v).any()]
    want = []
    for q, x in good:
        if q is not None and q % 20 == 0:
            s = sorted((-int(x @ y), i if i is not None else 10**9) for i, y in good if i != q)[:5]
            want += [(q, k + 1, None if i == 10**9 else i, -n) for k, (n, i) in enumerate(s)]
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), key=str) == sorted(want, key=str)
    assert topk_search.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit(1))
    got = ann_tree.nearest(df, F.col("vec_id") % 50 == 0, k=5, leaf_rows=32, cell_rows=20).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -2
        mine = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in sorted(mine, key=lambda r: -r["score"])] == [1, 2, 3, 4, 5]
        assert all(r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-12) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 60
    assert ann_tree.nearest(df.limit(0), F.lit(True)).count() == 0
    # ties and repeated rows: the smaller id first, every row a candidate
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in (50, 7, 3, 3, 9, 8)] + [(None, [1.0, 2.0]), (60, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann_tree.nearest(same, F.col("vec_id") == 50, k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 3, 7, 8, 9] and len({r["score"] for r in got}) == 1


def test_recall_of_a_tree_that_is_not_searched_whole(spark):
    """Clustered vectors, so that few leaves hold a query's neighbours."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.25 * rng.normal(size=(4000, 16))).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    tree = ann_tree.Tree(u, 64)
    most = tree.calibrated(u, 5, 0.97)
    assert most < tree.leaves / 2
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann_tree.nearest(df, F.col("vec_id") % 50 == 0, k=5, leaf_rows=64).toPandas()
    hits = 0
    for q in range(0, 4000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(got[got.query_id == q].vec_id) & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * 80


def test_archives(spark, tmp_path):
    rows = [(1, "http://a\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "u", "WARC/1.0\r\n\r\n" * 50), (6, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("z"))
    warc.register(spark)
    records = warc.archive_records(pages, "page_id", "url", "html")
    for kind in ("gzip", "none"):
        path = str(tmp_path / kind)
        records.write.format("warc").option("compression", kind).option("fileBytes", 1000).mode("append").save(path)
        assert max(len(list(tmp_path.glob(f"{kind}/*-{task:05d}-*"))) for task in range(8)) > 1  # cut at fileBytes
        read = spark.read.format("warc").option("partitionBytes", 1).load(path)
        assert read.rdd.getNumPartitions() == len(list(tmp_path.glob(f"{kind}/*.warc*")))
        got = {r["page_id"]: r for r in warc.archived_pages(read).collect()}
        assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), None: ("revisit", 1), 5: ("response", None), 6: ("response", None)}
        assert got[6]["payload_bytes"] == 3_000_000 and got[2]["payload_bytes"] == 8 and got[2]["payload_digest"] == got[1]["payload_digest"]
        some = read.filter("warc_type = 'revisit' and record_id like '<urn:page:2%'")
        assert some.count() == 1 and read.filter(F.col("content_length") > 100).select("record_id").count() == 2
        assert spark.read.format("warc").option("payload", "false").load(path).filter("payload is not null").count() == 0
    records.limit(0).write.format("warc").mode("append").save(str(tmp_path / "empty"))
    assert spark.read.format("warc").load(str(tmp_path / "empty")).count() == 0


def test_mix(spark, docs):
    many = spark.createDataFrame([(i, " ".join(f"s{i % 5}" for _ in range(50 + i)), "en", f"s{i % 5}" if i % 5 < 3 else None) for i in range(300)], SCHEMA)
    mix = mixing.Mix(many, block_words=16, shard_slots=64)
    got = mix.documents().collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got) and len(got) == 300
    by = {}
    for r in got:
        t = by.setdefault(r["source_size"], [r["target"], 0])
        t[1] += r["taken"]
    assert all(abs(n - t) <= 0.03 * t + 32 for t, n in by.values())
    assert sorted(map(tuple, mixing.Mix(many, block_words=16, shard_slots=64).documents().collect())) == sorted(map(tuple, got))
    counted = {r["doc_id"]: r["n"] for r in mix.texts().groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert all(counted.get(r["doc_id"], 0) == r["taken"] for r in got)
    odd = mixing.Mix(docs).documents().collect()
    assert sorted((r["size"] for r in odd)) == sorted(len(words(t)) for _, t, *_ in TEXTS)
    assert mixing.Mix(empty(spark)).documents().count() == 0


def test_archives_of_others(spark, tmp_path):
    warc.register(spark)
    record = lambda kind, body, n: f"WARC/1.1\r\nwarc-type: {kind}\r\nWARC-RECORD-ID: <urn:x:{n}>\r\nX-Long: a\r\n b\r\ncontent-length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record("response", "hello", 1) + record("revisit", "", 2) + record("response", "WARC/1.0\r\n\r\n", 3)).encode())
    got = sorted(spark.read.format("warc").load(str(tmp_path)).collect(), key=lambda r: r["record_id"])
    assert [(r["warc_type"], r["content_length"], bytes(r["payload"])) for r in got] == [("response", 5, b"hello"), ("revisit", 0, b""), ("response", 12, b"WARC/1.0\r\n\r\n")]
    assert got[0]["headers"]["X-Long"] == "a b"
    calls = []

    class Counted(warc._Bytes):
        def read(self, n):
            calls.append(n)
            return super().read(n)

    def read(kind):
        reader = warc.WarcReader({"path": str(tmp_path)}, spark.read.format("warc").load(str(tmp_path)).schema)
        assert list(reader.pushFilters([warc.EqualTo(("warc_type",), kind)])) == []
        return [r["record_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    before, warc._Bytes = warc._Bytes, Counted
    try:
        assert read("response") == ["<urn:x:1>", "<urn:x:3>"] and calls == [5, 12]
        assert read("revisit") == ["<urn:x:2>"] and calls == [5, 12, 0]
    finally:
        warc._Bytes = before
    for bad in (b"WARC/1.0\r\nWARC-Type: response\r\n\r\nhello\r\n\r\n", b"no archive\r\n\r\n", b"WARC/1.0\r\nContent-Length: 5\r\n\r\nhel", b"WARC/1.0\r\nContent-"):
        (tmp_path / "b.warc").write_bytes(bad)
        with pytest.raises((ValueError, EOFError)):
            read("response")
    (tmp_path / "b.warc").unlink()
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    out = warc.archive_records(pages, "page_id", "url", "html").write.format("warc").mode("append")
    out.option("date", "2024-01-02T03:04:05Z").save(str(tmp_path / "dated"))
    assert spark.read.format("warc").load(str(tmp_path / "dated")).first()["headers"]["WARC-Date"] == "2024-01-02T03:04:05Z"


@pytest.mark.parametrize("first", ["a", "b"])
def test_mix_of_twins_across_sources(spark, first):
    sides = ["a", "b"] if first == "a" else ["b", "a"]
    rows = [(i, " ".join(f"t{i}" for _ in range(30)), f"x{k}", s) for i in range(40) for s in sides for k in range(1 + (i % 4 == 0))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    mix = mixing.Mix(df, block_words=8, shard_slots=32, run=2, task_slots=50)
    total = mix.documents().agg(F.sum("taken")).first()[0]
    by = {r["source"]: r["n"] for r in mix.texts().groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    took = dict(mix.rows.select("sid", "at", "size").join(mix._pieces().groupBy("sid", "at").agg(F.sum(F.col("words") * F.col("times")).alias("n")), ["sid", "at"]).groupBy("sid").agg(F.sum("n")).collect())
    assert by == {"a": took[0], "b": took[1]} and took[1] > took[0] and total == sum(by.values())
    again = mixing.Mix(df.repartition(3), block_words=8, shard_slots=32, run=2, task_slots=50).texts()
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, mix.texts().collect()), key=str)


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("b", 10), ("a", 1000), ("c", 500), (None, 5), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    left, full = 1515.0, {}
    weights = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    size = {"b": 10, "a": 1000, "c": 500, None: 5, "d": 0}
    while True:
        w = sum(v for k, v in weights.items() if k not in full)
        over = {k: 3 * size[k] for k, v in weights.items() if k not in full and left * v / w > 3 * size[k]}
        if not over:
            break
        full |= over
        left = 1515.0 - sum(full.values())
    for k, v in weights.items():
        assert got[k] == pytest.approx(full.get(k, left * v / w))


def test_language(spark):
    tongues = {"en": "the of and to in that was with for this from", "de": "der die und das nicht mit ein zu auf ist von", "fr": "le la les des est une dans pour que qui avec"}
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        g = list(tongues)[i % 3]
        rows.append((i, " ".join(rng.choice(tongues[g].split(), 30)), g))
    rows += [(900, None, "en"), (901, "123 !!! \n", "en"), (902, "", None), (None, "der die das und nicht", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(7)).withColumn("text_", F.lit(1))
    field = langid_crf.train(df, F.col("doc_id") < 200)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid_crf.predict(df, field).collect()}
    assert np.mean([got[i][0] == g for i, _, g in rows[200:240]]) == 1
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[None][0] == "de" and 0 <= got[None][1] <= 1
    labeller = langid_crf.Labeller(field)
    gamma, _, _ = labeller.words([b"the of and to that der die und das nicht"])
    names = [field.languages[k] for k in gamma.argmax(axis=1)]
    assert names[:4] == ["en"] * 4 and names[-4:] == ["de"] * 4 and np.allclose(gamma.sum(axis=1), 1)
    nothing = langid_crf.predict(df, langid_crf.train(df.limit(0), F.lit(True)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, a = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    gamma, _, _ = langid_crf.Chains(np.array([4])).posteriors(e, a)
    total, want = 0.0, np.zeros((4, 2))
    for code in range(16):
        y = [code >> i & 1 for i in range(4)]
        p = math.exp(sum(e[i, y[i]] for i in range(4)) + sum(a[y[i], y[i + 1]] for i in range(3)))
        total += p
        for i in range(4):
            want[i, y[i]] += p
    assert np.allclose(gamma, want / total)


def test_quality(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 4 == 0, i % 7 == 0
        text = " ".join(f"w{n}" for n in rng.integers(0, 60, 40)) + (" idiot" if toxic else "")
        rows.append((i, " | ".join(text.split()).upper() if bad else text, "en", f"s{i % 3}"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None, None, None), (901, "", "en", "s1")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).withColumn("keep", F.lit("k"))
    known = spark.createDataFrame([r for r in labels if r[0] < 400] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, known).collect()}
    assert np.mean([got[i]["keep"] == (i % 4 != 0 and i % 7 != 0) for i in range(400, 600)]) > 0.97
    assert len(got) == 602 and all(0 <= r["quality_score"] <= 1 for r in got.values())
    assert all(r["keep"] for r in quality.classify(df, known.limit(0)).collect())
    assert quality.classify(df.limit(0), known).count() == 0


def kept_words(rows, width):
    seen, lists = {}, [words(t) for _, t, *_ in rows]
    for w in lists:
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])] = seen.get(tuple(w[i : i + width]), 0) + 1
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_repeated_passages(spark, docs):
    want = kept_words(TEXTS, 35)
    got = substring_dedup.repeated_passages(docs, width=35).collect()
    expect = sorted(((i, len(words(t)), len(words(t)) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for (i, t, *_), k in zip(TEXTS, want)), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == expect
    left = substring_dedup.without_repeats(docs, width=35)
    assert left.columns == docs.columns and left.count() == len(TEXTS)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"r{n}" for n in rng.integers(0, 3, rng.integers(0, 60)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_passages(df, width=5).collect()}
    assert got == {i: len(words(t)) - len(k) for (i, t), k in zip(rows, kept_words(rows, 5))}
    assert substring_dedup.repeated_passages(empty(spark)).count() == 0


def test_near_rows_are_one_for_a_node_and_task(spark):
    # two sets of 25 nodes, each node under 30 keys with its whole set
    signs = [bytes(80 - 2) + i.to_bytes(2, "little") if i < 25 else bytes([1]) * 78 + i.to_bytes(2, "little") for i in range(50)]
    nodes = spark.createDataFrame([(i, signs[i], 100) for i in range(50)], "node long, sig binary, n long")
    mixed = spark.createDataFrame([(k, i, i, 0, False, 100) for k in range(30) for i in range(50)], "key long, node long, comp long, main long, done boolean, n long")
    rows = near_dedup._alike(mixed, nodes, 85, 19).collect()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(rows) <= 50 * tasks
    assert {r["u"] for r in rows if r["open"]} == set(range(50)) - {0}
    assert {(r["u"], r["v"]) for r in rows} == {(i, i // 25 * 25) for i in range(50)}
