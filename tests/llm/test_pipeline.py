"""The pipeline's stages against brute force, each on its own input."""

import os
import sys

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from test_llm import MODEL, kept_words, shingles, words  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    make = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    passage = make(45)
    rows = [(i, make(60), "en", f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0") for i in range(5)]
    rows += [(300 + i, make(20) + " " + passage + " " + make(20), "en", "s1") for i in range(4)]
    rows += [(400 + i, make(40).upper().replace(" ", "!! "), "en", "s2") for i in range(60)]
    rows += [(500, None, None, None), (501, "", "en", "s3")]
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    known = [(i, 1, 0) for i in range(120)] + [(400 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append(docs.collect())
    kept = {r["doc_id"] for r in steps[0]}
    assert set(range(120)) <= kept and not kept & set(range(400, 460))
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in steps[0]}
    want = {i for i in sets if not any(j < i and sets[i] and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]) for j in sets)}
    assert {r["doc_id"] for r in steps[1]} == want
    rows = [(r["doc_id"], r["text"]) for r in steps[1]]
    for (i, t), k in zip(rows, kept_words(rows, 35)):
        got = next(r["text"] for r in steps[2] if r["doc_id"] == i)
        assert words(got) == k and (got == t or len(k) < len(words(t)))
    sizes = {r["doc_id"]: len(words(r["text"])) for r in steps[2]}
    taken = {}
    for r in steps[3]:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(words(r["text"]))
    assert all(n <= 3 * sizes[i] for i, n in taken.items()) and abs(sum(taken.values()) - sum(sizes.values())) < 0.05 * sum(sizes.values())
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sorted(r["ids"] for r in steps[4]) == sorted(lib.encode(r["text"] or "", add_bos=True, add_eos=True) for r in steps[3])


def test_run_is_all_stages(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 0


def test_stages_take_nothing_and_clashing_columns(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    clash = {n: F.lit("x") for n in ("mark", "node", "keep", "runs", "__mark", "__size", "block", "into", "home", "sid", "__seen", "component_id")}
    for start in (docs.limit(0), docs.filter("doc_id < 40 or doc_id > 290")):
        rows = start.withColumns(clash)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{start.count()}-{k}"
            stage(spark, rows, tables).write.parquet(path)
            rows = spark.read.parquet(path)
            if k < 4:
                assert set(docs.columns) <= set(rows.columns)
        assert (rows.count() > 0) == (start.count() > 0)
