"""Queries opN_<name>: each applies one operator, with production settings, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.llm import ann_tree, langid_crf, lm_mixing, mixing, near_dedup, quality, sentencepiece_codec, substring_dedup, topk_search, warc
from riskgraph.durable import Stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    model = sentencepiece_codec.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    docs = _table(spark, sf_dir, "documents")
    return sentencepiece_codec.encode_column(docs, model, keep=["doc_id"], ids=None, decoded=None, digests=True)


def _remainder(of: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a unigram and a context-mixing model."""
    return lm_mixing.score_texts(_table(spark, sf_dir, "documents"), _remainder(5) != 1)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles overlap by 85 of 100 or more."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), x AS (
  SELECT doc_id, unnest(s) AS g FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id AND l.b > r.root
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.root AS component_id, s.doc_id = m.root AS kept
FROM s JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) m USING (doc_id)
"""


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector with all others."""
    return topk_search.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC records, revisits for repeated payloads, and reads the archives back."""
    warc.register(spark)
    path = Stage(spark, "warc").base
    warc.archive_records(_table(spark, sf_dir, "pages"), "page_id", "url", "html").write.format("warc").mode("append").save(path)
    pages = warc.archived_pages(spark.read.format("warc").load(path))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
), d AS (
  SELECT *, sha1(body) AS h FROM p
), b AS (
  SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, (5 * i + 1)::INT, 5))::INT) AS v FROM d
)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(v, lambda x:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix to weights 1, 2, 3 takes of each document, at most three times its size."""
    return mixing.Mix(_table(spark, sf_dir, "documents")).documents()


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five near neighbours by cosine of every fiftieth vector."""
    return ann_tree.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    field = langid_crf.train(docs, _remainder(4) != 2)
    out = langid_crf.predict(docs, field, columns=["doc_id"])
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores for quality and toxicity of every document, and whether it is kept."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), columns=["doc_id"])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents keep when every passage of 35 words that recurs is removed."""
    out = substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w
), h AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM p
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM h) WHERE n > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r
), k AS (
  SELECT doc_id, count(*) AS n, list(j) AS j FROM c GROUP BY 1
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w.w, lambda x, i: k.j IS NULL OR NOT list_contains(k.j, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_lm, op3_near_dedup, op4_topk, op5_warc, op6_mixing, op7_ann, op8_langid, op9_quality, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": OP3_SQL, "op4_topk": OP4_SQL, "op5_warc": OP5_SQL, "op10_substring_dedup": OP10_SQL}
