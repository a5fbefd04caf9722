"""Documents to encoded training text: quality, near-dedup, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept. All
but the last return the columns of documents; n_chars follows the text. The tables are
written and read again between stages, so a lost executor costs no more than one stage.

An empty table passes through all stages as one. Ids are whole numbers or null. Columns
beside those of documents stay, whatever their names, up to the encoding, which returns
columns of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.llm import mixing, near_dedup, quality, sentencepiece_codec, substring_dedup
from riskgraph.durable import Stage


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps: of quality and not toxic.

    A null text is judged as an empty one; without labels all stay. Rows that repeat are
    judged alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).filter("keep").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group alike by five-word shingles.

    Texts null, empty or without words are alike with nothing and stay, each row. Of rows that
    repeat an id in a group one stays, that of the least hash of its text.
    """
    return near_dedup.one_of_each(docs, width=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words that recur anywhere, the first place included.

    A null text stays null, and one that loses nothing stays as it is; all rows stay.
    """
    return _measured(substring_dedup.without_repeats(docs, width=35))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each pass over it.

    Rows without words, nulls among them, take nothing and have no row. A null source is a
    source. Rows that repeat are mixed each for itself.
    """
    return _measured(mixing.Mix(docs).texts())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, and digests of them and of the text they decode to; a null text is an empty one."""
    model = sentencepiece_codec.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_codec.encode_column(docs, model, keep=["doc_id", "lang", "source"], decoded=None, digests=True)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


STAGES = [
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: No SQL for run(): fitted classifiers, pseudorandom permutations and token ids are not its matter.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other on the documents table."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage.keep(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
