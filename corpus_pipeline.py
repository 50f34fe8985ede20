"""The corpus pipeline: five stages over ``documents``, each written and read again.

toxicity > language ID > n-gram Jaccard join > mixing > SentencePiece.

Every stage works on all rows that its predecessor kept, whatever their
number.  All but the last return the columns of ``documents``; extra columns
of the input are not carried along.  Rows that repeat stay rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritally.llm import language_id, mixing, pieces, shingle_join, toxicity
from veritally.llm.common import stored
from veritally.llm.queries import SHARES, vocabulary

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the multiple-instance model predicts as toxic.

    Learns from all labelled documents; NULL and empty texts are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*DOCUMENT), weights).where("predicted = 0").select(*DOCUMENT)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that no language's model explains: those beyond
    the calibrated limits, and NULL, empty and letterless texts."""
    models = language_id.fit(docs)
    return language_id.identify(docs.select(*DOCUMENT), models).where("NOT rejected").select(*DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Texts without words are near copies of nothing and stay.  A NULL doc_id is
    kept unless its text is a near copy of another document's.  Rows that
    repeat doc_id and text are one document; rows that share a doc_id but not
    the text are kept or dropped together.
    """
    groups = shingle_join.shingle_join(docs.select("doc_id", "text"))
    kept = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    once = docs.select(*DOCUMENT).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    repeat = F.when(words, F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return once.withColumn("repeat", repeat).dropDuplicates(["doc_id", "text", "repeat"]).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files whose order interleaves the sources by their shares."""
    return mixing.in_order(mixing.mix(docs.select(*DOCUMENT), SHARES)).select(*DOCUMENT)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_ids, ids, ids_crc32, round_trip, decoded_crc32`` per document."""
    model = pieces.load(vocabulary("piece_bpe_32k.model"))
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"), model).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unknown_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]
# Stages decide by trained models, which SQL cannot express; tests compare run() with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
