"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from . import language_id, lm_scoring, manifest, mixing, multi_index, outliers, packing, pieces, repeats, shingle_join, token_files, toxicity, wrappers

SHARES = oracles.SHARES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    if fn.__name__ in oracles.SQL:
        ORACLES[fn.__name__] = oracles.SQL[fn.__name__]
    return fn


@query
def op1_language_id(spark, sf_dir):
    return language_id.language_id(_table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op6_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, SHARES)


@query
def op7_ngram_jaccard_join(spark, sf_dir):
    return shingle_join.shingle_join(_table(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark, sf_dir):
    return outliers.quality(_table(spark, sf_dir, "documents"))


@query
def op10_embedding_near_dedup(spark, sf_dir):
    return multi_index.near_vectors(_table(spark, sf_dir, "embeddings"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_token_files(spark, sf_dir):
    return token_files.token_files(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op8_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_scoring(_table(spark, sf_dir, "documents"))


@query
def op4_sentencepiece(spark, sf_dir):
    model = pieces.load(vocabulary("piece_bpe_32k.model"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, model, keep_ids=False).drop("text")


@query
def op5_html_extraction(spark, sf_dir):
    return wrappers.extract_pages(_table(spark, sf_dir, "pages"))


@query
def op13_merkle_manifest(spark, sf_dir):
    return manifest.manifest(_table(spark, sf_dir, "documents"))


@query
def op12_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op11_periodic_runs(spark, sf_dir):
    return repeats.summary(repeats.detect(repeats.planted(_table(spark, sf_dir, "documents"))))
