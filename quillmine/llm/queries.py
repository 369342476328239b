"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillmine.llm import fair_mix as mix
from quillmine.llm import centroids, gbdt, licenses, mergedrop, merkle, neardup, phrases, resampling, secrets, tokenfile, warc, whitening


#: Files of public tokenizers; any path that all machines can read does.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle_fingerprints": lambda spark, d: merkle.fingerprint_edits(_docs(spark, d)),
        "op2_warc_roundtrip": lambda spark, d: warc.roundtrip(_table(spark, d, "pages")),
        "op3_order_minhash": lambda spark, d: neardup.near_duplicates(_docs(spark, d)),
        "op4_range_coded_tokens": lambda spark, d: tokenfile.tokens(_docs(spark, d), BYTE_BPE),
        "op5_importance_resampling": lambda spark, d: resampling.resample(_docs(spark, d), _table(spark, d, "labels")),
        "op6_phrase_automata": lambda spark, d: phrases.remove_repeats(_docs(spark, d)),
        "op7_boosted_quality": lambda spark, d: gbdt.quality(_docs(spark, d), _table(spark, d, "labels")),
        "op8_randomness_secrets": lambda spark, d: secrets.scan(_docs(spark, d)),
        "op9_merge_dropout": lambda spark, d: mergedrop.encoded(_docs(spark, d), PIECE_BPE),
        "op10_fair_mix": lambda spark, d: mix.fair_mix(_docs(spark, d)),
        "op11_elkan_clusters": lambda spark, d: centroids.centroid_clusters(_table(spark, d, "embeddings")),
        "op12_whitening": lambda spark, d: whitening.whitened(_table(spark, d, "embeddings")),
        "op13_license_scan": lambda spark, d: licenses.licenses(_docs(spark, d)),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_merkle_fingerprints": merkle.ORACLE, "op2_warc_roundtrip": warc.ORACLE, "op10_fair_mix": mix.ORACLE, "op11_elkan_clusters": centroids.oracle(), "op13_license_scan": licenses.oracle()}
