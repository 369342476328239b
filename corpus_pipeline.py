"""From raw documents to token ids: quality rules, near-dedup, secret scan, source mix, subword encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored and read again as the next one's docs. All but the
last return the columns of docs, whatever other columns these are. Empty docs give an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmine.llm import fair_mix, gbdt, mergedrop, neardup, secrets
from quillmine.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees; the others go.

    Null and empty texts have no word and go. Repeated rows share their fate. Without labels of both qualities the base rules
    alone decide.
    """
    return gbdt.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id.

    Texts without a word are one group. Of repeated rows one stays; rows without a doc_id all stay.
    """
    return neardup.distinct_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark, and n_chars as it is then.

    Null and empty texts, and texts without a find, stay as they are. Repeated rows get equal results.
    """
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: each row up to three times, by its own turn in its source's queue.

    Null texts and texts without a word are not taken. A null source is a source of its own. Ties in the queue are broken by
    the rows' digests, so reruns agree.
    """
    return fair_mix.mixed_documents(docs)


def subword_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of each document's text by seeded merge-dropout, their number and checksum, and whether they decode to the text.

    Null and empty texts have no id. Repeated rows, also those that the mix has taken again, get equal ids; null doc_ids share a key.
    """
    return mergedrop.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("subword ids", subword_ids),
]

#: Boosted trees, sketches and merge-dropout have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; a row for each document that the mix takes, as often as it takes it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
