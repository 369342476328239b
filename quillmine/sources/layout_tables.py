"""Tables laid out for the keys that every route filters and joins on: folders by workspace, buckets by paper."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.sources.shelf import new_path

#: Buckets of every table, so that any two of them join bucket by bucket.
BUCKETS = 16


def laid_out(df: DataFrame, name: str, key: str, by: str | None = None, buckets: int = BUCKETS, path: str | None = None) -> str:
    """Writes df as a table in buckets by key, sorted in them, and in folders by another column; the table's name in the session's catalog.

    A bucket's rows come from one task, so that each is one file a folder: what a join on the key then needs no exchange or sort for.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    # The bucket of the writer is the hash partition of the key, by the same function.
    writer = df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", path or new_path(spark, name))
    writer = writer.bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(by) if by else writer).saveAsTable(table)
    return table


class Workspace:
    """Tables of papers, chunks, links and entities by workspace: every read names it, so other workspaces' folders are not opened."""

    def __init__(self, spark: SparkSession, papers: DataFrame, chunks: DataFrame, entities: DataFrame, links: DataFrame, buckets: int = BUCKETS):
        self.spark = spark
        spaces = papers.select(F.col("id").alias("paper_id"), "workspace_id")
        self.names = {
            "papers": laid_out(papers.withColumnRenamed("id", "paper_id"), "papers", "paper_id", "workspace_id", buckets),
            "chunks": laid_out(chunks, "chunks", "paper_id", "workspace_id", buckets),
            "links": laid_out(links.join(spaces, "paper_id"), "links", "paper_id", "workspace_id", buckets),
            "entity_links": laid_out(links.join(spaces, "paper_id"), "entity_links", "entity_id", "workspace_id", buckets),
            "entities": laid_out(entities.withColumnRenamed("id", "entity_id"), "entities", "entity_id", "workspace_id", buckets),
        }

    def table(self, name: str, workspace: str | None = None) -> DataFrame:
        t = self.spark.table(self.names[name])
        return t if workspace is None else t.where(F.col("workspace_id") == workspace)

    def _joined(self, a: str, b: str, key: str, workspace: str | None) -> DataFrame:
        """A merge join that takes both sides as they lie. Keys are of one workspace each, so the key alone joins."""
        return self.table(a, workspace).join(self.table(b, workspace).drop("workspace_id").hint("merge"), key)

    def chunk_papers(self, workspace: str | None = None) -> DataFrame:
        """Chunks with their papers (JOIN-1)."""
        return self._joined("chunks", "papers", "paper_id", workspace)

    def paper_links(self, workspace: str | None = None) -> DataFrame:
        """Links with their papers (JOIN-3)."""
        return self._joined("links", "papers", "paper_id", workspace)

    def entity_links(self, workspace: str | None = None) -> DataFrame:
        """Links with their entities (JOIN-2)."""
        return self._joined("entity_links", "entities", "entity_id", workspace)
