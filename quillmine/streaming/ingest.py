"""Incremental ingestion: the batch transforms over a stream, and a status funnel with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.operators.chunking import chunked
from quillmine.operators.ner import concept_names, upserted


def section_stream(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """Sections (paper_id, section, text) that arrive as Parquet files."""
    return spark.readStream.schema("paper_id long, section string, text string").option("maxFilesPerTrigger", per_trigger).parquet(path)


def chunk_stream(sections: DataFrame) -> DataFrame:
    """Chunks of a stream of sections; row-local, so no state is kept."""
    return chunked(sections)


def entity_writer(path: str, workspace: str):
    """A foreachBatch function. Each batch's names go to a folder of its number, so a batch that comes twice counts once."""

    def write(batch: DataFrame, number: int) -> None:
        names = concept_names(batch.select("paper_id", F.col("content").alias("text")))
        names.withColumn("workspace_id", F.lit(workspace)).withColumn("rank", F.lit(1)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def entities_so_far(spark: SparkSession, path: str) -> DataFrame:
    """Entities of all names written: a name of a paper counts once, whatever number of its chunks came."""
    names = spark.read.parquet(path).groupBy("workspace_id", "paper_id", "type", "name").agg(F.min("rank").alias("rank"))
    return upserted(None, names)


def status_funnel(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Number and sum of events per type and window; on a stream, windows close when the watermark passes them."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
