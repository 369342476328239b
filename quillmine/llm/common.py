"""Helpers that the training-data operators share: shared storage, distributed order statistics, row hygiene."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, in every contract of this subpackage: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; set here only where unset and all is one process)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmine-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, column: str, buckets: int) -> list:
    """At most buckets-1 ascending cut values that deal the column's values out evenly. Only these go to the driver."""
    if buckets < 2:
        return []
    cuts = df.approxQuantile(column, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    return sorted(set(cuts))


def range_bucket(column: Column, bounds: list) -> Column:
    """Number of bounds below the value; nulls go to bucket 0. Two levels, so the cost is the root of the number of bounds."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    value = column.cast("double")
    firsts = F.array(*[F.lit(float(g[0])) for g in groups])
    nested = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in groups])
    coarse = F.size(F.filter(firsts, lambda b: b < value))
    fine = F.size(F.filter(F.get(nested, coarse - 1), lambda b: b < value))
    return F.when(column.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * step + fine)


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Inclusive running sum of value within group by (bucket, order).

    Sums per bucket come first, so no task holds more than one bucket, however hot the group is. The group and bucket
    columns must not be null.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("qm_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, bucket, F.coalesce(F.sum("qm_sum").over(before), F.lit(0)).alias("qm_off"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(offsets, [*group, bucket])
        .withColumn(out, F.col("qm_off") + F.sum(value).over(inside))
        .drop("qm_off")
    )


def least_hashed(df: DataFrame, rows: int) -> DataFrame:
    """The rows of df with the smallest hashes of doc_id, so many at most: a sample that doesn't depend on partitions.

    A bound on the hash, from the number of rows, leaves about twice as many, so tasks send few to the driver. Columns other
    than doc_id break ties.
    """
    n = df.count()
    hashed = df.withColumn("qm_hash", F.xxhash64("doc_id"))
    if n > 2 * rows:
        few = hashed.where(F.col("qm_hash") <= -(1 << 63) + (1 << 64) * 2 * rows // n)
        hashed = few if few.count() >= rows else hashed
    return hashed.orderBy("qm_hash", "doc_id", F.xxhash64(*[c for c in df.columns if c != "doc_id"])).limit(rows).drop("qm_hash")


def hot_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", share: int = 2000, counted: DataFrame | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """left joined to right, which has a row per key at most, however many rows of left share a key.

    Keys with a share-th of left's rows or more (so at most that many keys, the bound of what is broadcast) are spread
    over salts on the left, and their rows on the right are repeated for each salt. No row is dropped. counted, if given,
    has the keys of left's rows and is cheaper to count. counts, if given, has the number qm_n of left's rows of each key
    that right has, as far as known; then only these are counted. Rows with a null key match nothing and are dealt out.
    """
    counted = left if counted is None else counted
    total = counted.count() if counts is None else counts.agg(F.coalesce(F.sum("qm_n"), F.lit(0))).first()[0]
    most = max(500, total // share)
    counts = counted.groupBy(*on).agg(F.count("*").alias("qm_n")) if counts is None else counts
    hot = F.broadcast(
        counts.where(F.col("qm_n") > most).select(*on, F.ceil(F.col("qm_n") / most).cast("int").alias("qm_salts"))
    )
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    none = F.lit(False)
    for c in on:
        none = none | F.col(c).isNull()
    salted = left.join(hot, on, "left").withColumn(
        "qm_salt",
        F.when(none, F.pmod(spread, F.lit(share)).cast("int")).when(F.col("qm_salts").isNull(), 0).otherwise(F.pmod(spread, F.col("qm_salts")).cast("int")),
    )
    copies = right.join(hot, on, "left").withColumn("qm_salt", F.explode(F.sequence(F.lit(0), F.coalesce("qm_salts", F.lit(1)) - 1)))
    return salted.drop("qm_salts").join(copies.drop("qm_salts").hint("merge"), [*on, "qm_salt"], how).drop("qm_salt")
