"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.llm.common import WORD, partitions, range_bounds, range_bucket, running_total, stored

#: Rows of one source that one task sorts, about.
BUCKET_ROWS = 250


def source_targets(sized: DataFrame, weights=(5, 2, 1), max_repeats: int = 3, budget: float = 1.0) -> DataFrame:
    """A row per source: its size and the words it is to give. Sources by code point, null last, weigh weights, repeating.

    Targets share the budget (a part of all sizes) by weight; one that would exceed max_repeats times its source's size
    stops there and the others share the rest. Solved in closed form: sources in the order of cap per weight; a source is
    capped if all caps before it and its own ratio times the weights from it on still fit.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), ((rank - 1) % len(weights)).cast("int"))
    ranked = by_source.withColumn("qm_w", weight.cast("long")).withColumn("qm_cap", max_repeats * F.col("source_size"))
    total = Window.partitionBy()
    ratio = Window.orderBy(F.col("qm_cap") / F.col("qm_w"), F.col("source").asc_nulls_last())
    before, rest = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    placed = (
        ranked.withColumn("qm_all", F.floor(F.lit(budget) * F.sum("source_size").over(total)).cast("long"))
        .withColumn("qm_c", F.coalesce(F.sum("qm_cap").over(before), F.lit(0)))
        .withColumn("qm_ws", F.sum("qm_w").over(rest))
        .withColumn("qm_capped", F.col("qm_c") * F.col("qm_w") + F.col("qm_cap") * F.col("qm_ws") <= F.col("qm_all") * F.col("qm_w"))
    )
    spent = F.sum(F.when(F.col("qm_capped"), F.col("qm_cap")).otherwise(0)).over(total)
    open_w = F.sum(F.when(F.col("qm_capped"), 0).otherwise(F.col("qm_w"))).over(total)
    level = (F.col("qm_all") - spent).cast("double") * F.col("qm_w") / F.nullif(open_w, F.lit(0)).cast("double")
    return placed.select(
        "source",
        "source_size",
        F.when(F.col("qm_capped"), F.col("qm_cap").cast("double")).otherwise(level).alias("target"),
        F.col("qm_all").alias("budget"),
    )


def fair_mix(
    docs: DataFrame,
    weights=(5, 2, 1),
    max_repeats: int = 3,
    budget: float = 1.0,
    seed: str = "mix",
) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken.

    Each source's documents are shuffled by a keyed hash, then queued, max_repeats rounds of them; an entry's virtual
    finish time is the source's words up to its end, divided by the source's target. All entries, ranged by finish time
    over the cluster, are taken in this order as long as the total budget lasts.

    Null and empty texts, and texts without a word, have size 0 and taken 0. A null source is a source of its own. Rows
    without a doc_id are shuffled by their texts. Repeated rows each count. An empty table gives no row; other columns are
    ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        "source",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.when(F.col("doc_id").isNull(), F.md5(text)).alias("qm_text"),
    )
    return _mixed(sized, [], weights, max_repeats, budget, seed).select("doc_id", "size", "source_size", "target", "taken")


def _mixed(sized: DataFrame, rows_by: list[str], weights, max_repeats: int, budget: float, seed: str) -> DataFrame:
    """doc_id, source, size, qm_text and the columns rows_by, which tell rows of equal doc_id and size apart, and the mix of them:
    source_size, target, taken. qm_text is a digest of the text where doc_id is null."""
    spark = sized.sparkSession
    sized = stored(sized, "mix-sizes")
    n = sized.count()
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.col("qm_text"))))
    per_source = max(1, min(65536, n // BUCKET_ROWS))
    targets = source_targets(sized, weights, max_repeats, budget)
    named = sized.withColumn("qm_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("qm_key", key)
    named = named.withColumn("qm_b", F.floor(F.conv(F.substring("qm_key", 1, 4), 16, 10).cast("long") * per_source / 65536))
    queued = running_total(named, ["qm_src"], "qm_b", ["qm_key", "doc_id", "size", *rows_by], "size", "qm_cum")
    keyed = targets.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("qm_src"), "source_size", "target", "budget"
    )
    rows = stored(queued.join(keyed, "qm_src"), "mix-queue")
    entries = (
        rows.where("size > 0")
        .withColumn("qm_round", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("qm_f", (F.col("qm_round") * F.col("source_size") + F.col("qm_cum")).cast("double") / F.col("target"))
        .select("qm_f", "qm_key", "doc_id", "size", "qm_src", "qm_cum", "qm_round", "budget")
    )
    bounds = range_bounds(entries, "qm_f", max(1, min(8 * partitions(spark), n // 1000 + 1)))
    entries = entries.withColumn("qm_fb", range_bucket(F.col("qm_f"), bounds))
    taken = (
        running_total(entries, [], "qm_fb", ["qm_f", "qm_key", "doc_id", "qm_src", "qm_cum", "qm_round"], "size", "qm_run")
        .where(F.col("qm_run") <= F.col("budget"))
        .groupBy("qm_src", "qm_key", "qm_cum", "size")
        .agg(F.count("*").alias("qm_times"))
    )
    on = ["qm_src", "qm_key", "qm_cum", "size"]
    times = F.coalesce(F.col("qm_times"), F.lit(0))
    return rows.join(taken, on, "left").select("doc_id", "size", *rows_by, "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("qm_times"))


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), max_repeats: int = 3, budget: float = 1.0, seed: str = "mix") -> DataFrame:
    """The rows of docs, each repeated as often as the mix takes it; same columns.

    Null and empty texts, and texts without a word, are not taken. A null source is a source of its own. Each row is taken by
    its own turn in the queue, also where rows share a doc_id or have none; of rows equal in all columns, one stands for the
    turns of all. An empty table gives an empty one; other columns, whatever their names, are passed on.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    all_columns = [F.col(f"`{c}`") for c in docs.columns]
    # Maps and variants have no hash; their JSON has.
    hashed = [F.to_json(F.struct(c)) if re.search("map<|variant", kind) else c for c, (_, kind) in zip(all_columns, docs.dtypes, strict=True)]
    h1, h2 = F.xxhash64(*hashed).alias("qm_h1"), F.xxhash64(F.lit(seed), *hashed).alias("qm_h2")
    rows = docs.select(F.struct(*all_columns).alias("qm_row"), h1, h2)
    sized = docs.select(
        "doc_id",
        "source",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.when(F.col("doc_id").isNull(), F.md5(text)).alias("qm_text"),
        h1,
        h2,
    )
    taken = _mixed(sized, ["qm_h1", "qm_h2"], weights, max_repeats, budget, seed).where("taken > 0")
    turns = taken.groupBy("qm_h1", "qm_h2").agg(F.sum("qm_times").cast("int").alias("qm_n"))
    one = rows.join(turns.hint("merge"), ["qm_h1", "qm_h2"]).dropDuplicates(["qm_h1", "qm_h2"])
    return one.withColumn("qm_turn", F.explode(F.sequence(F.lit(1), F.col("qm_n")))).select(*[F.col("qm_row")[c].alias(c) for c in docs.columns])


#: The same mix in DuckDB's SQL.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS h FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, CAST(([5, 2, 1])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS BIGINT) AS w,
         3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS b FROM src
), placed AS (
  SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c,
         CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws FROM ranked
), flagged AS (SELECT *, c * w + cap * ws <= b * w AS capped FROM placed),
levels AS (
  SELECT *, CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT) AS spent,
         CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS BIGINT) AS open_w FROM flagged
), targets AS (
  SELECT source, source_size, b, CASE WHEN capped THEN CAST(cap AS DOUBLE)
         ELSE CAST(b - spent AS DOUBLE) * w / CAST(nullif(open_w, 0) AS DOUBLE) END AS target FROM levels
), keyed AS (
  SELECT *, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), h)) AS k FROM sized
), queued AS (
  SELECT q.*, t.source_size, t.target, t.b,
         CAST(sum(q.size) OVER (PARTITION BY q.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM keyed q JOIN targets t ON q.source IS NOT DISTINCT FROM t.source
), entries AS (
  SELECT *, CAST(e * source_size + cum AS DOUBLE) / target AS f FROM queued, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0
), run AS (
  SELECT *, sum(size) OVER (ORDER BY f, k, doc_id, source, cum, e ROWS UNBOUNDED PRECEDING) AS total FROM entries
), times AS (SELECT source, k, cum, size, count(*) AS times FROM run WHERE total <= b GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(t.times, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN times t ON q.source IS NOT DISTINCT FROM t.source AND q.k = t.k AND q.cum = t.cum AND q.size = t.size
"""
