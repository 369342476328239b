"""Where rows go: keyed overwrites and appends as pure rewrites, so that a rerun gives the same table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions.text import relation_label


def keyed(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with new's rows in place of those of the same key."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced(existing: DataFrame, new: DataFrame, key: str = "paper_id") -> DataFrame:
    """All rows of the papers in new are put in place of theirs: reprocessing a paper never collides."""
    return keyed(existing, new, [key])


def links(names: DataFrame, entities: DataFrame) -> DataFrame:
    """paper_id, entity_id, frequency: one row per pair, the last written stands."""
    on = ["workspace_id", "entity_type", "normalized_name"]
    got = names.join(entities.select(F.col("id").alias("entity_id"), *on), on)
    last = Window.partitionBy("paper_id", "entity_id").orderBy(F.desc("rank"), F.desc("name"))
    return got.withColumn("k", F.row_number().over(last)).where("k = 1").select("paper_id", "entity_id", "frequency")


def relations(found: DataFrame, names: DataFrame) -> DataFrame:
    """Relations (paper_id, source, relation, target, confidence, evidence) whose ends both have an entity (paper_id, name, entity_id)."""
    a = names.select("paper_id", F.col("name").alias("source"), F.col("entity_id").alias("source_entity_id"))
    b = names.select("paper_id", F.col("name").alias("target"), F.col("entity_id").alias("target_entity_id"))
    return found.join(a, ["paper_id", "source"]).join(b, ["paper_id", "target"]).select(
        "source_entity_id", "target_entity_id", relation_label(F.col("relation")).alias("relationship_type"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.col("evidence").alias("evidence_text"), "paper_id",
    )


def vector_rows(chunks: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """Vector rows of chunks, by an encoder column that is handed in (an Arrow UDF)."""
    return chunks.select(F.col("embedding_id").alias("id"), encode(F.col("content")).alias("embedding"), "paper_id", "section", "importance_score", "workspace_id")


def graph_tables(papers: DataFrame, entities: DataFrame, links_: DataFrame, relations_: DataFrame) -> dict[str, DataFrame]:
    """Vertex and edge tables of the property graph; relations are one per ends, type and paper."""
    best = Window.partitionBy("source_entity_id", "target_entity_id", "relationship_type", "paper_id").orderBy(F.desc("id"))
    return {
        "paper": papers.select("id", "title", F.col("publication_year").alias("year")),
        "entity": entities.select("id", "name", F.col("entity_type").alias("type"), F.col("paper_count").alias("mention_count")),
        "mentions": links_.select("paper_id", "entity_id", "frequency"),
        "relates_to": relations_.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k"),
    }


def graph_json(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> DataFrame:
    """One row of JSON: at most limit nodes and limit edges."""
    n = nodes.orderBy("id").limit(limit).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*nodes.columns)))).alias("n"))
    e = edges.orderBy("source", "target", "type").limit(limit).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*edges.columns)))).alias("e"))
    text = F.concat(F.lit('{"nodes":['), F.array_join("n", ","), F.lit('],"edges":['), F.array_join("e", ","), F.lit("]}"))
    return n.crossJoin(e).select(text.alias("json"))  # single rows


def without_workspace(tables: dict[str, DataFrame], workspace: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(what is left of each table, deleted: one row per table with the number of its rows that go).

    tables: those with a workspace_id, and chunks, links and relations by paper_id of a deleted paper. Orphans don't stay.
    """
    gone = tables["papers"].where(F.col("workspace_id") == workspace).select(F.col("id").alias("paper_id"))
    left, counts = {}, []
    for name, t in tables.items():
        if "workspace_id" in t.columns:
            left[name], dead = t.where(~F.col("workspace_id").eqNullSafe(workspace)), t.where(F.col("workspace_id") == workspace)
        else:
            left[name], dead = t.join(gone, "paper_id", "left_anti"), t.join(gone, "paper_id", "left_semi")
        counts.append(dead.agg(F.lit(name).alias("name"), F.count("*").alias("deleted")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return left, out


def without_papers(vectors: DataFrame, paper_ids: list[int]) -> DataFrame:
    return vectors.where(~F.col("paper_id").isin(*paper_ids)) if paper_ids else vectors


def upvoted(hypotheses: DataFrame, hypothesis_id: int) -> DataFrame:
    return hypotheses.withColumn("upvotes", F.when(F.col("id") == hypothesis_id, F.coalesce("upvotes", F.lit(0)) + 1).otherwise(F.col("upvotes")))


def validated(hypotheses: DataFrame, hypothesis_id: int) -> DataFrame:
    return hypotheses.withColumn("agent_validated", (F.col("id") == hypothesis_id) | F.coalesce("agent_validated", F.lit(False)))


def with_status(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """papers with the last status of each (changes: id, ts, status)."""
    last = changes.groupBy("id").agg(F.max_by("status", F.struct("ts", "status")).alias("qm_status"))
    return papers.join(last, "id", "left").withColumn("processing_status", F.coalesce("qm_status", "processing_status")).drop("qm_status")


#: What a paper's status may become. Processing may begin again after it failed.
STEPS = {"pending": ("processing",), "processing": ("completed", "failed"), "failed": ("processing",), "completed": ("processing",)}


def registered(papers: DataFrame, new: DataFrame) -> DataFrame:
    """papers with those of new that are not among them; a paper that is known keeps its row and status."""
    return papers.unionByName(new.join(papers.select("id"), "id", "left_anti"), allowMissingColumns=True)


def stepped(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """papers after the changes (id, ts, status), in the order of ts: each is taken if the status at that time may become it."""
    steps = changes.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "status"))), lambda x: x["status"]).alias("qm_steps"))

    def take(now: Column, step: Column) -> Column:
        ok = F.lit(False)
        for before, after in STEPS.items():
            ok = ok | ((now == before) & step.isin(*after))
        return F.when(ok, step).otherwise(now)

    joined = papers.join(steps, "id", "left")
    status = F.when(F.col("qm_steps").isNull(), F.col("processing_status")).otherwise(F.aggregate("qm_steps", F.col("processing_status"), take))
    return joined.withColumn("processing_status", status).drop("qm_steps")


def parsed(papers: DataFrame, lines: DataFrame) -> DataFrame:
    """Papers in processing after parsing: completed if lines (paper_id) has any of theirs, else failed; the others as they were."""
    have = lines.select(F.col("paper_id").alias("id")).distinct().withColumn("qm_has", F.lit(True))
    joined = papers.join(have, "id", "left")
    done = F.when(F.col("qm_has"), "completed").otherwise("failed")
    return joined.withColumn("processing_status", F.when(F.col("processing_status") == "processing", done).otherwise(F.col("processing_status"))).drop("qm_has")
