"""Plans of laid-out tables: no exchange in the joins, other workspaces not opened. Impact-ordered search against all chunks."""

import random

import pytest
from pyspark.sql import functions as F

from quillmine.functions.scores import bm25, hybrid, lexical, terms_of, tokens
from quillmine.functions.text import word_count
from quillmine.operators import impact
from quillmine.sources.layout_tables import Workspace


@pytest.fixture(scope="module")
def tables(spark):
    papers = spark.range(300).select("id", F.concat(F.lit("w"), (F.col("id") % 3).cast("string")).alias("workspace_id"), F.lit("t").alias("title"))
    chunks = spark.range(900).select("id", (F.col("id") % 310).alias("paper_id"), F.concat(F.lit("w"), (F.col("id") % 310 % 3).cast("string")).alias("workspace_id"), F.lit("c").alias("content"))
    entities = spark.range(50).select("id", F.concat(F.lit("w"), (F.col("id") % 3).cast("string")).alias("workspace_id"), F.lit("e").alias("name"))
    links = spark.range(2000).select((F.col("id") * 7 % 300).alias("paper_id"), (F.col("id") * 7 % 300 % 3 + 3 * (F.col("id") % 16)).alias("entity_id"), F.lit(1).alias("frequency")).distinct()
    return papers, chunks, entities, links


def test_joins_without_exchange(spark, tables):
    papers, chunks, entities, links = tables
    w = Workspace(spark, papers, chunks, entities, links, buckets=8)
    plain = {
        "chunk_papers": chunks.join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id"),
        "paper_links": links.join(papers.select(F.col("id").alias("paper_id"), "workspace_id", "title"), "paper_id"),
        "entity_links": links.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id"),
    }
    for name, want in plain.items():
        for workspace in (None, "w1"):
            df = getattr(w, name)(workspace)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan, plan
            assert workspace is None or plan.count("PartitionFilters: [isnotnull(workspace_id") == 2, plan
            count = want.count() if workspace is None else df.where("workspace_id = 'w1'").count()
            assert df.count() == count > 0
    assert len(w.table("chunks", "w1").inputFiles()) <= 8
    spread = w.chunk_papers().groupBy("paper_id").agg(F.count("*").alias("n"))
    assert "Exchange" not in spread._jdf.queryExecution().executedPlan().toString()


def drawn_chunks(spark, n=1200):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(300)] + ["protein", "kinase", "binding", "assay"]
    weights = [1 / (i + 1) for i in range(300)] + [0.03, 0.01, 0.02, 0.004]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, weights, k=rng.choice([5, 40, 200])))
        rows.append((i, text if i % 97 else None, round(rng.random() ** 2, 2)))
    return spark.createDataFrame([*rows, (5000, "Kinase KINASE proteins", 0.0)], "id long, content string, importance_score double")


def all_scored(chunks, query, n):
    terms = F.array(*map(F.lit, terms_of(query)))
    mean = chunks.agg(F.avg(word_count(F.col("content")).cast("double"))).first()[0]
    rows = chunks.withColumn("b", bm25(terms, tokens(F.col("content")), F.lit(mean))).where("b > 0")
    return rows.withColumn("score", hybrid(F.col("b"), terms, F.col("importance_score"), lexical(terms, F.col("content")))).orderBy(F.desc("score"), F.desc("importance_score"), "id").limit(n)


def test_impact_search_is_exhaustive(spark):
    chunks = drawn_chunks(spark).persist()
    index = impact.build(chunks, block=50)
    assert index.blocks >= 24
    for query, n in (("kinase assay", 5), ("protein binding kinase", 10), ("word250 word7", 3), ("assay assay", 200), ("nothing like it", 4)):
        got, report = impact.search(index, chunks, query, n)
        want = [tuple(r) for r in all_scored(chunks, query, n).select("id", "score").collect()]
        assert [tuple(r) for r in got.select("id", "score").collect()] == want, query
        assert report.read <= report.blocks
    _, report = impact.search(index, chunks, "word0 kinase", 3)
    assert report.read < report.blocks and report.texts < 300
    with pytest.raises(ValueError, match="no term"):
        impact.search(index, chunks, "of", 3)


def test_impact_of_nothing(spark):
    none = drawn_chunks(spark, 1).limit(0)
    got, report = impact.search(impact.build(none), none, "kinase", 3)
    assert got.count() == 0 and report == impact.Report()
