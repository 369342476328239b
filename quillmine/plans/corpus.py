"""The relations of the evidence engine over the driver's tables: one adapter, the same in SQL for the oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmine.functions import lexicon as lx
from quillmine.functions.scores import valid_name
from quillmine.functions.segments import importance
from quillmine.functions.text import scoped_key, word_count
from quillmine.sources.shelf import dealt, kept, new_path

SECTIONS = ("abstract", "introduction", "related_work", "methods", "results", "discussion", "conclusion", "future_work", "other", "methodology")
STATUS = ("failed", "processing", "pending", "completed")
#: Types that entities get in turn, by their ids.
KINDS = ("CONCEPT", "METHOD", "DISEASE", "GENE", "CHEMICAL", "DATASET", "PROTEIN", "ORGANISM")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    d = dealt(d) if text else d
    k = F.col("doc_id") % 10
    out = d.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("workspace_id"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        F.col("text").alias("raw_text"),
        (2000 + F.col("doc_id") % 25).cast("int").alias("publication_year"),
        F.when(k == 0, "failed").when(k == 1, "processing").when(k == 2, "pending").otherwise("completed").alias("processing_status"),
    )
    return out if text else out.drop("raw_text")


def section_of(doc_id: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SECTIONS]), (doc_id % 10).cast("int"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).withColumn("section", section_of(F.col("doc_id")))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("paper_id"),
        F.col("lang").alias("workspace_id"),
        "section",
        F.col("text").alias("content"),
        F.lit(0).alias("sub_index"),
        importance(F.col("section"), F.col("text")).alias("importance_score"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("_"), F.col("section"), F.lit("_0")).alias("embedding_id"),
        word_count(F.col("text")).alias("word_count"),
    )


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, workspace_id, name, n: capitalised names of each document, with their number."""
    found = dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select(
        F.col("doc_id").alias("paper_id"),
        F.col("lang").alias("workspace_id"),
        F.explode(F.regexp_extract_all("text", F.lit("(?U)" + lx.CONCEPT), F.lit(0))).alias("name"),
    )
    return found.where(~F.col("name").isin(*lx.CONCEPT_STOP) & valid_name(F.col("name"))).groupBy("paper_id", "workspace_id", "name").agg(F.count("*").alias("n"))


def entity_id(normalized: Column) -> Column:
    """A 60-bit id, the same for the same key on every machine."""
    return F.conv(F.substring(F.md5(normalized), 1, 15), 16, 10).cast("long")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, entity_id, frequency, and the spelling that stands for it: most frequent, then shortest, then first."""
    c = concepts(spark, sf_dir).withColumn("normalized_name", scoped_key(F.col("workspace_id"), F.col("name")))
    best = F.min_by("name", F.struct(-F.col("n"), F.char_length("name"), F.col("name")))
    return c.groupBy("paper_id", "workspace_id", "normalized_name").agg(F.sum("n").cast("int").alias("frequency"), best.alias("name")).withColumn(
        "entity_id", entity_id(F.col("normalized_name"))
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(mentions(spark, sf_dir))


def paper_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(mentions(spark, sf_dir))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relationships(mentions(spark, sf_dir))


def evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, links and relationships of one table of mentions, so that names are looked for in the texts once."""
    m = kept(mentions(spark, sf_dir), new_path(spark, "mentions"))
    return _entities(m), _links(m), _relationships(m)


def _entities(m: DataFrame) -> DataFrame:
    return m.groupBy(F.col("entity_id").alias("id"), "workspace_id", "normalized_name").agg(
        F.min_by("name", F.struct("paper_id", "name")).alias("name"), F.count("*").cast("int").alias("paper_count")
    ).withColumn("entity_type", F.get(F.array(*[F.lit(k) for k in KINDS]), F.pmod("id", F.lit(len(KINDS))).cast("int")))


def _links(m: DataFrame) -> DataFrame:
    return m.select("paper_id", "entity_id", "frequency")


def _relationships(m: DataFrame) -> DataFrame:
    """Neighbours among a document's six most frequent entities, typed in turn: a stand-in for extracted relations."""
    order = Window.partitionBy("paper_id").orderBy(F.desc("frequency"), "name", "entity_id")
    top = m.withColumn("k", F.row_number().over(order)).where("k <= 6")
    linked = top.withColumn("target", F.lead("entity_id").over(order)).where("target is not null")
    kinds = F.array(*[F.lit(r) for r in lx.RELATIONS])
    return linked.select(
        (F.col("paper_id") * 10 + F.col("k")).alias("id"),
        F.col("entity_id").alias("source_entity_id"),
        F.col("target").alias("target_entity_id"),
        F.get(kinds, (F.col("paper_id") % 8).cast("int")).alias("relationship_type"),
        (F.lit(0.5) + (F.col("paper_id") % 50) / F.lit(100.0)).alias("confidence"),
        "paper_id",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("workspace_id"))
    return e.join(d, "vec_id").select(
        F.col("vec_id").alias("paper_id"), "workspace_id", section_of(F.col("vec_id")).alias("section"), "embedding", "label"
    )


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("workspace_id"),
        ((F.col("doc_id") % 100) / F.lit(100.0)).alias("confidence_score"),
        ((F.col("doc_id") * 7 % 100) / F.lit(100.0)).alias("novelty_score"),
        F.array(F.col("doc_id"), F.col("doc_id") + 1).alias("supporting_paper_ids"),
        (F.col("doc_id") % 5).cast("int").alias("upvotes"),
    )


def _any(terms) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + ")"


#: The adapter in DuckDB's SQL. Non-ASCII characters become _ where word boundaries of any script count.
_WEIGHTS = " ".join(f"WHEN '{s}' THEN {w}e0" for s, w in lx.SECTION_WEIGHT.items())
_STOP = ", ".join(f"'{w}'" for w in lx.CONCEPT_STOP)
_BLACK = ", ".join(f"'{w}'" for w in lx.ENTITY_BLACKLIST)
ASCII = "regexp_replace({}, '[^\\x00-\\x7F]', '_', 'g')"
PRELUDE = reduce(
    lambda s, kv: s.replace(kv[0], kv[1]),
    (
        ("@sections", ", ".join(f"'{s}'" for s in SECTIONS)),
        ("@weights", _WEIGHTS),
        ("@claim", _any(lx.CLAIM_TERMS)),
        ("@contrast", _any(lx.CONTRAST_TERMS)),
        ("@ascii", ASCII.format("text")),
        ("@stop", _STOP),
        ("@concept", lx.CONCEPT),
        ("@kinds", ", ".join(f"'{k}'" for k in KINDS)),
        ("@n_kinds", str(len(KINDS))),
        ("@black", _BLACK),
        ("@relations", ", ".join(f"'{r}'" for r in lx.RELATIONS)),
    ),
    r"""
WITH RECURSIVE papers AS (
  SELECT doc_id AS id, lang AS workspace_id, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS raw_text,
         CAST(2000 + doc_id % 25 AS INT) AS publication_year,
         CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending' ELSE 'completed' END AS processing_status
  FROM documents),
parts AS (SELECT *, ([@sections])[1 + CAST(doc_id % 10 AS INT)] AS section FROM documents),
chunks AS (
  SELECT doc_id AS id, doc_id AS paper_id, lang AS workspace_id, section, text AS content, 0 AS sub_index,
         least(1e0, CASE section @weights ELSE 0.4e0 END
           + (CASE WHEN @claim THEN 0.07e0 ELSE 0e0 END + CASE WHEN regexp_matches(text, '\d+\.?\d*\s?%') THEN 0.05e0 ELSE 0e0 END
           + CASE WHEN @contrast THEN 0.03e0 ELSE 0e0 END)) AS importance_score,
         'p' || doc_id || '_' || section || '_0' AS embedding_id,
         CAST(len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')) AS INT) AS word_count
  FROM parts),
concepts AS (
  SELECT paper_id, workspace_id, name, count(*) AS n FROM (
    SELECT doc_id AS paper_id, lang AS workspace_id,
           unnest(regexp_extract_all(@ascii, '@concept')) AS name FROM documents)
  WHERE name NOT IN (@stop) AND lower(name) NOT IN (@black) AND length(name) BETWEEN 2 AND 80 GROUP BY ALL),
mentions AS (
  SELECT paper_id, workspace_id, normalized_name, frequency, name, CAST('0x' || substr(md5(normalized_name), 1, 15) AS BIGINT) AS entity_id FROM (
    SELECT paper_id, workspace_id, workspace_id || ':' || regexp_replace(lower(name), '[\s\-_]', '', 'g') AS normalized_name,
           CAST(sum(n) AS INT) AS frequency, arg_min(name, (-n, length(name), name)) AS name FROM concepts GROUP BY 1, 2, 3)),
entities AS (
  SELECT entity_id AS id, workspace_id, normalized_name, arg_min(name, (paper_id, name)) AS name, CAST(count(*) AS INT) AS paper_count,
         ([@kinds])[1 + entity_id % @n_kinds] AS entity_type FROM mentions GROUP BY 1, 2, 3),
paper_entities AS (SELECT paper_id, entity_id, frequency FROM mentions),
ranked_mentions AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY frequency DESC, name, entity_id) AS k FROM mentions),
relationships AS (
  SELECT a.paper_id * 10 + a.k AS id, a.entity_id AS source_entity_id, b.entity_id AS target_entity_id,
         ([@relations])[1 + CAST(a.paper_id % 8 AS INT)] AS relationship_type, 0.5e0 + (a.paper_id % 50) / 100e0 AS confidence, a.paper_id
  FROM ranked_mentions a JOIN ranked_mentions b ON a.paper_id = b.paper_id AND b.k = a.k + 1 WHERE b.k <= 6),
vectors AS (
  SELECT vec_id AS paper_id, lang AS workspace_id, ([@sections])[1 + CAST(vec_id % 10 AS INT)] AS section, embedding, label
  FROM embeddings JOIN documents ON vec_id = doc_id),
hypotheses AS (
  SELECT doc_id AS id, lang AS workspace_id, (doc_id % 100) / 100e0 AS confidence_score, (doc_id * 7 % 100) / 100e0 AS novelty_score,
         [doc_id, doc_id + 1] AS supporting_paper_ids, CAST(doc_id % 5 AS INT) AS upvotes FROM documents)
""",
)
