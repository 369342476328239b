"""Retrieval: candidate scans, hybrid scores, reranking, vector search. Every order ends in a unique key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import lexicon as lx
from quillmine.functions.scores import bm25, dot, hybrid, lexical, query_terms, terms_of, tokens
from quillmine.functions.segments import any_of, naive_sentences
from quillmine.functions.text import word_count, words


def scoped(df: DataFrame, workspace: str | None = None, paper_ids: list[int] | None = None, column: str = "paper_id") -> DataFrame:
    """Rows of a workspace and, if any are named, of papers; both predicates reach the scan."""
    if workspace is not None:
        df = df.where(F.col("workspace_id") == workspace)
    return df.where(F.col(column).isin(*paper_ids)) if paper_ids else df


def candidates(chunks: DataFrame, limit: int | None = lx.CANDIDATES, least: float = lx.MIN_IMPORTANCE) -> DataFrame:
    """The most important chunks; all that have the least importance where limit is None."""
    rows = chunks.where(F.col("importance_score") >= least)
    return rows if limit is None else rows.orderBy(F.desc("importance_score"), "id").limit(limit)


def lexical_search(chunks: DataFrame, query: str, n: int, limit: int | None = lx.CANDIDATES) -> DataFrame:
    """The n best of the candidates by hybrid score, with rank from 1. Without query terms fewer candidates are looked at. limit=None
    takes all chunks as candidates: their mean length is one aggregate, and only texts that hold a term are taken apart."""
    found = terms_of(query)
    terms = F.array(*map(F.lit, found)) if found else F.array().cast("array<string>")
    size = word_count(F.col("content")).cast("double")
    if limit is None:
        rows = candidates(chunks, None)
        mean = F.lit(rows.agg(F.avg(size)).first()[0] or 0.0)  # one number
        # A token is a part of the text, so a text without any of the terms in it has no score.
        rows = rows.where(any_of(F.lower("content"), found)) if found else rows
    else:
        rows = candidates(chunks, limit if found else min(max(2 * n, 12), limit))
        # The mean is of the candidates at hand, `limit` rows at most, so one scan serves both.
        mean = F.avg(size).over(Window.partitionBy())
    scored = rows.withColumn("mean", mean).withColumn("bm25", bm25(terms, tokens(F.col("content")), F.col("mean")))
    scored = scored.where(F.lit(not found) | (F.col("bm25") > 0))
    score = hybrid(F.col("bm25"), terms, F.col("importance_score"), lexical(terms, F.col("content")))
    best = scored.withColumn("score", score).orderBy(F.desc("score"), F.desc("importance_score"), "id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("importance_score"), "id")))


def fallback_search(chunks: DataFrame, query: str, n: int = 20, pool: int = 40) -> DataFrame:
    terms = [t for t in query.lower().split() if len(t) >= lx.TERM_LETTERS]
    rows = chunks.orderBy(F.desc("importance_score"), "id").limit(pool)
    hits = F.lit(0)
    for t in terms:
        hits = hits + F.lower("content").contains(t).cast("int")
    score = F.round(F.least(F.lit(1.0), 0.35 + hits / F.lit(float(max(len(terms), 1))) * 0.45 + F.col("importance_score") * 0.2), 4)
    return rows.withColumn("score", score).orderBy(F.desc("score"), F.desc("importance_score"), "id").limit(n)


def vector_search(
    vectors: DataFrame, query: list[float], n: int = 15, section: str | None = None, exclude: list[int] | None = None, least: float | None = None
) -> DataFrame:
    """Exact cosine search of unit vectors. Metadata filters stand below the top n; a least score is applied after it."""
    if section is not None:
        vectors = vectors.where(F.col("section") == section)
    if exclude:
        vectors = vectors.where(~F.col("paper_id").isin(*exclude))
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.withColumn("score", dot(F.col("embedding"), q)).orderBy(F.desc("score"), "paper_id").limit(n)
    return best if least is None else best.where(F.col("score") >= least)


#: Vectors of a part, about, and blocks of query vectors that it meets at a time.
PART, BLOCKS = 4096, 16
#: What a matrix product may differ by from the sum in order, per unit of the lengths' product.
SLACK = 1e-9


def _rows(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _best_of(n: int, least: float, block: int):
    """A map of a part of the vectors beside queries to source_id, paper_id, score: each query's n best of the part, with ties, from the
    least score on. The matrix product only leaves rows out; scores are sums in order, as `dot` has them."""

    def run(part: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if part.num_rows and queries.num_rows:
            dims = part.column("dims")[0].as_py()
            papers, every, v, qs = part.column("id").to_numpy(), queries.column("id").to_numpy(), _rows(part.column("embedding"), dims), _rows(queries.column("embedding"), dims)
            for lo in range(0, len(every), block):
                sources, q = every[lo : lo + block], qs[lo : lo + block]
                with np.errstate(all="ignore"):
                    same = papers[None] == sources[:, None]
                    score = np.where(same, -np.inf, q @ v.T)
                    wide = SLACK * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
                    # A score that is no number is the greatest, here and in Spark; where one bounds the rest, nothing is left out.
                    floor = np.partition(score, -n, axis=1)[:, -n] - 2 * wide if score.shape[1] > n else np.full(len(q), -np.inf)
                    s, p = np.nonzero(~same & ~(score < np.fmax(floor, least - wide)[:, None]))
                    exact = np.zeros(len(s))
                    for k in range(dims):
                        exact = exact + v[p, k] * q[s, k]
                found.append((sources[s], papers[p], exact))
        return pa.table(dict(zip(("source_id", "paper_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def similar_pairs(sources: DataFrame, vectors: DataFrame, n: int = 10, least: float = lx.CROSS_PAPER_MIN, block: int = 1000) -> DataFrame:
    """source_id, paper_id, score, rank: for each source vector its n nearest vectors of other papers of the same workspace, of the least score.

    sources is a set of query vectors, held against all vectors. Parts of the vectors of a workspace and length meet query vectors of
    the same, BLOCKS blocks of them at most, and each block is one matrix product, so no row is made for a pair that is not among a
    part's best. Vectors that are null or hold nulls have no score.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull()) & F.col("paper_id").isNotNull() & F.col("workspace_id").isNotNull() & (F.size("embedding") > 0)
    flat = lambda df: df.where(whole).select(F.col("workspace_id").alias("space"), F.size("embedding").alias("dims"), F.col("paper_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    s, v = flat(sources), flat(vectors)
    parts, blocks = max(1, -(-v.count() // PART)), max(1, -(-s.count() // (BLOCKS * block)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("part", dealt(parts)).withColumn("block", every(blocks))
    s = s.withColumn("block", dealt(blocks)).withColumn("part", every(parts))
    keys = ["space", "dims", "part", "block"]
    pairs = v.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInArrow(_best_of(n, least, block), "source_id long, paper_id long, score double")
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "paper_id")
    return pairs.where(F.col("score") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def connections(sources: DataFrame, vectors: DataFrame, limit: int = 10, least: float = lx.CROSS_PAPER_MIN) -> DataFrame:
    """Unexplored connections: each target paper with its best source, best first."""
    best = similar_pairs(sources, vectors, least=least).groupBy("paper_id").agg(
        F.max_by("source_id", F.struct("score", -F.col("source_id"))).alias("source_id"), F.max("score").alias("score")
    )
    return best.orderBy(F.desc("score"), "paper_id").limit(limit)


def merged_results(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Results of two searches (id, score): the higher score of an id stays, the first search's on a tie."""
    both = first.select("id", "score", F.lit(0).alias("src")).unionByName(second.select("id", "score", F.lit(1).alias("src")))
    one = both.groupBy("id").agg(F.max("score").alias("score"), F.max_by(F.col("src"), F.struct("score", -F.col("src"))).alias("src"))
    return one.orderBy(F.desc("score"), "src", "id").limit(limit)


def entity_terms(names: DataFrame) -> DataFrame:
    """Distinct words, of four letters and no stop word, of entity names (at most ten names)."""
    w = names.select(F.explode(words(F.col("name"))).alias("term")).where(F.char_length("term") >= lx.TERM_LETTERS)
    return w.select(F.lower("term").alias("term")).where(~F.col("term").isin(*lx.GRAPH_STOP)).distinct()


def boosted(results: DataFrame, terms: list[str], n: int) -> DataFrame:
    """Results reranked with a bonus for each entity word they contain."""
    bonus = F.lit(0.0)
    for t in sorted(terms):
        bonus = bonus + F.when(F.lower("content").contains(t), 0.015).otherwise(0.0)
    out = results.withColumn("score", F.col("score") + F.least(F.lit(0.08), bonus))
    return out.orderBy(F.desc("score"), "rank").limit(n)


def best_sentences(results: DataFrame, query: str, n: int = 5, of: int = 6) -> DataFrame:
    """The sentences of the first results that score best by themselves: sentence, score, result, place."""
    terms = query_terms(F.lit(query))
    s = results.where(F.col("rank") <= of).select("rank", F.posexplode(naive_sentences(F.col("content"))).alias("place", "sentence"))
    s = s.where(F.char_length("sentence").between(45, 320)).withColumn("sentence_score", lexical(terms, F.col("sentence")))
    return s.orderBy(F.desc("sentence_score"), "rank", "place").limit(n)


def excerpt(text: Column, query: str, n: int) -> Column:
    """First n words of the text's best sentence, or of the text if no sentence is of good length."""
    terms = query_terms(F.lit(query))
    s = F.filter(naive_sentences(text), lambda x: F.char_length(x).between(45, 320))
    ranked = F.array_sort(F.transform(s, lambda x, i: F.struct((-lexical(terms, x)).alias("k"), i.alias("i"), x.alias("s"))))
    source = F.coalesce(F.try_element_at(ranked, F.lit(1))["s"], text)
    return F.array_join(F.slice(words(source), 1, n), " ")


def landscape(papers: DataFrame, topic: str, limit: int | None = 100) -> DataFrame:
    """Number of the topic's papers, and the range of their years where known: of the first papers, or of all where limit is None."""
    year = F.nullif(F.col("publication_year"), F.lit(0))
    hit = papers.where(F.lower("raw_text").contains(topic.lower()))
    hit = hit if limit is None else hit.orderBy("id").limit(limit)
    return hit.agg(F.count("*").alias("paper_count"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def gaps(contents: DataFrame) -> DataFrame:
    """One row: knowledge gaps by keyword rules on the texts (content) put together."""
    joined = contents.agg(F.lower(F.concat_ws(" ", F.array_sort(F.collect_list("content")))).alias("t"))
    found = F.array_compact(F.array(*[F.when(any_of(F.col("t"), keys), gap) for keys, gap in lx.GAP_RULES]))
    return joined.select(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(lx.DEFAULT_GAP))).alias("gaps"))
