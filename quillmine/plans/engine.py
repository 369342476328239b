"""The façade: what a user of a literature service asks, over DataFrames of one workspace."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions.scores import dot, lexical, terms_of
from quillmine.operators import graph, retrieve, synth
from quillmine.operators.chunking import chunked
from quillmine.operators.layout import authors, materialised, sections, titles
from quillmine.operators.ner import extracted
from quillmine.sources.sinks import upvoted, validated, without_workspace

WORKSPACE = re.compile(r"[a-f0-9-]{36}", re.I)


class NotFoundError(LookupError):
    """No such row in this workspace."""


@dataclass
class Engine:
    """papers (id, workspace_id, title, raw_text, publication_year, processing_status), chunks, entities, links, relations, vectors
    and hypotheses; each method returns DataFrames and sees one workspace only."""

    papers_: DataFrame
    chunks: DataFrame
    entities: DataFrame
    links: DataFrame
    relations: DataFrame
    vectors: DataFrame | None = None
    hypotheses_: DataFrame | None = None
    workspace: str | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def workspace_id(text: str) -> str:
        w = text.strip().lower()
        if not WORKSPACE.fullmatch(w):
            raise ValueError("a workspace id has 36 hexadecimal digits and dashes")
        return w

    def _own(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("workspace_id") == self.workspace) if self.workspace is not None and "workspace_id" in df.columns else df

    @staticmethod
    def ingest(lines: DataFrame) -> dict[str, DataFrame]:
        """Sections, titles, authors, chunks and names of layout lines."""
        found = materialised(sections(lines))
        t = titles(lines)
        made = chunked(found)
        # A chunk's number starts again in each section, so section and number make its id.
        return {"sections": found, "titles": t, "authors": authors(lines, t), "chunks": made, "names": extracted(made.withColumn("id", F.struct("section", "sub_index")))}

    def papers(self, status: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        rows = self._own(self.papers_)
        if status:
            rows = rows.where(F.col("processing_status") == status)
        return rows.drop("raw_text").orderBy(F.desc("id")).offset(offset).limit(min(limit, 200))

    def paper(self, paper_id: int) -> DataFrame:
        """The paper with its numbers of chunks and entities; NotFoundError outside the workspace."""
        one = self._own(self.papers_).where(F.col("id") == paper_id).drop("raw_text")
        if one.isEmpty():
            raise NotFoundError(f"paper {paper_id}")
        c = self.chunks.where(F.col("paper_id") == paper_id).agg(F.count("*").alias("n_chunks"))
        e = self.links.where(F.col("paper_id") == paper_id).agg(F.count("*").alias("n_entities"))
        return one.crossJoin(c).crossJoin(e).withColumn("graph_built", (F.col("processing_status") == "completed") & (F.col("n_entities") > 0))  # single rows

    status = paper

    def terms(self, query: str) -> list[str]:
        return terms_of(query)

    @staticmethod
    def _at_hand(df: DataFrame, most: int) -> DataFrame:
        """df, of most rows at most, as a table of its own, so that later steps don't compute it again."""
        return df.sparkSession.createDataFrame(df.limit(most).collect(), df.schema)

    def papers_by_id(self, paper_ids: list[int], limit: int = 20) -> DataFrame:
        """id, title, year and, where known, arxiv_id of the papers asked for, by id."""
        rows = retrieve.scoped(self._own(self.papers_), None, paper_ids, "id") if paper_ids else self.papers_.limit(0)
        more = ["arxiv_id"] if "arxiv_id" in rows.columns else []
        return rows.select("id", "title", F.col("publication_year").alias("year"), *more).orderBy("id").limit(limit)

    def search(self, query: str, n: int = 8, paper_ids: list[int] | None = None) -> DataFrame:
        n = min(max(n, 1), 20)
        rows = retrieve.scoped(self._own(self.chunks), None, paper_ids)
        return retrieve.lexical_search(rows, query, n)

    def semantic(self, vector: list[float], n: int = 15, paper_ids: list[int] | None = None, section: str | None = None) -> DataFrame:
        return retrieve.vector_search(retrieve.scoped(self._own(self.vectors), None, paper_ids), vector, n, section)

    def graph_context(self, query: str, paper_ids: list[int]) -> tuple[DataFrame, DataFrame]:
        """Entities and facts for a query and its papers; co-mentions join in where explicit facts are few."""
        ents = graph.filtered_entities(graph.candidate_entities(self._own(self.entities), self.links, self.terms(query), paper_ids))
        facts = graph.explicit_facts(self.relations, self.entities, ents.select("id"), paper_ids)
        if facts.limit(4).count() < 4:
            near = self.links.where(F.col("paper_id").isin(*paper_ids)).join(ents.select(F.col("id").alias("entity_id"), "name", "entity_type"), "entity_id")
            near = near.orderBy(F.desc("frequency"), "entity_id", "paper_id").limit(240)
            facts = graph.merged_facts(facts, graph.filtered_facts(graph.co_mentions(near)))
        return ents, graph.filtered_facts(facts)

    def answer(self, query: str, n: int = 8, paper_ids: list[int] | None = None, summarise: Callable[[str], str] | None = None) -> DataFrame:
        """The extractive answer, one row, of the best of all chunks. summarise, if given, is asked once for a text that goes before it."""
        pool = retrieve.lexical_search(retrieve.scoped(self._own(self.chunks), None, paper_ids), query, max(n, 8), None)
        pool = self._at_hand(pool.join(self._own(self.papers_).select(F.col("id").alias("paper_id"), "title"), "paper_id"), max(n, 8))
        asked = paper_ids or [r["paper_id"] for r in pool.orderBy("rank").select("paper_id").collect()]
        ents, facts = (self._at_hand(x, 32) for x in self.graph_context(query, asked))
        first = ents.orderBy(F.desc("strength"), F.desc("paper_count"), "place").limit(10)
        words = [r["term"] for r in retrieve.entity_terms(first).collect()]  # of ten names
        best = retrieve.boosted(pool, words, n).withColumnRenamed("rank", "old")
        order = F.row_number().over(Window.orderBy(F.desc("score"), "old"))
        best = best.withColumn("rank", order)
        out = synth.answer(best, retrieve.best_sentences(best, query), ents, facts, query)
        if summarise is not None:
            text = out.first()["answer"]
            out = out.withColumn("answer", F.concat(F.lit(f"### Summary\n{summarise(text)}\n\n"), F.col("answer")))
        return out

    def paper_graph(self, paper_id: int) -> tuple[DataFrame, DataFrame]:
        one = self._own(self.papers_).where(F.col("id") == paper_id)
        if one.isEmpty():
            raise NotFoundError(f"paper {paper_id}")
        return graph.paper_graph(one, self._own(self.entities), self.links, self.relations)

    def entity_graph(self, name: str) -> tuple[DataFrame, DataFrame]:
        return graph.entity_graph(name, self._own(self.papers_), self._own(self.entities), self.links, self.relations)

    def hypothesize(self, query: str, paper_ids: list[int] | None = None, count: int = 5) -> DataFrame:
        """Ranked hypotheses by templates; entities come in where papers are named."""
        count = min(max(count, 1), 10)
        found = retrieve.fallback_search(retrieve.scoped(self._own(self.chunks), None, paper_ids), query)
        found = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("importance_score"), "id")))
        links = self.links.where(F.col("paper_id").isin(*paper_ids)) if paper_ids else self.links.limit(0)
        types = synth.by_type(links.join(self._own(self.entities).withColumnRenamed("id", "entity_id"), "entity_id"))
        titled = found.join(self._own(self.papers_).select(F.col("id").alias("paper_id"), "title"), "paper_id", "left")
        return synth.hypotheses(types, synth.evidence_sentences(found), query, count, titled, retrieve.gaps(found.where("rank <= 5")))

    def hypotheses(self, least: float = 0.0, paper_id: int | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
        rows = self._own(self.hypotheses_).where(F.col("confidence_score") >= least)
        if paper_id is not None:
            rows = rows.where(F.array_contains("supporting_paper_ids", F.lit(paper_id)))
        return rows.orderBy("id").offset(offset).limit(limit)

    def explain(self, hypothesis_id: int) -> DataFrame:
        one = self._own(self.hypotheses_).where(F.col("id") == hypothesis_id)
        if one.isEmpty():
            raise NotFoundError(f"hypothesis {hypothesis_id}")
        return one

    def upvote(self, hypothesis_id: int) -> DataFrame:
        self.explain(hypothesis_id)
        self.hypotheses_ = upvoted(self.hypotheses_, hypothesis_id)
        return self.explain(hypothesis_id)

    def debate(self, hypothesis_id: int, speak: Callable | None = None, verdict: Callable | None = None, rounds: int = 2) -> DataFrame:
        """A debate on the hypothesis; with a verdict of a model or without one, the hypothesis then counts as validated."""
        one = self.explain(hypothesis_id)
        text = F.col("hypothesis_text") if "hypothesis_text" in one.columns else F.lit("")
        held = synth.debate(one.select("id", text.alias("hypothesis"), F.col("confidence_score").alias("confidence")), speak, verdict, rounds)
        if "agent_validated" in self.hypotheses_.columns:
            self.hypotheses_ = validated(self.hypotheses_, hypothesis_id)
        return held

    def contradictions(self, topic: str, paper_ids: list[int], vector: list[float] | None = None, verdict: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """A row per pair of the papers, by the five chunks of each that are nearest to the topic: by its vector, where one is
        given and vectors are at hand, else by the topic's words."""
        if len(paper_ids) < 2:
            raise ValueError("contradictions need two papers or more")
        spark = self.papers_.sparkSession
        asked = spark.createDataFrame([(p, i) for i, p in enumerate(paper_ids)], "paper_id long, ord int")
        own = retrieve.scoped(self._own(self.chunks), None, paper_ids)
        if vector is not None and self.vectors is not None:
            v = retrieve.scoped(self._own(self.vectors), None, paper_ids)
            near = v.select("paper_id", "section", dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])).alias("near"))
            own = own.join(near, ["paper_id", "section"])
        else:
            own = own.withColumn("near", lexical(F.array(*map(F.lit, self.terms(topic))).cast("array<string>"), F.col("content")))
        order = Window.partitionBy("paper_id").orderBy(F.desc("near"), F.desc("importance_score"), "id")
        top = own.withColumn("k", F.row_number().over(order)).where("k <= 5")
        texts = top.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]), "\n\n").alias("text"))
        return synth.contradiction_pairs(asked, topic, texts, verdict)

    def connections(self, paper_id: int) -> DataFrame:
        """Other papers near the paper's five most important chunks."""
        v = self._own(self.vectors)
        first = [F.desc("importance_score")] if "importance_score" in v.columns else []
        unique = [c for c in ("id", "section") if c in v.columns]
        return retrieve.connections(v.where(F.col("paper_id") == paper_id).orderBy(*first, *unique, F.xxhash64("embedding")).limit(5), v)

    def landscape(self, topic: str) -> DataFrame:
        return retrieve.landscape(self._own(self.papers_), topic)

    def reset_workspace(self) -> DataFrame:
        """Deletes the workspace's rows from all tables, those in tables too; returns how many went from each."""
        named = {"papers": "papers_", "chunks": "chunks", "entities": "entities", "links": "links", "relations": "relations", "vectors": "vectors", "hypotheses": "hypotheses_"}
        have = {k: getattr(self, a) for k, a in named.items() if getattr(self, a) is not None}
        left, counts = without_workspace(have | self.tables, self.workspace)
        for k in have:
            setattr(self, named[k], left[k])
        self.tables = {k: left[k] for k in self.tables}
        return counts
