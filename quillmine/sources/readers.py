"""Where rows come from: PDF bytes, layout lines, Atom metadata, stored relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.functions.text import collapse

LINES = "paper_id long, page int, ord int, text string, size double, bold boolean, y double"


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of each PDF under path, whatever its suffix's case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").endswith(".pdf")).select("path", "length", "content")


PENDING = "id long, workspace_id string, title string, authors array<string>, pdf_path string, arxiv_id string, processing_status string"


def paper_id(key: Column) -> Column:
    """A 60-bit id, the same for the same key on every machine."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def uploaded(files: DataFrame, workspace: str) -> DataFrame:
    """Pending papers of files (path): a row each that is named as a PDF, under its file name. A file sent twice is one paper."""
    pdfs = files.where(F.lower("path").endswith(".pdf")).select("path").distinct()
    name = F.element_at(F.split("path", "/"), -1)
    return _pending(pdfs, workspace, F.concat_ws(":", F.lit(workspace), "path"), name, F.col("path"), F.lit(None))


def requested(ids: DataFrame, workspace: str) -> DataFrame:
    """Pending papers of arXiv ids (arxiv_id)."""
    one = ids.select("arxiv_id").where("arxiv_id is not null").distinct()
    return _pending(one, workspace, F.concat_ws(":", F.lit(workspace), F.lit("arxiv"), "arxiv_id"), F.concat(F.lit("arXiv:"), "arxiv_id"), F.lit(None), F.col("arxiv_id"))


def _pending(rows: DataFrame, workspace: str, key: Column, title: Column, path: Column, arxiv: Column) -> DataFrame:
    return rows.select(
        paper_id(key).alias("id"), F.lit(workspace).alias("workspace_id"), title.alias("title"), F.array().cast("array<string>").alias("authors"),
        path.cast("string").alias("pdf_path"), arxiv.cast("string").alias("arxiv_id"), F.lit("pending").alias("processing_status"),
    )


def layout(files: DataFrame, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """Lines of files (paper_id, content) by a parser that is handed in: bytes to dicts of page, ord, text, size, bold, y.

    A file that the parser rejects gives no line; its paper is then failed, and the job goes on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["paper_id", "page", "ord", "text", "size", "bold", "y"]
        for frame in frames:
            rows: list[dict] = []
            for pid, content in zip(frame["paper_id"], frame["content"], strict=True):
                try:
                    rows += [{"paper_id": pid, **line} for line in parse(content)]
                except Exception:  # noqa: BLE001  the parser is foreign code
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.select("paper_id", "content").mapInPandas(run, LINES)


def span_lines(spans: DataFrame) -> DataFrame:
    """Lines of spans (paper_id, page, ord, span, text, size, font, y): texts joined, the largest size, bold if any font says so."""
    one = spans.groupBy("paper_id", "page", "ord").agg(
        F.array_sort(F.collect_list(F.struct("span", "text"))).alias("s"), F.max("size").alias("size"), F.max(F.lower("font").contains("bold")).alias("bold"), F.min("y").alias("y")
    )
    text = F.trim(F.array_join(F.transform("s", lambda x: x["text"]), " "))
    return one.select("paper_id", "page", "ord", text.alias("text"), "size", "bold", "y").where("text <> ''")


def atom_entry(xml: Column) -> Column:
    """struct(title, abstract, authors, published) of the first entry of an Atom document, null without one."""
    entry = "/*[local-name()='feed']/*[local-name()='entry'][1]"
    at = lambda name: F.xpath_string(xml, F.lit(f"{entry}/*[local-name()='{name}']"))
    names = F.xpath(xml, F.lit(f"{entry}/*[local-name()='author']/*[local-name()='name']/text()"))
    made = F.struct(collapse(at("title")).alias("title"), collapse(at("summary")).alias("abstract"), names.alias("authors"), at("published").alias("published"))
    return F.when(F.xpath_boolean(xml, F.lit(entry)), made)


def with_atom(papers: DataFrame, entries: DataFrame) -> DataFrame:
    """papers (id, arxiv_id, title, authors, abstract) where what entries (arxiv_id, xml) say comes first."""
    e = entries.select("arxiv_id", atom_entry(F.col("xml")).alias("e"))
    first = lambda c, d: F.coalesce(F.nullif(F.col(f"e.{c}"), F.lit("")), F.col(d)).alias(d)
    kept = [F.col(c) for c in papers.columns if c not in ("title", "authors", "abstract")]
    authors = F.when(F.size("e.authors") > 0, F.col("e.authors")).otherwise(F.col("authors")).alias("authors")
    return papers.join(e, "arxiv_id", "left").select(*kept, first("title", "title"), authors, first("abstract", "abstract"))


class Fetcher:
    """A source behind a network: fetch(id) to bytes is handed in; without it, reading says what is missing."""

    def __init__(self, name: str, fetch: Callable[[str], bytes] | None = None):
        self.name, self.fetch = name, fetch

    def read(self, ids: DataFrame, column: str) -> DataFrame:
        if self.fetch is None:
            raise RuntimeError(f"{self.name} needs a fetch function; this engine opens no network connection by itself")
        get = self.fetch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"id": frame[column], "content": [get(x) for x in frame[column]]})

        return ids.select(column).mapInPandas(run, "id string, content binary")
