"""Entity extraction from chunks (paper_id, id, content, importance_score) by patterns, phrases and capitals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import lexicon as lx
from quillmine.functions.scores import occurrences, valid_name
from quillmine.functions.text import canonical_key, clean, collapse, phrase_name, scoped_key, unwound


#: A model sees so many characters of a paper.
REFINED_CHARACTERS = 6000


def selected(chunks: DataFrame) -> DataFrame:
    """The important chunks of each paper; of a paper without one the best FALLBACK_CHUNKS."""
    high = F.col("importance_score") >= lx.IMPORTANT
    # Both look at the rows in one order, so the texts are sorted once.
    per = Window.partitionBy("paper_id").orderBy(F.desc("importance_score"), "id")
    whole = per.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = chunks.select("*", F.count_if(high).over(whole).alias("n_high"), F.row_number().over(per).alias("k"))
    return rows.where(high | ((F.col("n_high") == 0) & (F.col("k") <= lx.FALLBACK_CHUNKS))).drop("n_high", "k")


def texts(chunks: DataFrame) -> DataFrame:
    """paper_id, text: the selected chunks of each paper, cleaned hard."""
    joined = selected(chunks).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("c"))
    return joined.select("paper_id", clean(F.array_join(F.transform("c", lambda x: x["content"]), "\n\n"), aggressive=True).alias("text"))


def _patterns() -> list[Column]:
    """For each pattern what it finds in text."""
    found = []
    for kind, patterns in lx.NER_PATTERNS.items():
        for i, p in enumerate(patterns):
            flags = "(?U)" if not p.startswith("(?i)") else "(?Ui)"
            names = F.regexp_extract_all("text", F.lit(flags + unwound(p.removeprefix("(?i)"))), F.lit(1))
            found.append(_named(names, kind, i))
    return found


def pattern_names(rows: DataFrame) -> DataFrame:
    """paper_id, type, name, n, first: names that the patterns find in rows (paper_id, text)."""
    hits = rows.select("paper_id", F.explode(F.flatten(F.array(*_patterns()))).alias("h")).select("paper_id", "h.*")
    return hits.where(valid_name(F.col("name"))).groupBy("paper_id", "type", "name").agg(F.count("*").alias("n"), F.min("first").alias("first"))


def _named(names, kind: str, i: int):
    return F.transform(names, lambda x, k: F.struct(F.lit(kind).alias("type"), collapse(x).alias("name"), (F.lit(i * 1_000_000) + k).alias("first")))


def canonical(names: DataFrame, top: int = lx.NER_TOP, by: tuple[str, ...] = (), held: Column | None = None) -> DataFrame:
    """Of spellings with one key the most frequent, then shortest, then first; of each type the top names. Columns of `by` keep rows
    apart; rows for which held is true stay as they are: names (paper_id, type, name and by) that are there once."""
    held = F.lit(False) if held is None else held
    spelt = F.when(held, F.col("name")).otherwise(canonical_key(F.col("name")))
    key = Window.partitionBy("paper_id", *by, "type", spelt).orderBy(F.desc("n"), F.char_length("name"), "first", "name")
    one = names.withColumn("k", F.row_number().over(key)).where("k = 1").drop("k")
    best = Window.partitionBy("paper_id", *by, "type").orderBy(F.desc("n"), F.lower("name"), "name")
    return one.withColumn("k", F.row_number().over(best)).where(held | (F.col("k") <= top)).drop("k")


def _phrases() -> Column:
    low = F.lower("text")
    hits = F.array(*[F.struct(F.lit(kind).alias("type"), phrase_name(F.lit(p)).alias("name"), occurrences(low, F.lit(p)).alias("n")) for p, kind in lx.PHRASES.items()])
    return F.filter(hits, lambda h: h["n"] > 0)


def phrase_names(rows: DataFrame) -> DataFrame:
    """Known phrases, anywhere in the text, with the number of their places."""
    return rows.select("paper_id", F.explode(_phrases()).alias("h")).select("paper_id", "h.type", "h.name", F.col("h.n").cast("long").alias("n"))


def _concepts() -> Column:
    return F.regexp_extract_all("text", F.lit("(?U)" + lx.CONCEPT), F.lit(0))


def concept_names(rows: DataFrame) -> DataFrame:
    names = rows.select("paper_id", F.explode(_concepts()).alias("name"))
    ok = ~F.col("name").isin(*lx.CONCEPT_STOP) & valid_name(F.col("name"))
    return names.where(ok).groupBy("paper_id", F.lit("CONCEPT").alias("type"), "name").agg(F.count("*").alias("n"))


def top_names(parts: list[DataFrame], top: int = lx.TYPE_TOP) -> DataFrame:
    """paper_id, type, name, n: the top names per type; a name's number counts all types that it came up in."""
    rows = reduce(DataFrame.unionByName, [p.select("paper_id", "type", "name", "n") for p in parts])
    typed = rows.groupBy("paper_id", "name", "type").agg(F.sum("n").alias("own"))
    total = typed.withColumn("n", F.sum("own").over(Window.partitionBy("paper_id", "name")))
    best = Window.partitionBy("paper_id", "type").orderBy(F.desc("n"), F.lower("name"), "name")
    return total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("paper_id", "type", "name", "n", "rank")


def refined(rows: DataFrame, names: DataFrame, refine: Callable[[str, dict], dict]) -> DataFrame:
    """Names (paper_id, type, name, n, rank) after a model has gone over them: refine(text, {type: names}) returns the names that
    stand, by type. Where it fails a paper's names stay. rows: paper_id, text; names that are new have n 1."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "n"))), lambda x: F.struct(x["name"].alias("name"), x["n"].cast("long").alias("n")))
    per = names.groupBy("paper_id", "type").agg(order.alias("names"))
    per = per.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "names"))).alias("by_type"))
    asked = per.join(rows.select("paper_id", F.substring("text", 1, REFINED_CHARACTERS).alias("text")), "paper_id")

    def run(frames):
        for frame in frames:
            made = []
            for pid, by_type, text in zip(frame["paper_id"], frame["by_type"], frame["text"], strict=True):
                had = {t: {x["name"]: x["n"] for x in xs} for t, xs in (by_type.items() if hasattr(by_type, "items") else by_type)}
                try:
                    kept = refine(text, {t: list(xs) for t, xs in had.items()})
                except Exception:  # noqa: BLE001  the model is foreign code
                    kept = {t: list(xs) for t, xs in had.items()}
                made += [(pid, t, x, had.get(t, {}).get(x, 1), i + 1) for t, xs in kept.items() for i, x in enumerate(xs)]
            yield pd.DataFrame(made, columns=["paper_id", "type", "name", "n", "rank"])

    return asked.select("paper_id", "by_type", "text").mapInPandas(run, "paper_id long, type string, name string, n long, rank int")


def found_names(rows: DataFrame) -> DataFrame:
    """paper_id, source, type, name, n, first: what pattern_names (source 0), phrase_names (1) and concept_names (2) find, in one pass."""
    hit = lambda source, kind, name, n, first: F.struct(F.lit(source).alias("source"), kind.alias("type"), name.alias("name"), n.cast("long").alias("n"), first.cast("long").alias("first"))
    every = [F.transform(p, lambda x: hit(0, x["type"], x["name"], F.lit(1), x["first"])) for p in _patterns()]
    every.append(F.transform(_phrases(), lambda x: hit(1, x["type"], x["name"], x["n"], F.lit(0))))
    every.append(F.transform(_concepts(), lambda x: hit(2, F.lit("CONCEPT"), x, F.lit(1), F.lit(0))))
    hits = rows.select("paper_id", F.explode(F.flatten(F.array(*every))).alias("h")).select("paper_id", "h.*")
    name = F.col("name")
    ok = (F.col("source") == 1) | (valid_name(name) & ((F.col("source") == 0) | ~name.isin(*lx.CONCEPT_STOP)))
    return hits.where(ok).groupBy("paper_id", "source", "type", "name").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def extracted(chunks: DataFrame, extra: list[DataFrame] | None = None) -> DataFrame:
    """All of it for chunks, whose texts are read, cleaned and looked through once; extra takes names that an outside recogniser found
    (paper_id, type, name, n)."""
    names = canonical(found_names(texts(chunks)), by=("source",), held=F.col("source") > 0)
    return top_names([names, *(extra or [])])


def upserted(existing: DataFrame | None, names: DataFrame) -> DataFrame:
    """Entities (workspace_id, entity_type, normalized_name, name, paper_count) after the names (paper_id, workspace_id, type,
    name, rank): each name adds one to its key's count; a new key takes the name that came first."""
    new = names.groupBy("workspace_id", F.col("type").alias("entity_type"), scoped_key(F.col("workspace_id"), F.col("name")).alias("normalized_name")).agg(
        F.min_by("name", F.struct("paper_id", "rank", "name")).alias("name"), F.count("*").alias("paper_count")
    )
    if existing is None:
        return new
    both = existing.select(*new.columns, F.lit(0).alias("src")).unionByName(new.withColumn("src", F.lit(1)))
    return both.groupBy("workspace_id", "entity_type", "normalized_name").agg(F.min_by("name", "src").alias("name"), F.sum("paper_count").alias("paper_count"))


def link_frequency(names: DataFrame) -> DataFrame:
    """Per exact name of a paper: the type it is linked under (the last in the order of types that holds it), the number of
    the paper's list places with its lower-cased name (slot_frequency), and its true number of mentions."""
    order = F.lit(-1)
    for i, t in enumerate(lx.ENTITY_TYPES):
        order = F.when(F.col("type") == t, i).otherwise(order)
    slots = names.withColumn("slots", F.count("*").over(Window.partitionBy("paper_id", F.lower(F.trim("name")))))
    return slots.withColumn("at", order).groupBy("paper_id", "name").agg(
        F.max_by("type", "at").alias("type"), F.first("slots").cast("int").alias("slot_frequency"), F.max("n").alias("mention_count")
    )
