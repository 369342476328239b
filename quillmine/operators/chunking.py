"""Chunks of sections (paper_id, section, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import lexicon as lx
from quillmine.functions.scores import dot
from quillmine.functions.segments import flat_sentences, importance, overlapped, resized, section_parts
from quillmine.functions.text import clean, word_count


def chunked(sections: DataFrame, compat_prefix: bool = False) -> DataFrame:
    """paper_id, section, sub_index, content, importance_score, word_count, embedding_id; row-local, nothing is shuffled."""
    rows = sections.withColumn("text", clean(F.col("text"))).withColumn("sents", flat_sentences(F.col("text")))
    raw = rows.withColumn("raw", section_parts(F.col("section"), F.col("text"), F.col("sents"), compat_prefix))
    parts = raw.withColumn("parts", overlapped(F.col("raw")))
    # The outer form, as the plain one puts all of the above into a filter too, on the parts' size.
    out = parts.select("paper_id", "section", F.posexplode_outer("parts").alias("sub_index", "content")).where("content is not null")
    return out.select(
        "paper_id", "section", "sub_index", "content",
        importance(F.col("section"), F.col("content")).alias("importance_score"),
        word_count(F.col("content")).alias("word_count"),
        F.concat_ws("_", F.concat(F.lit("p"), F.col("paper_id").cast("string")), "section", F.col("sub_index").cast("string")).alias("embedding_id"),
    )


def semantic_cuts(sentences: DataFrame, least: float = lx.SEMANTIC_CUT) -> DataFrame:
    """sentences (paper_id, section, place, text, embedding) with part: it rises where a sentence is unlike the one before."""
    order = Window.partitionBy("paper_id", "section").orderBy("place")
    like = dot(F.col("embedding"), F.lag("embedding").over(order))
    rows = sentences.withColumn("similarity", like)
    return rows.withColumn("part", F.sum((F.coalesce(F.col("similarity") < least, F.lit(False))).cast("int")).over(order))


def semantic_parts(sentences: DataFrame, least: float = lx.SEMANTIC_CUT) -> DataFrame:
    """paper_id, section, parts: sentences put together by semantic_cuts, resized; six sentences and fewer stay whole."""
    rows = semantic_cuts(sentences, least)
    n = F.count("*").over(Window.partitionBy("paper_id", "section"))
    rows = rows.withColumn("part", F.when(n <= 6, 0).otherwise(F.col("part")))
    one = rows.groupBy("paper_id", "section", "part").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["text"]), " ")
    joined = one.groupBy("paper_id", "section").agg(F.array_sort(F.collect_list(F.struct("part", text.alias("text")))).alias("p"))
    return joined.select("paper_id", "section", resized(F.transform("p", lambda x: x["text"])).alias("parts"))
