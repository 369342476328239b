"""Document structure: from layout lines (paper_id, page, ord, text, size, bold, y) to sections, titles, authors, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import lexicon as lx
from quillmine.functions.text import clean, collapse, strip

PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def normal_header(x: Column) -> Column:
    x = F.regexp_replace(strip(F.lower(x)), rf"^{PUNCTUATION}+|{PUNCTUATION}+$", "")
    return strip(F.regexp_replace(x, "(?U)" + lx.SECTION_PREFIX, ""))


def header(text: Column, size: Column, bold: Column) -> Column:
    """SKIP, a section, or null: what a line opens. Short lines alone are normalised, once, and looked up in one map."""
    table = F.create_map(*[F.lit(x) for kv in lx.HEADERS.items() for x in kv])
    opens = lambda n: F.when(n.isin(*lx.SKIP_HEADERS) & (bold | (size >= 10.5)), "SKIP").when(bold | (size >= 11), F.try_element_at(table, n))
    return F.when(F.char_length(text) < 80, F.get(F.transform(F.array(normal_header(text)), opens), F.lit(0)))


def sections(lines: DataFrame) -> DataFrame:
    """paper_id, section, ord, text: lines carried to the last header before them, headers and skipped regions left out; a
    section that comes again is continued. Ordered by each section's first line."""
    rows = lines.where(strip(F.col("text")) != "").withColumn("header", header(F.col("text"), F.col("size"), F.col("bold")))
    here = Window.partitionBy("paper_id").orderBy("page", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(here), F.lit("other")))
    body = rows.where(F.col("header").isNull() & (F.col("section") != "SKIP"))
    joined = body.groupBy("paper_id", "section").agg(F.array_sort(F.collect_list(F.struct("page", "ord", "text"))).alias("lines"))
    return joined.select(
        "paper_id", "section", F.col("lines")[0]["page"].alias("page"), F.col("lines")[0]["ord"].alias("ord"),
        F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"),
    )


def materialised(found: DataFrame) -> DataFrame:
    return found.withColumn("text", clean(F.col("text"))).where(F.col("text") != "")


def simple_sections(texts: DataFrame) -> DataFrame:
    """Sections of plain text (paper_id, text) as a mapping would hold them: every line may be a header, and what stands under a
    skipped header is kept, as SKIP."""
    rows = plain_lines(texts).withColumn("header", header(F.col("text"), F.col("size"), F.col("bold")))
    here = Window.partitionBy("paper_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(here), F.lit("other"))).where(F.col("header").isNull())
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return rows.groupBy("paper_id", "section").agg(F.array_join(lines, "\n").alias("text"), F.min("ord").alias("ord"))


def plain_lines(texts: DataFrame) -> DataFrame:
    """Lines of plain text (paper_id, text): every one counts as bold and of size 12."""
    x = texts.select("paper_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return x.where(strip(F.col("text")) != "").select(
        "paper_id", F.lit(0).alias("page"), "ord", strip(F.col("text")).alias("text"), F.lit(12.0).alias("size"), F.lit(True).alias("bold"), F.col("ord").cast("double").alias("y")
    )


def titles(lines: DataFrame) -> DataFrame:
    """paper_id, title: of the lines in the upper part of the first page that can be a title, the largest, then the lowest."""
    first = lines.where("page = 0").withColumn("text", strip(F.col("text"))).withColumn("top", F.max("y").over(Window.partitionBy("paper_id")) * 0.45)
    n, text = normal_header(F.col("text")), F.col("text")
    ok = (F.col("y") <= F.col("top")) & F.char_length(text).between(15, 280)
    for p in lx.TITLE_EXCLUDE:
        ok = ok & ~text.rlike(p)
    ok = ok & ~n.isin(*lx.HEADERS, *lx.SKIP_HEADERS) & (text != F.upper(text))
    order = Window.partitionBy("paper_id").orderBy(F.desc("size"), F.desc("y"), "ord")
    best = first.where(ok).withColumn("k", F.row_number().over(order)).where("k = 1").select("paper_id", F.col("text").alias("title"))
    return lines.select("paper_id").distinct().join(best, "paper_id", "left").select("paper_id", F.coalesce("title", F.lit(lx.UNKNOWN_TITLE)).alias("title"))


def authors(lines: DataFrame, found: DataFrame) -> DataFrame:
    """paper_id, authors: names on the first page's lines below the title; each once whatever its case, twelve at most."""
    top = F.max("y").over(Window.partitionBy("paper_id"))
    first = lines.where("page = 0").withColumn("text", strip(F.col("text"))).withColumn("top", top).join(found, "paper_id", "left")
    low = F.lower("text")
    ok = (F.col("y") > F.col("top") * 0.08) & (F.col("y") < F.col("top") * 0.52)
    ok = ok & (F.col("size") > 8.5) & (F.col("size") < 13.5) & (F.char_length("text") <= 180)
    ok = ok & ~F.coalesce((F.col("title") != "") & low.contains(F.lower(F.substring("title", 1, 30))), F.lit(False)) & ~F.col("text").rlike(r"\d{3,}")
    for s in lx.AFFILIATIONS:
        ok = ok & ~low.contains(s)
    parts = first.where(ok).select("paper_id", "ord", F.posexplode(F.split("text", "(?U)" + lx.AUTHOR_SPLIT)).alias("at", "part"))
    parts = parts.withColumn("name", strip(F.regexp_replace(strip(F.col("part")), lx.AUTHOR_MARKS, "")))
    names = parts.where((F.char_length("name") > 4) & (F.char_length("name") < 60) & F.col("name").rlike(lx.AUTHOR_NAME))
    once = names.groupBy("paper_id", F.lower("name").alias("key")).agg(F.min(F.struct("ord", "at", "name")).alias("f"))
    return once.groupBy("paper_id").agg(F.slice(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["name"]), 1, 12).alias("authors"))


def abstract_of(text: Column) -> Column:
    return strip(F.regexp_extract(text, lx.ABSTRACT, 1))


def references(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, lx.REFERENCE_SPLIT), strip), lambda x: F.char_length(x) > 10)


def year_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, lx.YEAR, 0), F.lit("")).cast("int")


def doi_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, lx.DOI, 0), F.lit(""))


def metadata(papers: DataFrame) -> DataFrame:
    """papers (id, title, abstract, metadata) with publication_year and doi; a DOI that an earlier paper has becomes null."""
    hay = F.concat_ws(" ", "title", "abstract", "metadata")
    rows = papers.withColumn("publication_year", year_of(hay)).withColumn("doi", doi_of(hay))
    return unique_dois(rows)


def unique_dois(papers: DataFrame) -> DataFrame:
    """The first paper by id keeps a DOI; the first per DOI is found by an aggregate, so a DOI of many papers is no hot group."""
    first = papers.where("doi is not null").groupBy("doi").agg(F.min("id").alias("id")).withColumn("qm_first", F.lit(True))
    rows = papers.join(first, ["doi", "id"], "left")
    return rows.withColumn("doi", F.when(F.col("qm_first"), F.col("doi"))).drop("qm_first")


def page_lines(pages: DataFrame) -> DataFrame:
    """Layout lines of web pages (page_id, html): headings large and bold, paragraphs plain."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    marked = F.regexp_replace(body, r"(?i)<(h[1-6]|title)\b[^>]*>", "\n\u0002")
    marked = F.regexp_replace(marked, r"(?i)</?(p|div|li|ul|ol|br|h[1-6]|article|nav|footer|title|body|head)\b[^>]*>", "\n")
    plain = F.regexp_replace(marked, r"<[^>]*>", "")
    x = pages.select(F.col("page_id").alias("paper_id"), F.posexplode(F.split(plain, "\n")).alias("ord", "raw"))
    x = x.withColumn("bold", F.col("raw").contains("\u0002")).withColumn("text", collapse(F.replace("raw", F.lit("\u0002"), F.lit(""))))
    return x.where(F.col("text") != "").select(
        "paper_id", F.lit(0).alias("page"), "ord", "text", F.when(F.col("bold"), 16.0).otherwise(10.0).alias("size"), "bold", F.col("ord").cast("double").alias("y")
    )
