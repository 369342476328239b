"""Text normalisation: Column in, Column out, all inside the JVM but for NFKC of non-ASCII batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quillmine.functions import lexicon as lx

#: Python's idea of \w, \s, \b for all letters; and lines that end at \n alone.
U = "(?U)"
LINES = "(?Umd)"


def _sub(x: Column, pattern: str, by: str, flags: str = U) -> Column:
    return F.regexp_replace(x, flags + pattern, by)


def unwound(pattern: str) -> str:
    """The pattern, with repeated groups `(?:...)*` that keep what they took: the JVM goes one call deeper for each repeat of a group that
    may give back, and some thousand of them overflow a task's stack. It finds the same where nothing can follow the group within it."""
    return pattern.replace(")*", ")*+")


#: A run of characters beyond ASCII. No ASCII character joins what stands before it; only marks join an ASCII one.
BEYOND_ASCII = r"[^\x00-\x7F]+"
LEADING_MARK = r"(?:^|\n)\p{M}"


@pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def nfkc(x: Column) -> Column:
    """NFKC; the JVM has no function for it, so a text's runs of characters beyond ASCII, a line each, go through Arrow and are put back in
    their places. A text goes whole where a run begins with a mark, which may join the letter before it."""
    runs = F.array_join(F.regexp_extract_all(x, F.lit(BEYOND_ASCII), F.lit(0)), "\n")
    whole = runs.rlike(LEADING_MARK)
    normal = _nfkc(F.when(whole, x).otherwise(runs))
    merged = F.array_join(F.zip_with(F.split(x, BEYOND_ASCII), F.split(normal, "\n"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(~x.rlike(BEYOND_ASCII), x).when(whole, normal).otherwise(merged)


def ligatures(x: Column) -> Column:
    for a, b in lx.LIGATURES.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def join_hyphens(x: Column) -> Column:
    return _sub(x, lx.HYPHEN_BREAK, "$1$2")


def drop_running_headers(x: Column) -> Column:
    return _sub(x, lx.RUNNING_HEADER, "", LINES)


def drop_page_numbers(x: Column) -> Column:
    return _sub(x, lx.PAGE_NUMBER, "", LINES)


def close_formulas(x: Column) -> Column:
    return _sub(x, lx.FORMULA_SPACE, "$1.$2")


def mark_citations(x: Column) -> Column:
    return _sub(_sub(x, unwound(lx.NUMERIC_CITATION), r"\[CITE\]"), lx.AUTHOR_CITATION, r"\[CITE\]")


def join_lines(x: Column) -> Column:
    return F.regexp_replace(x, lx.SINGLE_NEWLINE, " ")


def squeeze_spaces(x: Column) -> Column:
    return F.regexp_replace(x, lx.MULTI_SPACE, " ")


def drop_table_rows(x: Column) -> Column:
    return _sub(x, lx.TABLE_ROW, "", LINES)


def strip(x: Column) -> Column:
    return _sub(x, r"^\s+|\s+$", "")


def clean(x: Column, aggressive: bool = False, normalise: bool = True) -> Column:
    """The cleaning steps in their order; null and empty give the empty text. normalise=False leaves NFKC out."""
    x = F.coalesce(x, F.lit(""))
    x = ligatures(nfkc(x) if normalise else x)
    for step in (join_hyphens, drop_running_headers, drop_page_numbers, close_formulas, mark_citations, join_lines, squeeze_spaces):
        x = step(x)
    if aggressive:
        x = F.replace(drop_table_rows(x), F.lit(lx.CITE), F.lit(""))
        x = squeeze_spaces(F.regexp_replace(x, lx.SHORT_PARENTHESIS, ""))
    return strip(x)


def collapse(x: Column) -> Column:
    """Words of x with one space between."""
    return F.trim(_sub(x, r"\s+", " "))


def words(x: Column) -> Column:
    return F.filter(F.split(_sub(x, r"\s+", " "), " "), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def first_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(words(x), 1, n), " ")


def canonical_key(name: Column) -> Column:
    return _sub(F.lower(name), r"[\s\-_]", "")


def scoped_key(workspace: Column, name: Column) -> Column:
    return F.concat(workspace, F.lit(":"), canonical_key(name))


def singular(name: Column) -> Column:
    """Without a final s, where more than four characters stand."""
    x = collapse(name)
    return F.when(x.endswith("s") & (F.char_length(x) > 4), F.regexp_replace(x, "s$", "")).otherwise(x)


def phrase_name(phrase: Column) -> Column:
    """EHR as it is, other phrases with capitals."""
    out = F.initcap(phrase)
    for k, v in lx.ACRONYM_PHRASES.items():
        out = F.when(phrase == k, v).otherwise(out)
    return out


def relation_label(x: Column) -> Column:
    v = F.lower(strip(F.coalesce(x, F.lit(""))))
    return F.when(v.isin(*lx.RELATIONS), v).otherwise(lx.DEFAULT_RELATION)


def entity_label(x: Column) -> Column:
    v = F.upper(x)
    return (
        F.when(v.isin(*lx.ENTITY_TYPES), v)
        .when(v.isin("CHEMICAL_ENTITY", "DRUG"), "CHEMICAL")
        .when(v == "ORGANISM_TAXON", "ORGANISM")
        .otherwise("CONCEPT")
    )


def author_line(authors: Column) -> Column:
    n = F.size(authors)
    shown = F.array_join(F.slice(authors, 1, 4), ", ")
    return F.when(n.isNull() | (n <= 0), "No authors parsed").when(n > 4, F.concat(shown, F.lit(" +"), (n - 4).cast("string"))).otherwise(shown)


def recovered_json(x: Column) -> Column:
    """A variant of the JSON object in a model's reply: as it stands, without code fences, or from the first { to the last }."""
    bare = strip(F.regexp_replace(x, "```(?:json)?", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(bare), F.try_parse_json(F.nullif(inner, F.lit(""))))
