"""Lexical scores and entity predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmine.functions import lexicon as lx
from quillmine.functions.text import collapse

TOKEN = r"(?U)\b[a-z0-9-]+\b"
NAME_WORD = r"[A-Za-z][A-Za-z0-9-]*"


def query_terms(query: Column) -> Column:
    """Up to QUERY_TERMS words of the query, repeats included."""
    parts = F.split(F.lower(query), r"(?U)\W+")
    kept = F.filter(parts, lambda t: (F.char_length(t) >= lx.TERM_LETTERS) & ~t.isin(*lx.QUERY_STOP))
    return F.slice(kept, 1, lx.QUERY_TERMS)


def terms_of(query: str) -> list[str]:
    """The same for a query that is at hand, without a job."""
    return [t for t in re.split(r"\W+", query.lower()) if len(t) >= lx.TERM_LETTERS and t not in lx.QUERY_STOP][: lx.QUERY_TERMS]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bm25(terms: Column, toks: Column, mean_length: Column) -> Column:
    """Term saturation and length, without document frequency; each repeat of a term counts."""

    def summed(ts: Column) -> Column:
        length = F.greatest(F.size(ts), F.lit(1)) / F.greatest(mean_length, F.lit(1.0))
        norm = lx.K1 * (1 - lx.B + lx.B * length)
        return F.aggregate(terms, F.lit(0.0), lambda a, t: a + _saturated(F.size(F.filter(ts, lambda w: w == t)), norm))

    # In the lambda toks has a name, so it is computed once and not once for each term.
    return F.when(F.size(terms) == 0, lx.NO_TERMS_SCORE).otherwise(F.get(F.transform(F.array(toks), summed), F.lit(0)))


def _saturated(tf: Column, norm: Column) -> Column:
    return tf * (lx.K1 + 1) / (tf + norm)


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping places of term in text."""
    return ((F.char_length(text) - F.char_length(F.replace(text, term, F.lit("")))) / F.char_length(term)).cast("int")


def lexical(terms: Column, text: Column) -> Column:
    low = F.lower(text)
    n = F.greatest(F.size(terms), F.lit(1))
    hits = F.aggregate(terms, F.lit(0), lambda a, t: a + occurrences(low, t))
    coverage = F.size(F.filter(terms, lambda t: low.contains(t))) / n
    return F.when(F.size(terms) == 0, lx.NO_TERMS_SCORE).otherwise(F.least(F.lit(1.0), 0.25 + coverage * 0.55 + F.least(hits, F.lit(10)) * 0.03))


def hybrid(bm: Column, terms: Column, importance: Column, lex: Column) -> Column:
    share = F.least(bm / F.greatest(F.size(terms), F.lit(1)), F.lit(1.0))
    return F.round(0.45 * share + 0.40 * F.coalesce(importance, F.lit(0.0)) + 0.15 * lex, 4)


def valid_name(name: Column) -> Column:
    """Of the extractor: 2 to 80 characters, a letter, not made of blacklisted words."""
    x = collapse(F.coalesce(name, F.lit("")))
    parts = F.split(F.lower(x), " ")
    return F.char_length(x).between(2, 80) & x.rlike(r"\p{L}") & F.exists(parts, lambda w: ~w.isin(*lx.ENTITY_BLACKLIST))


def _is_upper(w: Column) -> Column:
    return (w == F.upper(w)) & w.rlike("[A-Za-z]")


def valid_entity(name: Column) -> Column:
    """Of the graph: no stop word, 3 to 90 characters, with a word; a single one has four letters or is upper case."""
    x = collapse(F.coalesce(name, F.lit("")))
    ws = F.regexp_extract_all(x, F.lit(NAME_WORD), F.lit(0))
    one = F.get(ws, F.lit(0))
    low = F.lower(one)
    titled = one.rlike("^[A-Z][a-z]*$")
    single = ~low.isin(*lx.GRAPH_STOP) & ((F.char_length(one) >= 4) | _is_upper(one)) & ~(titled & low.isin(*lx.GENERIC_TITLE_WORDS))
    return ~F.lower(x).isin(*lx.GRAPH_STOP) & F.char_length(x).between(3, 90) & (F.size(ws) > 0) & ((F.size(ws) > 1) | F.coalesce(single, F.lit(False)))


def strength(name: Column, kind: Column | None = None) -> Column:
    x = collapse(F.coalesce(name, F.lit("")))
    ws = F.regexp_extract_all(x, F.lit(NAME_WORD), F.lit(0))
    score = F.lit(1.0) + F.when(F.size(ws) >= 2, 1.0).otherwise(0.0)
    score = score + F.when(F.exists(ws, lambda w: _is_upper(w) & (F.char_length(w) >= 2)), 0.7).otherwise(0.0)
    if kind is not None:
        score = score + F.when(kind.isin(*lx.STRONG_TYPES), 0.8).otherwise(0.0)
    return F.when(valid_entity(name), score).otherwise(0.0)


def too_similar(a: Column, b: Column) -> Column:
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    inside = x.contains(y) | y.contains(x)
    return (x == y) | ((F.char_length(x) >= 4) & (F.char_length(y) >= 4) & inside)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in order, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
