"""Sentences, packing and chunk scores as array expressions: one row per text, no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmine.functions import lexicon as lx
from quillmine.functions.text import collapse, strip, word_count, words

CUT = "\x01"


def sentences(text: Column) -> Column:
    """Scientific sentences: cut after . ! ? before white space and a capital or digit, unless an abbreviation, a digit or a
    single letter stands before; pieces of MIN_SENTENCE characters and fewer are dropped."""
    return _sentences(text, r"(?U)([.!?])(?=\s+[A-Z\d])", r"(?U)(\S+)\s*[.!?]$", strip)


def flat_sentences(text: Column) -> Column:
    """The sentences of the text's words with one space between: no white space but spaces is left to look for."""
    return _sentences(collapse(text), r"([.!?])(?= +[A-Z\p{Nd}])", r"([^ ]+) *[.!?]$", lambda s: F.trim(s))


def _sentences(text: Column, stop: str, last: str, trimmed) -> Column:
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), stop, "$1" + CUT)
    pieces = F.split(marked, CUT)
    # Whether a cut stands is seen at the end of the piece before it; cuts that stand are marked again.
    kept = F.transform(pieces, lambda p: F.when(_no_cut(p, last), p).otherwise(F.concat(p, F.lit(CUT))))
    whole = F.transform(F.split(F.array_join(kept, ""), CUT), trimmed)
    return F.filter(whole, lambda s: F.char_length(s) > lx.MIN_SENTENCE)


def _no_cut(piece: Column, last: str) -> Column:
    """An abbreviation, a single letter or a digit stands before the stop. Only the piece's end is looked at."""
    end = F.right(piece, F.lit(64))
    token = F.regexp_extract(end, last, 1)
    bare = F.lower(F.regexp_replace(token, r"^[.!?;:,()\[\]{}]+|[.!?;:,()\[\]{}]+$", ""))
    return F.get(F.transform(F.array(bare), lambda b: b.isin(*lx.NO_BREAK) | b.rlike(r"^\p{L}$")), F.lit(0)) | end.rlike(r"\p{Nd}.$")


def naive_sentences(text: Column) -> Column:
    return F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), collapse)


def packed(parts: Column, most: int = lx.PACK_WORDS, overlap: int = 0, compat_prefix: bool = False) -> Column:
    """Sentences put together up to most words; each pack after the first begins with the last overlap sentences of the one
    before. compat_prefix keeps all of the sentences before instead, as packing without overlap is known to do elsewhere."""
    item = "struct<text:string,n:int>"
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast(f"array<{item}>").alias("now"), F.lit(0).alias("n")
    )
    sized = F.transform(parts, lambda s: F.struct(s.alias("text"), word_count(s).alias("n")))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: x["text"]), " ")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["n"])

    def tail(now: Column) -> Column:
        if compat_prefix and not overlap:
            return now
        if not overlap:
            return F.slice(now, 1, 0)
        return F.slice(now, F.greatest(F.size(now) - overlap + 1, F.lit(1)), F.lit(overlap))

    def add(acc: Column, s: Column) -> Column:
        full = (F.size(acc["now"]) > 0) & (acc["n"] + s["n"] > most)
        kept = tail(acc["now"])
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(text(acc["now"])))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, kept).otherwise(acc["now"]), F.array(s)).alias("now"),
            (F.when(full, total(kept)).otherwise(acc["n"]) + s["n"]).alias("n"),
        )

    last = lambda end: F.when(F.size(end["now"]) > 0, F.concat(end["done"], F.array(text(end["now"])))).otherwise(end["done"])
    return F.aggregate(sized, start, add, last)


def resized(parts: Column) -> Column:
    """Pieces over the token budget are halved at the middle word, once; then pieces under MIN_WORDS join the one before."""
    split = F.transform(parts, lambda p: F.struct(p.alias("p"), words(p).alias("w")))
    sized = F.transform(split, lambda x: F.struct(x["p"].alias("p"), x["w"].alias("w"), F.size(x["w"]).alias("n"), F.floor(F.size(x["w"]) / 2).cast("int").alias("h")))
    halves = F.flatten(
        F.transform(
            sized,
            lambda x: F.when(
                x["n"] * lx.TOKENS_PER_WORD > lx.MAX_TOKENS,
                F.array(F.array_join(F.slice(x["w"], F.lit(1), x["h"]), " "), F.array_join(F.slice(x["w"], x["h"] + 1, x["n"]), " ")),
            ).otherwise(F.array(x["p"])),
        )
    )

    def add(acc: Column, p: Column) -> Column:
        joins = (F.size(acc) > 0) & (word_count(p) < lx.MIN_WORDS)
        before = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(before, F.array(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), p)))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(halves, F.array().cast("array<string>"), add)


def overlapped(parts: Column, n: int = lx.OVERLAP_SENTENCES) -> Column:
    """Each part after the first begins with the last n sentences of the part before."""
    tails = F.transform(parts, lambda p: F.array_join(F.reverse(F.slice(F.reverse(flat_sentences(p)), 1, n)), " "))
    leads = F.concat(F.array(F.lit("")), tails)
    both = F.zip_with(parts, leads, lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    return F.transform(F.filter(both, lambda x: x["p"].isNotNull()), lambda x: F.when(x["t"] == "", x["p"]).otherwise(strip(F.concat_ws(" ", x["t"], x["p"]))))


def section_parts(section: Column, text: Column, sents: Column, compat_prefix: bool = False) -> Column:
    """Chunk texts of a section, given its sentences: whole, or packs of sentences, before overlap."""
    window = F.when(F.size(sents) <= 6, F.array(text)).otherwise(resized(packed(sents, compat_prefix=compat_prefix)))
    whole = section.isin(*lx.WHOLE_SECTIONS) | (word_count(text) < lx.SPLIT_WORDS)
    return F.when((strip(text) == "") | section.isin(*lx.DROPPED_SECTIONS), F.array().cast("array<string>")).when(whole, F.array(text)).otherwise(window)


def any_of(text: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def importance(section: Column, content: Column) -> Column:
    base = F.lit(lx.DEFAULT_WEIGHT)
    for s, w in lx.SECTION_WEIGHT.items():
        base = F.when(section == s, w).otherwise(base)
    low = F.lower(content)
    bonus = F.when(any_of(low, lx.CLAIM_TERMS), lx.CLAIM_BONUS).otherwise(0.0)
    bonus = bonus + F.when(content.rlike("(?U)" + lx.PERCENT), lx.PERCENT_BONUS).otherwise(0.0)
    bonus = bonus + F.when(any_of(low, lx.CONTRAST_TERMS), lx.CONTRAST_BONUS).otherwise(0.0)
    return F.least(F.lit(1.0), base + bonus)
