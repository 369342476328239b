"""Substring dedup by repeated-phrase automata: passages of 50 words that recur across documents.

1. Each text's windows of 50 words name the phrase of 32 words with the least digest inside them. Two equal windows
   name the same phrase, so only phrases that two documents name can belong to a passage that recurs.
2. The confirmed phrases are spelled out from the first document that names them and dealt to shards by that document, so
   phrases of one passage meet in one shard. Each shard compiles them to an Aho-Corasick automaton over bytes.
3. Each document is streamed through every shard that could match, those whose phrases its windows name. The automaton
   alone says where phrases occur; it compares bytes, and nothing is removed that it has not located. Shards with many
   documents are split, each part with the same automaton.
4. Windows that name a located phrase are compared by 128-bit digests over the cluster: the smallest doc_id of each is its
   home, and every other document loses the words under it.

Documents with the same words count once: all but the one of smallest doc_id are repeats from end to end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import hot_join, stored
from quillmine.llm.words import Words, chunks, sliding, spans_digest, words

WINDOW = 50
PHRASE = 32
#: Phrases of one automaton, about, and words that one task streams through it, about.
SHARD_PHRASES = 2_000
SHARD_WORDS = 1_000_000
#: Another odd base, for the second half of a window's digest.
BASE2 = np.uint64(0xA24BAED4963EE407)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def kept_sha(text: bytes, keep: np.ndarray | None = None) -> str:
    parts = text.split()
    if keep is not None:
        parts = [w for w, k in zip(parts, keep, strict=True) if k]
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _phrases(digest: np.ndarray, phrase: int) -> np.ndarray:
    """Digest of the phrase that begins at each word, as if all words were one text."""
    if len(digest) < phrase:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(len(digest) - phrase + 1)
    return spans_digest(digest, at, at + phrase)


def _named(w: Words, p: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows, digest of the phrase that each names)."""
    low = sliding(p, window - phrase + 1)
    starts = np.arange(len(low))
    inside = w.doc[starts] == w.doc[starts + window - 1]
    return starts[inside], low[inside]


def _scan(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """doc_id, tkey, n_words, sha, phrases: the digests that the text's windows name."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            texts = b.column(2)
            for i, k in chunks(texts):
                part = b.slice(i, k)
                w = words(part.column(2))
                starts, named = _named(w, _phrases(w.digests(), phrase), window, phrase)
                doc = w.doc[starts]
                order = np.lexsort((named, doc))
                d, p = doc[order], named[order]
                first = np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1]))[: len(d)]
                # One row of a task's repeats names the phrases.
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                fresh = np.array([not (r in seen or seen.add(r)) for r in rows], dtype=bool)
                first &= fresh[d]
                d, p = d[first], p[first]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(k + 1)).astype(np.int32)), pa.array(p.view(np.int64)))
                data = w.data.tobytes()
                shas = [kept_sha(data[w.at[j] : w.at[j + 1]]) for j in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(w.first)), pa.array(shas), lists], ["doc_id", "tkey", "n_words", "sha", "phrases"]
                )

    return rows.mapInArrow(scan, "doc_id long, tkey long, n_words long, sha string, phrases array<long>")


def _once(rows: DataFrame) -> DataFrame:
    """rows (doc_id, tkey, text), each (doc_id, tkey) once a task, so that a row that repeats a million times moves a few times."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            yield b.filter(pa.array([not (k in seen or seen.add(k)) for k in keys], pa.bool_()))

    return rows.mapInArrow(once, rows.schema)


def _spell(texts: DataFrame, phrase: int) -> DataFrame:
    """shard, phrase: the words of the phrases whose digests are in own, one space around each. texts: shard, text, own."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, made = [], []
            for shard, text, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                w = words(pa.array([text.as_py()], pa.large_string()))
                p = _phrases(w.digests(), phrase)
                at = np.flatnonzero(np.isin(p, np.array(own.as_py(), dtype=np.int64).view(np.uint64)))
                for s in at[np.unique(p[at], return_index=True)[1]].tolist():
                    made.append(_line(w.data[w.start[s] : w.end[s + phrase - 1]].tobytes().split()))
                    shards.append(shard)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(made, pa.binary())], ["shard", "phrase"])

    return texts.select("shard", "text", "own").mapInArrow(spell, "shard int, phrase binary")


def _line(parts: list[bytes]) -> bytes:
    return b" " + b" ".join(parts) + b" "


def compiled(spelled: list[bytes]) -> "ahocorasick.Automaton | None":
    """The automaton of phrases as _spell has them, None for none. Bytes go as the characters of the same numbers."""
    if not spelled:
        return None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for x in spelled:
        automaton.add_word(x.decode("latin-1"))
    automaton.make_automaton()
    return automaton


def occurrences(automaton: "ahocorasick.Automaton | None", w: Words, phrase: int) -> np.ndarray:
    """For each word whether a phrase begins there that the automaton finds; it sees each text with single spaces."""
    hit = np.zeros(len(w.start), dtype=bool)
    data = w.data.tobytes()
    for j in range(len(w.first) - 1 if automaton is not None else 0):
        a, z = int(w.first[j]), int(w.first[j + 1])
        if z - a >= phrase:
            ends = [e for e, _ in automaton.iter(_line(data[w.at[j] : w.at[j + 1]].split()).decode("latin-1"))]
            if ends:
                # Word i of the text ends before the space at this place.
                space = np.cumsum(w.end[a:z] - w.start[a:z] + 1)
                hit[np.searchsorted(space, np.array(ends)) + (a - phrase + 1)] = True
    return hit


def _windows(w: Words, hit: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, two digests) of each window that names a phrase at a place where hit has it."""
    digest = w.digests()
    p = _phrases(digest, phrase)
    starts, named = _named(w, p, window, phrase)
    low_hit = sliding(np.where(hit[: len(p)], p, np.uint64(2**64 - 1)), window - phrase + 1)[starts]
    starts = starts[(low_hit == named) & (named != np.uint64(2**64 - 1))]
    if not len(starts):
        return starts, digest[:0], digest[:0]
    return starts, spans_digest(digest, starts, starts + window), spans_digest(w.digests(BASE2), starts, starts + window, BASE2)


def _locate(visits: DataFrame, spelled: DataFrame, window: int, phrase: int) -> DataFrame:
    """doc_id, tkey, start, h1, h2: the windows that name a phrase which a shard's automaton has located.

    visits: shard, part, doc_id, tkey, text; spelled: shard, part, phrase. A group is one part of one shard."""

    def locate(texts: pa.Table, phrases: pa.Table) -> pa.Table:
        automaton = compiled(phrases.column("phrase").to_pylist())
        out = []
        texts = texts.combine_chunks()
        for b in texts.to_batches():
            column = b.column(b.schema.get_field_index("text"))
            for i, k in chunks(column):
                w = words(column.slice(i, k))
                hit = occurrences(automaton, w, phrase)
                if not hit.any():
                    continue
                starts, h1, h2 = _windows(w, hit, window, phrase)
                doc = pa.array(w.doc[starts] + i)
                ids = [b.column(b.schema.get_field_index(c)).take(doc) for c in ("doc_id", "tkey")]
                columns = [*ids, pa.array((starts - w.first[w.doc[starts]]).astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
                out.append(pa.RecordBatch.from_arrays(columns, ["doc_id", "tkey", "start", "h1", "h2"]))
        schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("start", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
        return pa.Table.from_batches([o.cast(schema) for o in out], schema)

    return (
        visits.groupBy("shard", "part")
        .cogroup(spelled.groupBy("shard", "part"))
        .applyInArrow(locate, "doc_id long, tkey long, start int, h1 long, h2 long")
    )


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, tkey, n_removed, kept_sha256. rows: doc_id, tkey, text, gone: the starts of windows to remove."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, shas = [], []
            for text, gone in zip(b.column(2), b.column(3), strict=True):
                data = text.as_py().encode()
                edge = np.zeros(len(data.split()) + 1, dtype=np.int64)
                at = np.unique(gone.values.to_numpy())
                edge[at] += 1
                edge[at + window] -= 1
                keep = np.cumsum(edge)[:-1] == 0
                removed.append(int((~keep).sum()))
                shas.append(kept_sha(data, keep))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(shas)], ["doc_id", "tkey", "n_removed", "kept_sha256"])

    return rows.mapInArrow(cut, "doc_id long, tkey long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window over it has a word sequence that also begins in a document of smaller doc_id. Null and empty
    texts, and texts shorter than a window, lose nothing. A null doc_id is neither smaller nor larger than another. Rows
    that share a doc_id don't take from each other; repeated rows get equal results. An empty table gives no row; other
    columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    scanned = stored(_scan(rows, window, phrase), "phrases-scan")
    able = scanned.where(F.col("n_words") >= window).where("doc_id is not null")
    homes = stored(able.groupBy("sha").agg(F.min("doc_id").alias("home"), F.count("*").alias("n")), "phrases-homes")
    first = able.where(F.size("phrases") > 0).join(homes.select("sha", F.col("home").alias("doc_id")), ["sha", "doc_id"]).dropDuplicates(["doc_id", "tkey"])
    named = stored(first.select("doc_id", "tkey", F.explode("phrases").alias("phrase")), "phrases-named")
    place = F.struct("doc_id", "tkey")
    confirmed = named.groupBy("phrase").agg(F.min(place).alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("qm_n")).where("lo.doc_id < hi")
    confirmed = stored(confirmed.select("phrase", "lo", "qm_n"), "phrases-confirmed")
    shards = max(1, -(-confirmed.count() // SHARD_PHRASES))
    shard = F.pmod(F.xxhash64("lo"), F.lit(shards)).cast("int")
    asked = hot_join(named, confirmed.select("phrase", "lo", shard.alias("shard")), ["phrase"], counts=confirmed.select("phrase", "qm_n"))
    visits = stored(asked.groupBy("doc_id", "tkey", "shard").agg(F.collect_list(F.when(F.col("lo") == place, F.col("phrase"))).alias("own")), "phrases-visits")
    visitors = visits.select("doc_id", "tkey").distinct()
    texts = stored(_once(rows).join(visitors, ["doc_id", "tkey"], "left_semi").dropDuplicates(["doc_id", "tkey"]), "phrases-texts")
    # A shard's parts hold SHARD_WORDS words or so, and each part the shard's whole automaton.
    sizes = first.select("doc_id", "tkey", "n_words")
    parts = visits.join(sizes, ["doc_id", "tkey"]).groupBy("shard").agg(F.ceil(F.sum("n_words") / SHARD_WORDS).cast("int").alias("parts"))
    parts = stored(parts, "phrases-parts")  # a row a shard, some bytes for SHARD_PHRASES phrases
    visited = visits.join(texts, ["doc_id", "tkey"])
    spelled = stored(_spell(visited.where(F.size("own") > 0), phrase), "phrases-spelled")
    dealt = visits.select("doc_id", "tkey", "shard").join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "tkey"), F.col("parts")).cast("int"))
    dealt = dealt.select("doc_id", "tkey", "shard", "part").join(texts, ["doc_id", "tkey"])
    copied = spelled.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", "part", "phrase")
    windows = stored(_locate(dealt.select("shard", "part", "doc_id", "tkey", "text"), copied, window, phrase), "phrases-located")
    shared = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("qm_n")).where("lo < hi")
    shared = stored(shared.select("h1", "h2", "lo", "qm_n"), "phrases-shared")
    gone = hot_join(windows, shared.select("h1", "h2", "lo"), ["h1", "h2"], counts=shared.select("h1", "h2", "qm_n"))
    gone = gone.where("lo < doc_id").groupBy("doc_id", "tkey").agg(F.collect_list("start").alias("gone"))
    cut = _cut(texts.select("doc_id", "tkey", "text").join(gone, ["doc_id", "tkey"]), window)
    # Repeated rows go as one, and are as many again at the end.
    alike = scanned.groupBy("doc_id", "tkey", "n_words", "sha").agg(F.count("*").alias("qm_rows"))
    copies = hot_join(stored(alike, "phrases-alike"), homes.where("n > 1").select("sha", "home"), ["sha"], "left")
    whole = (F.col("n_words") >= window) & F.coalesce(F.col("home") < F.col("doc_id"), F.lit(False))
    return copies.join(cut, ["doc_id", "tkey"], "left").withColumn("qm_row", F.explode(F.sequence(F.lit(1), F.col("qm_rows").cast("int")))).select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
