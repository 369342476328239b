"""Importance resampling: documents are sampled by the ratio of two hashed n-gram models, of target and of raw text.

Words and pairs of words count in 2**BITS buckets by digest. The raw model counts all documents, the target model those
with a good label. A document's log weight is the sum, over its n-grams, of the logarithm of target over raw
probability. Adding a Gumbel number, a keyed hash of the doc_id, and taking the k largest samples without replacement in
proportion to the weights (Xie and others, 2023). The k-th largest is found by counting digits of the keys, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import least_hashed, stored
from quillmine.llm.words import Words, chunks, mixed, spans_digest, words

BITS = 16
#: At most so many documents with a good label make the target model.
TARGET_ROWS = 20_000


def buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each word and each pair of words."""
    digest = w.digests()
    shift = np.uint64(64 - BITS)
    one = (digest >> shift).astype(np.int64)
    at = np.arange(max(0, len(digest) - 1))
    at = at[w.doc[at] == w.doc[at + 1]] if len(at) else at
    two = (mixed(spans_digest(digest, at, at + 2)) >> shift).astype(np.int64)
    return np.concatenate((one, two)), np.concatenate((w.doc, w.doc[at]))


def _counts(flagged: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Raw and target counts per bucket. flagged: text, target (0 or 1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
        for b in batches:
            for i, k in chunks(b.column(0)):
                part = b.slice(i, k)
                b_, doc = buckets(words(part.column(0)))
                raw += np.bincount(b_, minlength=1 << BITS)
                good = part.column(1).to_numpy()[doc] > 0
                target += np.bincount(b_[good], minlength=1 << BITS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["b", "raw", "target"])

    sums = flagged.mapInArrow(count, "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in sums.collect():  # a row per bucket, 2**BITS at most
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    return raw, target


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of longs, None if there are fewer; by 16 bits at a time, 65536 counts a pass at most."""
    low, width = -(1 << 63), 64
    rest, inside = k, df.where(F.col(column).isNotNull())
    while width:
        width -= 16
        digit = F.shiftright(F.col(column), width).alias("d") if width else F.col(column).alias("d")
        found = dict(inside.groupBy(digit).count().collect())
        for d in sorted(found, reverse=True):
            if rest <= found[d]:
                break
            rest -= found[d]
        else:
            return None
        low = d << width
        inside = inside.where(F.col(column).between(low, low + (1 << width) - 1))
    return low


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: str = "resample", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Per row: doc_id, n_words, log_weight, sample_key, kept.

    keep is the share of rows to keep; left out, it is the share of good labels. Rows equal in key to the last that is
    kept are kept as well, so repeated rows share their fate. Null and empty texts have log weight 0. Null doc_ids share a Gumbel
    number. Without a good label all weights are 0; without labels all is kept. An empty table gives no row; other
    columns are ignored.
    """
    label = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    told = label.agg(F.count("*").alias("n"), F.sum((F.col("quality") > 0).cast("long")).alias("good")).first()
    share = keep if keep is not None else (told["good"] / told["n"] if told["n"] else 1.0)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    target = least_hashed(label.where("quality > 0"), target_rows).select("doc_id", F.lit(1).alias("target"))
    raw, good = _counts(rows.join(F.broadcast(target), "doc_id", "left").select("text", F.coalesce("target", F.lit(0)).alias("target")))
    ratio = np.log((good + 1) / (good.sum() + len(good))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    if not good.any():
        ratio[:] = 0
    key = np.uint64(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "little"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, k in chunks(b.column(1)):
                part = b.slice(i, k)
                w = words(part.column(1))
                bucket, doc = buckets(w)
                weight = np.bincount(doc, ratio[bucket], minlength=k)
                ids = part.column(0).fill_null(-1).to_numpy().view(np.uint64)
                u = ((mixed(mixed(ids ^ key) + key) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
                drawn = weight - np.log(-np.log(u))
                bits = (drawn + 0.0).view(np.int64)
                order = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, (np.diff(w.first), weight, drawn, order))], ["doc_id", "n_words", "log_weight", "sample_key", "qm_order"]
                )

    scored = stored(rows.mapInArrow(score, "doc_id long, n_words long, log_weight double, sample_key double, qm_order long"), "resample-scores")
    n = scored.count()
    k = min(n, round(share * n))
    least = kth_largest(scored, "qm_order", k) if k else None
    kept = F.col("qm_order") >= least if least is not None else F.lit(False)
    return scored.select("doc_id", "n_words", "log_weight", "sample_key", kept.alias("kept"))
