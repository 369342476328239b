"""Quality rules: gradient-boosted trees over document statistics, with monotone constraints, scored by numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from quillmine.llm.common import least_hashed, stored
from quillmine.llm.words import BYTE, chunks, counts_in, mixed, runs_digest, spans_digest, words

#: Counts per document, in the order of the columns.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_digits", "n_marks", "n_chars")
#: Features, each with its constraint: -1 means that more of it never raises the score.
FEATURES = (
    ("symbols per word", -1),
    ("repeated words per word", -1),
    ("equal lines per line", -1),
    ("upper case per character", -1),
    ("digits per character", -1),
    ("characters per word", 0),
    ("distinct words per root of words", 0),
    ("distinct words per word", 0),
    ("marks per word", 0),
    ("words per line", 0),
    ("logarithm of words", 0),
)
#: At most so many labelled rows are fitted on.
FIT_ROWS = 20_000


def statistics(texts: pa.Array) -> np.ndarray:
    """COUNTS of each text, a row each."""
    w = words(texts)
    n, data = len(w.at) - 1, w.data
    out = np.zeros((n, len(COUNTS)), dtype=np.int64)
    begin = np.zeros(256, dtype=bool)
    begin[:0x80] = begin[0xC0:] = True
    kinds = {}
    for name, members in (("symbol", b"#*$%&|<>"), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("mark", b".,;:!?"), ("line", b"\n")):
        kinds[name] = np.zeros(256, dtype=bool)
        kinds[name][list(members)] = True
    of = lambda flags: counts_in(flags, w.at[:-1], w.at[1:])
    space = np.ones(len(data), dtype=bool)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    space = np.cumsum(inside[:-1], dtype=np.int8) == 0
    points = begin[data]
    out[:, 0] = np.diff(w.first)
    out[:, 1] = of(points & ~space)
    out[:, 2] = of(kinds["symbol"][data])
    out[:, 6] = of(kinds["line"][data]) + 1
    out[:, 7] = of(kinds["upper"][data])
    out[:, 8] = of(kinds["digit"][data])
    out[:, 9] = of(kinds["mark"][data])
    out[:, 10] = of(points)
    # Lines with a word; equal ones share a digest.
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((w.at[:-1], breaks + 1)), kind="stable")
    doc_of_line = np.repeat(np.arange(n), out[:, 6])
    # A text's first line and lines after a break, text by text: empty texts have one empty line.
    order = np.lexsort((np.concatenate((w.at[:-1], breaks + 1)), np.concatenate((np.arange(n), np.searchsorted(w.at, breaks, "right") - 1))))
    starts = np.concatenate((w.at[:-1], breaks + 1))[order]
    ends = np.append(starts[1:] - 1, len(data))
    last = np.append(doc_of_line[1:] != doc_of_line[:-1], True)
    ends[last] = w.at[1:][doc_of_line[last]]
    has = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    letters = BYTE[data]
    lines, line_doc = runs_digest(letters, starts[has], ends[has]), doc_of_line[has]
    out[:, 3] = np.bincount(line_doc, minlength=n) - _distinct(lines, line_doc, n)
    each = w.digests()
    out[:, 5] = _distinct(each, w.doc, n)
    if len(each) >= 5:
        five = np.arange(len(each) - 4)
        five = five[w.doc[five] == w.doc[five + 4]]
        key = mixed(spans_digest(each, five, five + 5) + w.doc[five].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), dtype=bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        cover = np.zeros(len(each) + 1, dtype=np.int64)
        np.add.at(cover, five[again], 1)
        np.add.at(cover, five[again] + 5, -1)
        out[:, 4] = np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


def _distinct(digest: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    key = np.sort(mixed(digest + doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
    if fresh.all():
        return np.bincount(doc, minlength=n)
    order = np.lexsort((digest, doc))
    d, k = doc[order], digest[order]
    first = np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))[: len(d)]
    return np.bincount(d[first], minlength=n)


def features(counts: np.ndarray) -> np.ndarray:
    c = {name: counts[:, i].astype(np.float64) for i, name in enumerate(COUNTS)}
    w, ch, ln = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            c["n_symbols"] / w,
            c["n_repeat_words"] / w,
            c["n_dup_lines"] / ln,
            c["n_upper"] / ch,
            c["n_digits"] / ch,
            c["word_chars"] / w,
            c["n_distinct"] / np.sqrt(w),
            c["n_distinct"] / w,
            c["n_marks"] / w,
            c["n_words"] / ln,
            np.log(w),
        ],
        axis=1,
    )


@dataclass
class Forest:
    """All trees' nodes in arrays. A leaf's feature is -1; a row goes left if its feature is at most the threshold."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))

    def keeps(self, counts: np.ndarray) -> np.ndarray:
        return self.score(features(counts)) >= self.cut


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 8, keep_good: float = 0.999) -> Forest:
    """Boosts logistic loss. The cut lets keep_good of the good rows pass, and is at most one half.

    A split on a constrained feature is taken only if its sides' values are in order; each side's values are then held
    beyond the middle of both, so no deeper split can undo that. One class alone gives a forest that keeps all.
    """
    nodes: list[list] = []
    roots: list[int] = []
    cut_points = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])] if len(x) else []
    if not len(x) or y.min() == y.max():
        return Forest(np.zeros(0, int), *[np.zeros(0, t) for t in (int, float, int, int, float)], 0, 0.0)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    nodes.append([-1, 0.0, 0, 0, bias])
    roots.append(0)
    total = np.full(len(x), bias)
    leaf = lambda g, h: -g / (h + 1.0)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, 0, 0, rate * float(np.clip(leaf(gs, hs), low, high))])
        if level == depth or len(rows) < 2 * least:
            return me
        best = (1e-3, -1, 0.0, 0.0)
        for j, (_, sign) in enumerate(FEATURES):
            points = cut_points[j]
            if not len(points):
                continue
            b = np.searchsorted(points, x[rows, j], "left")
            n = np.cumsum(np.bincount(b, minlength=len(points) + 1))[:-1]
            gl = np.cumsum(np.bincount(b, g[rows], len(points) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(points) + 1))[:-1]
            vl, vr = np.clip(leaf(gl, hl), low, high), np.clip(leaf(gs - gl, hs - hl), low, high)
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(n < least) | (len(rows) - n < least) | (sign * (vr - vl) < 0)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(points[k]), float(vl[k] + vr[k]) / 2)
        _, j, point, middle = best
        if j < 0:
            return me
        sign = FEATURES[j][1]
        go = x[rows, j] <= point
        l_high, r_low = (middle, low) if sign > 0 else (high, low)
        l_low, r_high = (low, high)
        if sign > 0:
            r_low = middle
        elif sign < 0:
            l_low, r_high = middle, middle
        left = grow(rows[go], g, h, level + 1, l_low, l_high)
        right = grow(rows[~go], g, h, level + 1, r_low, r_high)
        nodes[me][:4] = [j, point, left, right]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        root = grow(np.arange(len(x)), g, h, 0, -np.inf, np.inf)
        roots.append(root)
        f = Forest(np.array([root]), *_columns(nodes), depth, 0.0)
        s = f.score(x)
        total += np.log(s / (1 - s))
    forest = Forest(np.array(roots), *_columns(nodes), depth, 0.0)
    forest.cut = float(min(0.5, np.quantile(forest.score(x)[y == 1], 1 - keep_good)))
    return forest


def _columns(nodes: list[list]) -> list[np.ndarray]:
    return [np.array(c) for c in zip(*nodes, strict=True)]


def counted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a column qm_c: array of COUNTS; null texts are empty."""
    columns = docs.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for i, k in chunks(texts):
                counts = statistics(texts.slice(i, k))
                made = pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel()), len(COUNTS)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.slice(i, k).columns[:-1], made], [*b.schema.names[:-1], "qm_c"])

    rows = docs.withColumn("qm_text", F.coalesce("text", F.lit("")))
    return rows.mapInArrow(add, StructType([*docs.schema.fields, StructField("qm_c", ArrayType(LongType()))])).select(*[F.col(f"`{c}`") for c in columns], "qm_c")


def fitted(counts: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """A forest for the labels' quality. Of the labelled documents those with the smallest hashes are taken, rows at most."""
    of = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    got = least_hashed(stored(counts.select("doc_id", "qm_c").join(of, "doc_id"), "quality-labelled"), rows).collect()
    c = np.array([r["qm_c"] for r in got], dtype=np.int64).reshape(-1, len(COUNTS))
    return fit(features(c), np.array([float(r["quality"] > 0) for r in got]))


def judged(counts: DataFrame, forest: Forest, verdict: str = "qm_good") -> DataFrame:
    """Rows with qm_c, and the forest's verdict."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.array(b.column(b.schema.get_field_index("qm_c")).flatten()).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.keeps(c))], [*b.schema.names, verdict])

    return counts.mapInArrow(judge, StructType([*counts.schema.fields, StructField(verdict, BooleanType())]))


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have counts 0 and fail the base. Without labels of both qualities all that passes the base is
    kept. Repeated rows get equal results. An empty table gives no row; other columns are ignored. The texts are read
    once; the statistics, some numbers a row, are stored and scored.
    """
    counts = stored(counted(docs.select("doc_id", "text")).select("doc_id", "qm_c"), "quality-counts")
    rows = judged(counts, fitted(counts, labels, fit_rows))
    named = [F.get("qm_c", F.lit(i)).alias(n) for i, n in enumerate(COUNTS[:5])]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", *named, "qm_good").select(
        "doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & F.col("qm_good")).alias("kept")
    )


def good_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that quality() keeps, same columns; the texts don't move.

    Null and empty texts have no word and go. Repeated rows share their fate. Without labels of both qualities the base rules
    alone decide. An empty table gives an empty one; other columns, whatever their names, are passed on.
    """
    counts = stored(counted(docs.select("doc_id", "text")).select("doc_id", "qm_c"), "quality-counts")
    forest = fitted(counts, labels, fit_rows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("qm_row"), F.coalesce("text", F.lit("")).alias("qm_text"))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, k in chunks(b.column(1)):
                c = statistics(b.column(1).slice(i, k))
                keep = forest.keeps(c) & (c[:, 0] >= 10) & (100 * c[:, 4] <= 20 * c[:, 0])
                yield b.slice(i, k).filter(pa.array(keep)).select(["qm_row"])

    kept = rows.mapInArrow(passing, StructType([rows.schema["qm_row"]]))
    return kept.select(*[F.col("qm_row")[c].alias(c) for c in docs.columns])
