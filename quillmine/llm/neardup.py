"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's sketch has BANDS entries. For each band, every 3-word shingle, labelled with the number of its earlier
occurrences, gets a keyed hash; the two smallest are taken and put in the order of the text. So an entry agrees between
two texts only if they share the shingles in the same order, which follows edit similarity rather than set similarity.
Short texts have too few shingles for that; they go by keys that no similar pair can miss.
Texts that share an entry and are of like length are aligned word by word within a band, and linked if their edit
similarity, 1 - distance / longer length, reaches the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import hot_join, stored
from quillmine.llm.words import BASE, Words, chunks, mixed, runs_digest, spans_digest, words

SHINGLE = 3
BANDS = 48
SIMILARITY = 0.8
#: Longer texts, in words, go by their sketch; the others, and those within SIMILARITY of them in length, by exact keys.
SHORT = 50
#: Counts in a text's bag of words, and in the wide bag that pairs of an entry's members are held against; members held against
#: each other at once.
BUCKETS, WIDE = 128, 1024
BLOCK = 1000
BASE2 = np.uint64(0xA24BAED4963EE407)


def _occurrences(key: np.ndarray) -> np.ndarray:
    """For each element the number of equal ones before it."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.append(True, ranked[1:] != ranked[:-1])[: len(key)]
    began = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.arange(len(key)) - began
    return out


def sketch(w: Words, shingle: int = SHINGLE, bands: int = BANDS) -> np.ndarray:
    """A row of bands entries per text. A text of fewer than two shingles goes by its whole word sequence."""
    n = len(w.first) - 1
    digest = w.digests()
    whole = runs_digest(digest, w.first[:-1], w.first[1:])
    out = np.empty((n, bands), dtype=np.uint64)
    seeds = mixed(np.arange(1, bands + 1, dtype=np.uint64) * BASE)
    out[:] = mixed(whole[:, None] ^ seeds[None, :])
    at = np.arange(max(0, len(digest) - shingle + 1))
    at = at[w.doc[at] == w.doc[at + shingle - 1]] if len(at) else at
    if not len(at):
        return out
    k, doc = spans_digest(digest, at, at + shingle), w.doc[at]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    able = np.flatnonzero(np.diff(bounds) >= 2)
    if not len(able):
        return out
    labelled = mixed(k + _occurrences(mixed(k + doc.astype(np.uint64) * BASE2)).astype(np.uint64) * BASE2)
    keep = np.repeat(np.diff(bounds) >= 2, np.diff(bounds))
    labelled, k, doc = labelled[keep], k[keep], doc[keep]
    lens = np.diff(bounds)[able]
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    top = np.uint64(2**64 - 1)
    for j in range(bands):
        h = labelled ^ seeds[j]
        h = (h ^ (h >> np.uint64(31))) * BASE
        h ^= h >> np.uint64(29)
        low = np.minimum.reduceat(h, starts)
        i1 = _where(h, low, starts, lens)
        h[i1] = top
        low = np.minimum.reduceat(h, starts)
        i2 = _where(h, low, starts, lens)
        a, b = np.minimum(i1, i2), np.maximum(i1, i2)
        out[able, j] = mixed(mixed(k[a] ^ seeds[j]) + k[b] * BASE2)
    return out


def entries(w: Words, shingle: int = SHINGLE, bands: int = BANDS, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all texts in a row, number of keys of each): the sketch of a long text, exact keys of a short one.

    d edits in n words leave a run of (n - d) / (d + 1) words or more as it was. So two texts of at most SHORT / least words
    that are similar share a run of the length their longer one is sure to have, and all runs of that length are keys. Where
    that is below three words, d is 1 at the default threshold, or 0: the whole text and it without each one word are keys.
    """
    n = len(w.first) - 1
    size = np.diff(w.first)
    digest = w.digests()
    keys, of = [], []
    long = np.flatnonzero(size > SHORT)
    if len(long):
        keys.append(sketch(w, shingle, bands)[long].ravel())
        of.append(np.repeat(long, bands))
    top = math.ceil(SHORT / least)
    runs: dict[int, list[int]] = {}
    for longer in range(2, top + 1):
        d = math.floor((1 - least) * longer + 1e-9)
        if d:
            runs.setdefault(min(4, -(-(longer - d) // (d + 1))), []).append(longer)
    for width, longer in runs.items():
        # Both texts of a pair whose longer one has any of these lengths.
        few = (size >= min(longer) * least - 1e-9) & (size <= max(longer))
        if width > 2:
            at = np.arange(max(0, len(digest) - width + 1))
            at = at[(w.doc[at] == w.doc[at + width - 1]) & few[w.doc[at]]] if len(at) else at
            keys.append(mixed(spans_digest(digest, at, at + width) + np.uint64(width)))
            of.append(w.doc[at])
            continue
        text = np.flatnonzero(few)
        begin, end = w.first[text], w.first[text + 1]
        for gone in range(-1, max(longer)):
            mine = end - begin > gone
            x, y = begin[mine], end[mine]
            cut = x + gone if gone >= 0 else y
            # A text without one word: the digests of what stands before and after, as a polynomial of the words left.
            rest = np.zeros(len(x), dtype=np.uint64)
            for j in range(int((y - x).max(initial=0))):
                here = (x + j < y) & (x + j != cut)
                rest[here] = mixed(rest[here] * BASE2 + digest[x[here] + j])
            keys.append(mixed(rest ^ BASE2))
            of.append(text[mine])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    keys, of = np.concatenate(keys), np.concatenate(of)
    return keys[np.argsort(of, kind="stable")], np.bincount(of, minlength=n).astype(np.int64)


def _where(h: np.ndarray, low: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The first place of each segment's minimum."""
    hits = np.flatnonzero(h == np.repeat(low, lens))
    segment = np.searchsorted(starts, hits, "right") - 1
    return hits[np.append(True, segment[1:] != segment[:-1])]


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Levenshtein's distance of two sequences, or most + 1 if it is larger.

    Only cells within most of the diagonal count (an alignment that leaves this band costs more). A column's differences
    in the band are bits of two integers; a column takes a few operations on them, and the band moves down a cell each time.
    """
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    width = 2 * most + 1
    full = (1 << width) - 1
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    # Bit t of the band in column j stands for row j - most + t (rows from 1); rows outside 1..m match nothing.
    # In column 0 each row below row 0 costs one more.
    plus = (full >> (most + 1)) << (most + 1)
    minus = 0
    # The score is followed along the band's middle, the diagonal, from cell (0, 0).
    middle = 1 << most
    score = 0
    for j in range(1, n + 1):
        # Band of column j: rows j-most .. j+most; the vertical differences of column j-1, moved to these rows.
        vp = plus >> 1 | (1 << (width - 1))
        vn = minus >> 1
        shift = j - most - 1
        mask = masks.get(b[j - 1], 0)
        eq = (mask >> shift if shift >= 0 else mask << -shift) & full
        if shift < 0:
            # Rows up to 0 don't exist: row 0 grows by one a column, and nothing crosses it.
            border = (1 << -shift) - 1
            vp &= ~border
            vn &= ~border
        d0 = (((eq & vp) + vp) ^ vp | eq | vn) & full
        hp = vn | full & ~(d0 | vp)
        hn = d0 & vp
        if j <= m:
            score += not d0 & middle
        else:
            # Past the last row the middle leaves the table: go along the last row instead.
            row = 1 << (m - shift - 1)
            score += bool(hp & row) - bool(hn & row)
        if shift <= 0:
            up = (hp << 1 | 1 << max(0, -shift)) & full
        else:
            up = (hp << 1 | 1) & full
        down = hn << 1 & full
        plus = (down | full & ~(d0 | up)) & full
        minus = up & d0
        if shift < 0:
            border = (1 << -shift) - 1
            plus &= ~border
            minus &= ~border
        # It never falls along the diagonal, and by one a column at most after that.
        if score - (n - max(j, m)) > most:
            return most + 1
    return score if score <= most else most + 1


def similar(a: list[int], b: list[int], least: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length is at least least. Narrow bands come first, so a near copy costs what its edits do."""
    longer = max(len(a), len(b))
    most = math.floor((1 - least) * longer + 1e-9)
    i = 0
    for x, y in zip(a, b, strict=False):  # equal ends cost nothing
        if x != y:
            break
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    for x, y in zip(reversed(a), reversed(b), strict=False):
        if x != y:
            break
        i += 1
    if i:
        a, b = a[:-i], b[:-i]
    band = 64
    while band < most:
        if banded_distance(a, b, band) <= band:
            return True
        band *= 8
    return banded_distance(a, b, most) <= most


def components(links: DataFrame) -> DataFrame:
    """id, class_id: the least id of each connected component of links (a, b). Ids without a link don't appear.

    Large-star and small-star steps (Kiveris and others, 2014) take turns until nothing changes; each is an aggregation
    and a join on the cluster, spread over salts at hubs, and each result is stored.
    """
    edges, before = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links"), None
    while True:
        both = stored(edges.union(edges.select(F.col("v"), F.col("u"))), "links-both")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = hot_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = stored(large.distinct(), "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = hot_join(large, least, ["u"]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v")
        edges = stored(small.distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class_id")).union(edges.select(F.col("v"), F.col("v")).distinct())


def bags(w: Words, buckets: int = BUCKETS) -> np.ndarray:
    """Per text so many counts of its words by hash, each at most 15, two to a byte. An edit changes their sum of differences by two at most."""
    n = len(w.first) - 1
    bucket = (mixed(w.digests()) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
    counts = np.minimum(np.bincount(w.doc * buckets + bucket, minlength=n * buckets), 15).astype(np.uint8).reshape(n, buckets)
    return counts[:, ::2] | counts[:, 1::2] << 4


def _unpacked(bag: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    packed = np.frombuffer(b"".join(bag.to_pylist()), dtype=np.uint8).reshape(len(bag), buckets // 2)
    return np.concatenate((packed & 15, packed >> 4), axis=1).astype(np.int8)


def _within(n_a: np.ndarray, n_b: np.ndarray, bag_a: np.ndarray, bag_b: np.ndarray, least: float) -> np.ndarray:
    """Whether lengths and bags allow similarity; no similar pair is refused. Broadcasts over all axes but the bags' last."""
    longer = np.maximum(n_a, n_b)
    most = np.floor((1 - least) * longer + 1e-9)
    return (longer - np.minimum(n_a, n_b) <= most) & (np.abs(bag_a - bag_b).sum(axis=-1, dtype=np.int16) <= 2 * most)


def _sketches(rows: DataFrame, shingle: int, bands: int, least: float) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, k in chunks(b.column(1)):
                part = b.slice(i, k)
                w = words(part.column(1))
                halves = [runs_digest(w.digests(base), w.first[:-1], w.first[1:], base).view(np.int64) for base in (BASE, BASE2)]
                key, count = entries(w, shingle, bands, least)
                keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(key.view(np.int64)))
                bag, wide = (pa.array([x.tobytes() for x in bags(w, n)], pa.binary()) for n in (BUCKETS, WIDE))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.diff(w.first)), *map(pa.array, halves), bag, wide, keys],
                    ["doc_id", "x", "n_words", "w1", "w2", "bag", "wide", "keys"],
                )

    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("x"))
    return rows.mapInArrow(scan, "doc_id long, x long, n_words long, w1 long, w2 long, bag binary, wide binary, keys array<long>")


def _allowed(pairs: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs (a, n_a, bag_a, b, n_b, bag_b) that may be similar, the lesser first."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n_a, bag_a, b, n_b, bag_b = batch.columns
            ok = _within(n_a.to_numpy(), n_b.to_numpy(), _unpacked(bag_a), _unpacked(bag_b), least)
            x, y = a.to_numpy()[ok], b.to_numpy()[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return pairs.select("a", "n_a", "bag_a", "b", "n_b", "bag_b").mapInArrow(check, "a long, b long")


def _across(groups: DataFrame, least: float, bands: int = BANDS) -> DataFrame:
    """a, b of all pairs of members of unlike class that may be similar, in groups (key, one, two, members: array of id, n, bag,
    wide, sketch, class_id, block).

    A group of one block is held against itself; of a group of two blocks, the one against the other. Of the entries that a
    pair shares by its sketches, only that of the first equal band names it.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                key, one, two, members = *(batch.column(i)[r].as_py() for i in range(3)), batch.column(3)[r].values
                ids, n, label, block = (members.field(f).to_numpy(zero_copy_only=False) for f in ("id", "n", "class_id", "block"))
                bag, wide = _unpacked(members.field("bag")), _unpacked(members.field("wide"), WIDE)
                sketches = members.field("sketch")
                long = np.array(sketches.value_lengths()) == bands
                sketch = np.zeros((len(ids), bands), dtype=np.int64)
                sketch[long] = sketches.filter(pa.array(long)).flatten().to_numpy().reshape(-1, bands)
                left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
                step = max(1, (4 << 20) // (BUCKETS * max(1, len(right))))
                for i in range(0, len(left), step):
                    x = left[i : i + step]
                    ok = _within(n[x][:, None], n[right][None], bag[x][:, None], bag[right][None], least) & (label[x][:, None] != label[right][None])
                    ok &= (one != two) | (ids[x][:, None] < ids[right][None])
                    p, q = np.nonzero(ok)
                    p, q = x[p], right[q]
                    for j in range(0, len(p), 4096):
                        a, b = p[j : j + 4096], q[j : j + 4096]
                        equal = (sketch[a] == sketch[b]) & (long[a] & long[b])[:, None]
                        mine = ~equal.any(axis=1) | (sketch[a, equal.argmax(axis=1)] == key)
                        a, b = a[mine], b[mine]
                        near = _within(n[a], n[b], wide[a], wide[b], least)
                        a, b = ids[a[near]], ids[b[near]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return groups.select("key", "one", "two", "members").mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs (a, b, text_a, text_b) that are similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                similar(x.as_py().encode().split(), y.as_py().encode().split(), least)
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _links(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes (node, home, x) whose texts are similar, stored. A node's text is that of doc_id home and hash x."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(ids.hint("merge"), "node", "left_semi").select("node", F.col("home").alias("doc_id"), "x")
    texts = rows.withColumn("x", F.xxhash64("text")).join(wanted.hint("merge"), ["doc_id", "x"])
    texts = stored(texts.groupBy("node").agg(F.min("text").alias("text")), "near-texts")
    one = hot_join(pairs, texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), ["a"])
    two = hot_join(one, texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), ["b"], counted=pairs)
    return stored(_verified(two, least), "near-links")


#: Numbers from here on name texts whose doc_id names another text already.
SECOND = 1 << 62


def _nodes(able: DataFrame) -> DataFrame:
    """w1, w2, node, home, x, n: a row for each text (by its words), stored.

    home is the least doc_id that has it, x the least hash of such a row's text, n the number of rows. node is its number:
    its home, but where a doc_id is home to several texts the others have 62 bits of a hash of home and words, above SECOND.
    """
    homes = stored(able.groupBy("w1", "w2").agg(F.min(F.struct(F.col("doc_id").alias("home"), "x")).alias("h"), F.count("*").alias("n")).select("w1", "w2", "h.*", "n"), "near-homes")
    # A row per home; with equal doc_ids everywhere the first texts alone keep theirs.
    first = homes.groupBy("home").agg(F.min(F.struct("w1", "w2")).alias("f"), F.count("*").alias("texts")).where("texts > 1").select("home", "f")
    marked = hot_join(homes, first, ["home"], "left", counted=homes.select("home"))
    other = F.xxhash64("home", "w1", "w2").bitwiseAND(F.lit(SECOND - 1)).bitwiseOR(F.lit(SECOND))
    node = F.when(F.col("f").isNull() | (F.col("f") == F.struct("w1", "w2")), F.col("home")).otherwise(other)
    return stored(marked.select("w1", "w2", node.alias("node"), "home", "x", "n"), "near-nodes")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, least: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, class_id, n_links.

    class_id is the least doc_id of the document's class: documents joined by links, and documents of equal words.
    n_links counts the verified links of the class member that stands for its equal copies, to members with other words;
    pairs that leaders have joined are not aligned again, so a member may be similar to more. A document without a
    near-duplicate has its own id and no link. Null texts are empty; texts without a word are equal. Rows without a doc_id
    have a null class. Repeated rows get equal results; rows that share a doc_id but not the words are judged by their own texts.
    doc_id must be a whole number. An empty table gives no row; other columns are ignored.

    All that share an entry are first paired with two leaders, the least and greatest doc_id of like length. Then any two
    members of an entry that are not in one class by that are paired too, in blocks of members, unless their lengths or
    bags of words rule similarity out. So each pair in an entry is aligned, ruled out or joined by transitivity.
    """
    named = _classes(docs, shingle, bands, least)
    return named.select("doc_id", "class_id", "n_links")


def _classes(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, least: float = SIMILARITY) -> DataFrame:
    """What near_duplicates returns, with the hash x of the row's text, its node and the class's node that stands for it."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scanned = stored(_sketches(rows, shingle, bands, least), "near-sketches")
    able = scanned.where("doc_id is not null")
    nodes = _nodes(able)
    homed = able.select("doc_id", "x", "n_words", "w1", "w2", "bag", "wide", "keys").join(nodes.select("w1", "w2", F.col("home").alias("doc_id"), "x", "node"), ["w1", "w2", "doc_id", "x"])
    first = stored(homed.dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), "n_words", "bag", "wide", "keys"), "near-first")
    keyed = first.select("doc_id", F.explode(F.array_distinct("keys")).alias("key"))
    keys = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-keys")
    shared = stored(hot_join(keyed, keys.select("key"), ["key"], counts=keys.select("key", F.col("n").alias("qm_n"))), "near-shared")
    # For leaders only: lengths that differ by a quarter or less share a cell for even keys or for odd ones.
    width = 2 * math.log(1 / least)
    cell = F.floor(F.log(F.greatest("n_words", F.lit(1))) / width + F.pmod("key", F.lit(2)) * 0.5).cast("int")
    known = first.select("doc_id", "n_words", "bag")
    met = stored(shared.join(known.hint("merge"), "doc_id").withColumn("cell", cell), "near-met")
    member = F.struct(F.col("doc_id").alias("id"), F.col("n_words").alias("n"), "bag")
    leaders = met.groupBy("key", "cell").agg(F.min(member).alias("lo"), F.max(member).alias("hi"), F.count("*").alias("n")).where("n > 1")
    paired = hot_join(met, leaders.select("key", "cell", "lo", "hi"), ["key", "cell"], counted=met.select("key", "cell")).select(
        F.col("doc_id").alias("a"), F.col("n_words").alias("n_a"), F.col("bag").alias("bag_a"), F.explode(F.array("lo", "hi")).alias("with")
    )
    paired = paired.where("with.id <> a").select("a", "n_a", "bag_a", F.col("with.id").alias("b"), F.col("with.n").alias("n_b"), F.col("with.bag").alias("bag_b"))
    led = stored(_allowed(paired, least).distinct(), "near-pairs")
    links = _links(rows, nodes, led, least)
    # What leaders left apart: entries with members of several classes.
    by_leaders = stored(components(links), "near-led")
    labelled = met.join(by_leaders.select(F.col("id").alias("doc_id"), "class_id").hint("merge"), "doc_id", "left")
    labelled = stored(labelled.withColumn("class_id", F.coalesce("class_id", "doc_id")), "near-labelled")
    apart = labelled.groupBy("key").agg(
        F.count("*").alias("n"), F.min("class_id").alias("c1"), F.max("class_id").alias("c2"), F.min("cell").alias("l1"), F.max("cell").alias("l2")
    )
    # With three members or fewer in one cell, each pair has a leader.
    apart = stored(apart.where("c1 < c2 and (n > 3 or l1 < l2)").select("key", "n"), "near-apart")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = hot_join(labelled, apart, ["key"], counts=apart.select("key", F.col("n").alias("qm_n"))).withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    sketched = F.when(F.col("n_words") > SHORT, F.slice("keys", 1, bands)).otherwise(F.array().cast("array<bigint>"))
    dealt = dealt.join(first.select("doc_id", "wide", sketched.alias("sketch")).hint("merge"), "doc_id")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tagged = F.struct(F.col("doc_id").alias("id"), F.col("n_words").alias("n"), "bag", "wide", "sketch", "class_id", "block")
    groups = dealt.groupBy("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")).agg(F.collect_list(tagged).alias("members"))
    rest = stored(_across(groups, least, bands).distinct().join(led.hint("merge"), ["a", "b"], "left_anti"), "near-rest")
    links = stored(links.union(_links(rows, nodes, rest, least)), "near-links")
    # A class goes by its least doc_id; its node stands for it.
    classes = components(links).join(nodes.select(F.col("node").alias("id"), "home").hint("merge"), "id")
    lead = F.min(F.struct("home", F.col("id").alias("node"))).alias("lead")
    heads = classes.groupBy("class_id").agg(lead).select("class_id", F.col("lead.home").alias("least_id"), F.col("lead.node").alias("head"))
    classes = hot_join(classes.select("id", "class_id"), heads, ["class_id"]).select("id", "least_id", "head")
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    several = nodes.where("n > 1 or node <> home").select("w1", "w2", "node", "home")
    named = hot_join(scanned.select("doc_id", "x", "w1", "w2"), several, ["w1", "w2"], "left")
    named = named.select("doc_id", "x", F.coalesce("node", "doc_id").alias("id"), F.coalesce("home", "doc_id").alias("home"))
    found = stored(classes.join(degree, "id", "left"), "near-classes")
    return hot_join(stored(named, "near-named"), found, ["id"], "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least_id", "home")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "x",
        F.col("id").alias("node"),
        F.coalesce("head", "id").alias("head"),
    )


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, that of the least doc_id, with all columns; of repeated rows one.

    Null and empty texts, and texts without a word, are equal, so one of them stays. Rows without a doc_id all stay. Rows that
    share a doc_id stay or go by their own texts. An empty table gives an empty one; other columns, whatever their
    names, are passed on.
    """
    heads = _classes(docs, **options).where("node = head and doc_id = class_id")
    # Texts of equal words may differ in white space: one of them stays. Rows of one text go before they are exchanged.
    kept = heads.groupBy("head").agg(F.min(F.struct("doc_id", "x")).alias("k")).select(F.col("k.doc_id").alias("qm_id"), F.col("k.x").alias("qm_x"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("qm_row"), F.col("doc_id").alias("qm_id"), F.xxhash64(text).alias("qm_x"))
    one = rows.join(kept.hint("merge"), ["qm_id", "qm_x"], "left_semi").dropDuplicates(["qm_id", "qm_x"])
    return one.select("qm_row").union(rows.where("qm_id is null").select("qm_row")).select(*[F.col("qm_row")[c].alias(c) for c in docs.columns])
