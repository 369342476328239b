"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

Merges follow the model's ranks, as an agenda per word: the best candidate pair is taken first. Each time a candidate
comes up it is skipped if its keyed hash, of seed, doc_id, the word's place in the document, place in the word and pair, falls
below the dropout; a skipped pair stays apart for good unless a neighbour's merge makes a new pair. So each occurrence of a word
is cut by itself, and any machine cuts alike. Distinct words of many documents go through the agenda side by side, in numpy: a
round takes the best candidate of every word. Occurrences that skip none of these merges share the result; each of the others
goes through an agenda of its own.

Text goes to pieces as the model's own identity normalizer has it: a space becomes U+2581, which begins a word; one stands before
the text. A literal U+2581, and what no piece covers, goes to byte pieces, so decoding gives every text back exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.words import bytes_digest, chunks, mixed, ranges, raw

DROPOUT = 0.1
META = "▁"
#: Pairs are keyed left id * PAIR + right id.
PAIR = 1 << 17
#: The rank of what doesn't merge.
NONE = 1 << 30

_models: dict[str, "Pieces"] = {}


class Pieces:
    """Piece tables of a SentencePiece BPE model: ids of single characters and bytes, and the merges with their ranks."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        self.byte = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        ids = {self.pieces[i]: i for i in plain}
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        score = {i: m.get_score(i) for i in plain}
        # Every way to make a piece of two pieces is a merge of that piece's rank.
        ranked = sorted((i for i in plain if len(self.pieces[i]) > 1), key=lambda i: (-score[i], i))
        pairs = []
        for rank, i in enumerate(ranked):
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a * PAIR + b, rank, i))
        pairs.sort()
        self.key = np.array([x[0] for x in pairs], dtype=np.int64)
        self.rank = np.array([x[1] for x in pairs], dtype=np.int32)
        self.made = np.array(ranked, dtype=np.int32)
        # Pairs by hash; of pairs that share a slot one is there, and the others are searched for.
        slot = self._slot(self.key)
        self.at = np.full(1 << 20, -1, dtype=np.int32)
        self.at[slot] = np.arange(len(slot))
        self.shared = np.bincount(slot, minlength=1 << 20) > 1
        self.bytes = [self._bytes(m, i) for i in range(n)]

    def _bytes(self, m, i: int) -> bytes:
        if m.is_byte(i):
            return bytes([int(self.pieces[i][3:5], 16)])
        if m.is_control(i) or m.is_unknown(i):
            return b""
        return self.pieces[i].replace(META, " ").encode()

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (mixed(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it doesn't merge. made has the piece that each rank makes."""
        key = left * np.int64(PAIR) + right
        rank = np.full(len(key), NONE, dtype=np.int32)
        if not len(self.key):
            return rank
        slot = self._slot(key)
        at = self.at[slot]
        ok = (at >= 0) & (self.key[at] == key)
        rank[ok] = self.rank[at[ok]]
        look = np.flatnonzero(~ok & self.shared[slot])
        at = np.minimum(np.searchsorted(self.key, key[look]), len(self.key) - 1)
        ok = self.key[at] == key[look]
        rank[look[ok]] = self.rank[at[ok]]
        return rank

    def decode(self, ids: list[int]) -> str:
        """The text of ids: what they spell, without the space that encoding sets before it."""
        data = b"".join([self.bytes[i] for i in ids])
        return data[1:].decode() if data[:1] == b" " else data.decode()


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _drops(salt: np.ndarray, local: np.ndarray, pair: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the merge of a pair (key) at a place of a word of this salt is skipped."""
    below = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
    return mixed(mixed(salt ^ (local.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) ^ pair.astype(np.uint64)) < below


def segment(
    model: Pieces, symbols: np.ndarray, lens: np.ndarray, salt: np.ndarray, dropout: float, trace: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Runs the agendas of all words side by side. symbols: pieces of all words in a row; lens: symbols of each word, one at
    least; salt: a 64-bit number per word that keys its dropout. Returns the symbols after all merges and how many each word
    has. trace, if given, gets (word, place, pair) of the candidates of each round."""
    lens = lens.astype(np.int64)
    word, sym = np.arange(len(lens)), symbols.astype(np.int32)
    ends = np.cumsum(lens)
    place = (np.arange(len(sym)) - np.repeat(ends - lens, lens)).astype(np.int32)
    rank = np.full(len(sym), NONE, dtype=np.int32)
    inner = np.ones(len(sym), dtype=bool)
    inner[ends - 1] = False
    inner = np.flatnonzero(inner)
    rank[inner] = model.merges(sym[inner], sym[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = np.int64((1 << 32) - 1)
    while len(word):
        starts = np.cumsum(lens) - lens
        # The best candidate of each word: least rank, then leftmost.
        best = np.minimum.reduceat(rank.astype(np.int64) << 32 | np.arange(len(sym)), starts)
        live = best < NONE << 32
        at = best & low
        if not live.all():
            stay = np.repeat(live, lens)
            done.append((word[~live], lens[~live], sym[~stay]))
            gone = np.cumsum(np.where(live, 0, lens))
            at = (at - gone)[live]
            word, lens = word[live], lens[live]
            sym, place, rank = sym[stay], place[stay], rank[stay]
            if not len(word):
                break
        local, pair = place[at], sym[at] * np.int64(PAIR) + sym[at + 1]
        if trace is not None:
            trace.append((word, local, pair))
        which = np.arange(len(word))
        if dropout > 0:
            drop = _drops(salt[word], local, pair, dropout)
            rank[at[drop]] = NONE
            which = np.flatnonzero(~drop)
            at = at[which]
        sym[at] = model.made[rank[at]]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        sym, place, rank = sym[keep], place[keep], rank[keep]
        lens[which] -= 1
        # The merged piece has a new pair on each side; both may be taken again.
        at = at - np.arange(len(at))
        first = (np.cumsum(lens) - lens)[which]
        rank[at] = NONE
        right = at[at < first + lens[which] - 1]
        rank[right] = model.merges(sym[right], sym[right + 1])
        left = at[at > first] - 1
        rank[left] = model.merges(sym[left], sym[left + 1])
    if not done:
        return symbols[:0].astype(np.int64), lens
    word, lens, sym = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word)
    off, k = (np.cumsum(lens) - lens)[order], lens[order]
    return sym[ranges(off, k)].astype(np.int64), k


def document_salts(doc_ids: list[int | None], seed: str) -> np.ndarray:
    """A keyed hash of each doc_id."""
    key = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "little")
    ids = np.array([0x7FFFFFFFFFFFFFFF if d is None else d for d in doc_ids], dtype=np.int64).view(np.uint64)
    return mixed(mixed(ids ^ np.uint64(key)) + np.uint64(key))


def _symbols(model: Pieces, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of the characters of valid UTF-8, byte at which each begins): spaces are U+2581, unknown ones bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[begin]
    size = np.diff(np.append(begin, len(data)))
    code = np.where(lead < 0x80, lead, np.where(lead < 0xE0, lead & 0x1F, np.where(lead < 0xF0, lead & 0x0F, lead & 0x07))).astype(np.int64)
    for k in (1, 2, 3):
        more = size > k
        code[more] = code[more] << 6 | (data[begin[more] + k] & 0x3F)
    literal = code == 0x2581
    code[code == 0x20] = 0x2581
    ids = model.char[code].astype(np.int64)
    ids[literal] = -1
    raw_at = np.flatnonzero(ids < 0)
    if len(raw_at):
        counts = np.where(ids < 0, size, 1)
        ends = np.cumsum(counts)
        begin = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(begin, counts)
        raw_at = np.repeat(ids < 0, counts)
        ids = np.repeat(ids, counts)
        ids[raw_at] = model.byte[data[begin[raw_at]]]
    return ids, begin


def encode(model: Pieces, texts: pa.Array, salts: np.ndarray, seed: str, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each). Each text has one space set before it, unless it is empty."""
    data, at = raw(texts)
    n = len(texts)
    # Put a space before every text that has any byte.
    some = np.diff(at) > 0
    spaced = np.insert(data, at[:-1][some], 0x20)
    at = at + np.concatenate(([0], np.cumsum(some)))
    if not len(spaced):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    # A word begins at a space whose forerunner is none; runs of spaces stay together, and line ends stand inside words.
    space = spaced == 0x20
    cut = space & ~np.concatenate(([False], space[:-1]))
    cut[at[:-1][some]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(spaced))
    doc = np.searchsorted(at, starts, "right") - 1
    key = int.from_bytes(hashlib.sha256(f"{seed}:words".encode()).digest()[:8], "little")
    size = ends - starts
    digest = mixed(bytes_digest(spaced, starts, ends) ^ np.uint64(key))
    distinct, first, which = np.unique(digest, return_index=True, return_inverse=True)

    def agenda(some: np.ndarray, salt: np.ndarray, rate: float, trace: list | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words in a row, number of each)."""
        ahead = np.cumsum(size[some])
        gathered = spaced[ranges(starts[some], size[some])]
        ids, begin = _symbols(model, gathered)
        return segment(model, ids, np.diff(np.searchsorted(begin, ahead), prepend=0), salt, rate, trace)

    trace: list = []
    ids, count = agenda(first, distinct, 0.0, trace)
    if dropout > 0 and trace:
        word, local, pair = (np.concatenate(x) for x in zip(*trace, strict=True))
        order = np.argsort(word, kind="stable")
        local, pair, merges = local[order], pair[order], np.bincount(word, minlength=len(distinct))
        # A word's number in its document, not in this run of texts.
        number = (np.arange(len(starts)) - np.searchsorted(doc, doc)).astype(np.uint64)
        salt = mixed(mixed(salts.astype(np.uint64)[doc] ^ np.uint64(key)) + number * np.uint64(0xD1342543DE82EF95))
        off, m = np.cumsum(merges) - merges, merges[which]
        of = np.repeat(np.arange(len(starts)), m)
        at = ranges(off[which], m)
        alone = np.flatnonzero(np.bincount(of[_drops(salt[of], local[at], pair[at], dropout)], minlength=len(starts)))
        if len(alone):
            own, k = agenda(alone, salt[alone], dropout, None)
            which[alone] = len(count) + np.arange(len(alone))
            ids, count = np.concatenate((ids, own)), np.concatenate((count, k))
    off = np.cumsum(count) - count
    k = count[which]
    return ids[ranges(off[which], k)], np.bincount(doc, k, minlength=n).astype(np.int64)


def _rows(docs: DataFrame, model_path: str, seed: str, dropout: float, full: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for b in batches:
            for i, k in chunks(b.column(1)):
                part = b.slice(i, k)
                doc_ids = part.column(0).to_pylist()
                ids, n = encode(model, part.column(1), document_salts(doc_ids, seed), seed, dropout)
                ends = np.cumsum(n)
                texts = [model.decode(ids[e - m : e].tolist()) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                wide = ids.astype("<u4")
                columns = [
                    part.column(0),
                    pa.array(n),
                    pa.array([zlib.crc32(wide[e - m : e].tobytes()) for e, m in zip(ends.tolist(), n.tolist(), strict=True)], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                    pa.array([t == u for t, u in zip(texts, part.column(1).to_pylist(), strict=True)]),
                ]
                names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"]
                if full:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids array<int>" * full
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, schema)


def encoded(docs: DataFrame, model_path: str, seed: str = "dropout", dropout: float = DROPOUT, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_crc32, decoded_sha256 (of the decoded text), lossless, and ids if asked.

    Null and empty texts have no id and decode to the empty text. Null doc_ids share a key. Repeated rows get equal
    results. An empty table gives no row; other columns are ignored. Nothing is shuffled.
    """
    return _rows(docs, model_path, seed, dropout, with_ids)
