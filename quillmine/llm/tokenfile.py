"""Token-ID output: texts encoded by a public tokenizer, kept in range-coded segment files.

A file is a row of segments, one byte (a line end) after each. A segment holds whole documents, in ascending doc_id order
within and across files: a head (magic, partition, number in the partition, documents, bytes of the head's index and of
the code), the index (doc_id, null flag and number of ids of each document), a checksum of both, and the range coder's blocks.
Files are written through Spark's text sink, whose commit protocol makes retried tasks harmless, on any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.common import partitions, running_total, shared_path, stored
from quillmine.llm.rangecoder import decode_segment, encode_segment
from quillmine.llm.words import SPACE, bytes_digest, chunks, ranges, raw

MAGIC = b"QMT1"
END_ID = 0
#: A segment is closed at so many ids.
SEGMENT_IDS = 4096 * 2048
#: Segments of a file; a reader holds a file, and no file may reach 2 GiB.
FILE_SEGMENTS = 16
#: Slots of the chunks that a worker remembers, twice, at first and at most, and ids that it keeps for them before it begins anew.
FEW_BITS, SLOT_BITS = 15, 21
REMEMBERED = 24_000_000
TEXT_BYTES = 1 << 20
RANGE_CHARACTERS = 64
U64 = np.uint64
#: New chunks that the library encodes as one text.
ROW = 200
#: Bytes that a space before them joins in every byte-level pre-tokenizer: no white space, nor the head of a wider one.
VISIBLE = ~SPACE & (np.arange(256) > 0x20) & ~np.isin(np.arange(256), [0x7F, 0xC2, 0xE1, 0xE2, 0xE3])

_coders: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """Encodes texts by the tokenizers library, each distinct chunk once.

    Texts are cut before single spaces with a visible character after them. Byte-level pre-tokenizers always cut there
    too, so the chunks' ids in a row are the text's ids. Ids of chunks are remembered by 64-bit digest. New chunks that
    begin with such a space go to the library in rows, which are cut again where their ids' bytes add up to a chunk's.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # only new chunks come to the library, so its own cache finds nothing
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes that each id stands for; byte-level pieces have a character per byte.
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for piece, i in vocabulary.items():
            self.width[i] = added.get(i, len(piece))
        self.forget()

    def forget(self) -> None:
        self.flat = np.zeros(0, dtype=np.uint16)
        self._room(FEW_BITS)

    def _room(self, bits: int) -> None:
        self.bits, self.held = bits, 0
        self.keys = np.zeros(2 << bits, dtype=np.uint64)  # 0 where a slot is free
        self.offs = np.zeros(2 << bits, dtype=np.uint32)
        self.lens = np.zeros(2 << bits, dtype=np.uint16)

    def _places(self, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two slots that a chunk's ids may be remembered in."""
        return (digest >> U64(64 - self.bits)).astype(np.int64), (digest & U64((1 << self.bits) - 1)).astype(np.int64) + (1 << self.bits)

    def _find(self, digest: np.ndarray) -> np.ndarray:
        """The slot of each chunk, -1 if it isn't remembered."""
        one, two = self._places(digest)
        at = np.where(self.keys[one] == digest, one, -1)
        miss = np.flatnonzero(at < 0)
        other = two[miss]
        at[miss] = np.where(self.keys[other] == digest[miss], other, -1)
        return at

    def _remember(self, digest: np.ndarray, offs: np.ndarray, lens: np.ndarray) -> None:
        """Puts distinct chunks to the first of their slots that is free, else to the second, whatever was there. The slots are
        four times as many once half of them may be taken, up to SLOT_BITS."""
        self.held += len(digest)
        if self.held > 1 << self.bits and self.bits < SLOT_BITS:
            live = np.flatnonzero(self.keys)
            had = self.keys[live], self.offs[live], self.lens[live]
            self._room(min(SLOT_BITS, self.bits + 2))
            self._remember(*had)
            self.held += len(digest)
        one, two = self._places(digest)
        slot = np.where(self.keys[one] == 0, one, two)
        fits = lens < 1 << 16
        slot = slot[fits]
        self.keys[slot], self.offs[slot], self.lens[slot] = digest[fits], offs[fits], lens[fits]

    def _cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where chunks begin: at texts, and at spaces that the next character takes along."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data) > 1:
            cut[:-2] = (data[:-1] == 0x20) & VISIBLE[data[1:]]
        # A space that ends a text takes nothing along.
        inner = at[(at > 0) & (at <= len(data))] - 1
        cut[inner] = False
        cut[at] = True
        return np.flatnonzero(cut[:-1])

    def _ids(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks in a row, number of each)."""
        rows = [b"".join(strings[i : i + ROW]) for i in range(0, len(strings), ROW)]
        got = self._encoded(rows)
        flat = np.concatenate([np.array(x, dtype=np.int64) for x in got]) if got else np.zeros(0, np.int64)
        ends = np.cumsum(np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)))
        reach = np.cumsum(self.width[flat])
        stop = np.searchsorted(reach, ends)
        if len(flat) and stop.max() < len(flat) and (reach[stop] == ends).all():
            return flat, np.diff(stop + 1, prepend=0)
        got = self._encoded(strings)
        return np.fromiter((i for x in got for i in x), dtype=np.int64), np.fromiter(map(len, got), dtype=np.int64, count=len(got))

    def _encoded(self, strings: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in strings], add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        data, at = raw(texts)
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        starts = self._cuts(data, at)
        ends = np.append(starts[1:], len(data))
        digest = bytes_digest(data, starts, ends)
        digest[digest == 0] = 1
        slot = self._find(digest)
        new = np.flatnonzero(slot < 0)
        flat, offs, lens = self.flat, self.offs[slot].astype(np.int64), self.lens[slot].astype(np.int64)
        if len(new):
            distinct, first, which = np.unique(digest[new], return_index=True, return_inverse=True)
            first = new[first]
            at_, to = starts[first], ends[first]
            whole = data.tobytes()
            # Chunks that don't begin with a space and a visible character (texts' heads) go by themselves.
            led = (to - at_ > 1) & (data[at_] == 0x20) & VISIBLE[data[np.minimum(at_ + 1, len(data) - 1)]]
            order = np.concatenate((np.flatnonzero(led), np.flatnonzero(~led)))
            pieces = [whole[a:b] for a, b in zip(at_[order].tolist(), to[order].tolist(), strict=True)]
            n_led = int(led.sum())
            rows, n_rows = self._ids(pieces[:n_led])
            alone = self._encoded(pieces[n_led:])
            new_lens = np.concatenate((n_rows, np.fromiter(map(len, alone), dtype=np.int64, count=len(alone))))
            new_flat = np.concatenate((rows, np.fromiter((i for x in alone for i in x), dtype=np.int64)))
            if len(new_flat) and new_flat.max() > 0xFFFF:
                raise ValueError("ids of 65536 and more don't fit this format")
            new_offs = len(flat) + np.cumsum(new_lens) - new_lens
            back = np.empty(len(order), dtype=np.int64)
            back[order] = np.arange(len(order))
            offs[new], lens[new] = new_offs[back][which], new_lens[back][which]
            self.flat = flat = np.concatenate((flat, new_flat.astype(np.uint16)))
            self._remember(distinct[order], new_offs, new_lens)
        ids = flat[ranges(offs, lens)]
        per_text = np.add.reduceat(np.append(lens, 0), np.append(np.searchsorted(starts, at[:-1]), len(lens)))[:-1]
        per_text[np.diff(at) == 0] = 0
        if len(self.flat) > REMEMBERED:
            self.forget()
        return ids, per_text


def _coder(path: str) -> ChunkEncoder:
    if path not in _coders:
        _coders[path] = ChunkEncoder(path)
    return _coders[path]


def pack_segment(part: int, number: int, doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray) -> bytes:
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    index = zlib.compress(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + null.tobytes() + lens.astype("<u4").tobytes(), 6)
    code = encode_segment(ids)
    head = MAGIC + struct.pack("<IIIIQ", part, number, len(doc_ids), len(index), len(code)) + index
    return head + struct.pack("<I", zlib.crc32(head)) + code


def read_segments(data: memoryview) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(partition, number, doc_ids, ids per document, ids) of each segment of a file; damage raises ValueError."""
    at = 0
    while at < len(data):
        if bytes(data[at : at + 4]) != MAGIC or len(data) < at + 28:
            raise ValueError("not a segment of token ids")
        part, number, n, index_size, code_size = struct.unpack_from("<IIIIQ", data, at + 4)
        end = at + 28 + index_size
        if len(data) < end + 4 + code_size or zlib.crc32(data[at:end]) != struct.unpack_from("<I", data, end)[0]:
            raise ValueError("a segment's index is damaged")
        index = zlib.decompress(data[at + 28 : end])
        ids = np.frombuffer(index, "<i8", n).tolist()
        null = np.frombuffer(index, np.uint8, n, 8 * n)
        lens = np.frombuffer(index, "<u4", n, 9 * n).astype(np.int64)
        yield part, number, [None if z else d for d, z in zip(ids, null, strict=True)], lens, decode_segment(data[end + 4 : end + 4 + code_size])
        at = end + 4 + code_size + 1


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Files of docs' ids under path, end_id after each document. tokenizer: a file of the tokenizers library."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number, part = _coder(tokenizer), 0, 0
        doc_ids: list = []
        lens: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def segment() -> pa.RecordBatch:
            made = pack_segment(part, number, doc_ids, np.concatenate(lens), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["segment"])

        for b in batches:
            for i, k in chunks(b.column(1), TEXT_BYTES):
                rows = b.slice(i, k)
                part = rows.column(2)[0].as_py()
                got, n = coder.encode(rows.column(1))
                ends = np.cumsum(n)
                ids.append(np.insert(got, ends, end_id))
                lens.append(n + 1)
                doc_ids += rows.column(0).to_pylist()
                held += len(got) + k
                if held >= SEGMENT_IDS:
                    yield segment()
                    doc_ids, lens, ids, held, number = [], [], [], 0, number + 1
        if doc_ids:
            yield segment()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Rows that share a doc_id are in several ranges by how their texts begin.
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id"), F.substring("text", 1, RANGE_CHARACTERS))
    ordered = ranged.sortWithinPartitions("doc_id", "text")
    packed = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(pack, "segment binary")
    lines = packed.select(F.col("segment").cast("string").alias("value"))
    lines.write.option("compression", "none").option("maxRecordsPerFile", FILE_SEGMENTS).mode("error").text(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, part, number, place, n_tokens, ids_crc32 and, if asked, ids of each document under path."""
    schema = "doc_id long, part int, number int, place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for part, number, doc_ids, lens, ids in read_segments(memoryview(content.as_buffer())):
                    n, wide = len(doc_ids), ids.astype("<u4")
                    ends = np.cumsum(lens)
                    crc = [zlib.crc32(wide[e - k : e].tobytes()) for e, k in zip(ends.tolist(), lens.tolist(), strict=True)]
                    columns = [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(np.full(n, number, np.int32)),
                        pa.array(np.arange(n)),
                        pa.array(lens),
                        pa.array(crc, pa.int64()),
                    ]
                    names = ["doc_id", "part", "number", "place", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(unpack, schema)


def tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Per row: doc_id, start, n_tokens, ids_crc32, as read back from files written here.

    Null texts are empty and have the end id alone. Null doc_ids come first, rows of equal doc_id are ordered by text, and
    repeated rows are documents of their own. An empty table gives no row; other columns are ignored.
    """
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id)
    found = stored(read(docs.sparkSession, path), "token-index")
    return running_total(found, [], "part", ["number", "place"], "n_tokens", "qm_end").select(
        "doc_id", (F.col("qm_end") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32"
    )
