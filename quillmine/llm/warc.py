"""WARC archives: one gzip member per record, written and read back in a stream.

Files are written through Spark's text sink, whose commit protocol makes retried tasks harmless and which writes to any
store that Spark knows. A file is one row, the members of some records in a row; it is closed at FILE_BYTES, so that neither
side holds more than that and one record. The sink ends it with a zero byte: the last byte of a member (the top of the length
of less than 16 MiB) is zero and is left to the sink; after a longer member the zero is padding, which gzip readers skip.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.common import hot_join, shared_path, stored

#: Payloads of fewer bytes are always written out.
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed at so many bytes.
FILE_BYTES = 16 << 20


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """A gzip member. Without a payload the record is a revisit: its block has the HTTP head alone, with the full length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    named = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", _page_uri(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()),
        ("WARC-Block-Digest", _digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        named.insert(1, ("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))).replace("%", "")) or "about:blank"))
    if payload is None:
        named[1:1] = [("WARC-Refers-To", _page_uri(refers_to)), ("WARC-Profile", PROFILE)]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(text.encode() + block + b"\r\n\r\n") + press.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: bytes
    payload: bytes
    payload_bytes: int

    @property
    def page_id(self) -> int | None:
        return _page_of(self.headers["warc-record-id"])

    @property
    def refers_to(self) -> int | None:
        return _page_of(self.headers["warc-refers-to"]) if "warc-refers-to" in self.headers else None

    @property
    def sha1(self) -> str:
        return base64.b32decode(self.headers["warc-payload-digest"].removeprefix("sha1:")).hex()


def _page_of(uri: str) -> int | None:
    if not (m := re.fullmatch(r"<urn:page:(-?\d*)>", uri)):
        raise ValueError(f"not the URI of a page: {uri}")
    return int(m[1]) if m[1] else None


def _parsed(head: bytes, block: bytes) -> Record:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a record doesn't begin with WARC/")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if (said := headers.get("warc-block-digest")) and said != _digest(block):
        raise ValueError(f"block digest of {headers.get('warc-record-id')} is wrong")
    http, gap, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    if not gap or not size:
        raise ValueError(f"no HTTP head in {headers.get('warc-record-id')}")
    if headers["warc-type"] == "response" and (len(payload) != int(size[1]) or _digest(payload) != headers.get("warc-payload-digest")):
        raise ValueError(f"payload of {headers.get('warc-record-id')} is not what its head says")
    return Record(headers, http, payload, int(size[1]))


def read_records(pieces: Iterable[bytes]) -> Iterator[Record]:
    """Records of an archive that comes in pieces of any size; only one record is held. Damage raises ValueError."""
    member, body = None, bytearray()
    for piece in pieces:
        while piece:
            if member is None:
                piece = piece.lstrip(b"\0")
                if not piece:
                    break
                member, body = zlib.decompressobj(31), bytearray()
            try:
                body += member.decompress(piece)
            except zlib.error as e:
                raise ValueError(f"a gzip member is damaged: {e}") from e
            piece = member.unused_data
            if member.eof:
                end = body.find(b"\r\n\r\n")
                size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", body[: max(end, 0)])
                if end < 0 or not size:
                    raise ValueError("a record has no length")
                n = int(size[1])
                if len(body) != end + 4 + n + 4 or body[-4:] != b"\r\n\r\n":
                    raise ValueError("a record is longer or shorter than its length says")
                yield _parsed(bytes(body[:end]), bytes(body[end + 4 : end + 4 + n]))
                member = None
    if member is not None:
        raise ValueError("the last record is cut off")


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null for revisits), size, sha1, refers_to. Of equal payloads of REVISIT_BYTES or more the one
    with the largest page_id stays, also where that row is repeated; rows without a page_id stay too."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("qm_u"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.col("html")))
    big = rows.where(F.col("size") >= REVISIT_BYTES)
    kept = big.groupBy("sha1").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    of = hot_join(stored(big.where("page_id is not null").select("page_id", "sha1"), "warc-ids"), kept.select("sha1", "top"), ["sha1"])
    moved = of.where("page_id < top").groupBy("page_id", "sha1").agg(F.first("top").alias("refers_to"), F.count("*").alias("qm_n"))
    # Rows of one page_id that repeat a payload differ in qm_u, so hot_join spreads them as well.
    moved = stored(moved, "warc-moved")
    joined = hot_join(rows, moved.drop("qm_n"), ["page_id", "sha1"], "left", counts=moved.select("page_id", "sha1", "qm_n"))
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "sha1", "refers_to")


def write(pages: DataFrame, path: str) -> None:
    """Archives of all pages under path; pages as roles() takes them."""

    def archive(members: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(members)
        return pa.RecordBatch.from_arrays([pa.array([whole[:-1] if whole[-1] == 0 else whole], pa.binary())], ["archive"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, held = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 64):
                for r in b.slice(i, 64).to_pylist():
                    members.append(record(r["page_id"], r["url"], None if r["html"] is None else r["html"].encode(), r["size"], r["sha1"], r["refers_to"]))
                    held += len(members[-1])
                    if held >= FILE_BYTES:
                        yield archive(members)
                        members, held = [], 0
        if members:
            yield archive(members)

    packed = roles(pages).mapInArrow(pack, "archive binary")
    packed.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).mode("error").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload of each record under path."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for content in b.column(0):
                data = memoryview(content.as_buffer())
                rows: list[tuple] = []
                for r in read_records(bytes(data[i : i + 65536]) for i in range(0, len(data), 65536)):
                    kind = r.headers["warc-type"]
                    url = r.headers.get("warc-target-uri")
                    rows.append((r.page_id, None if url is None else unquote(url), kind, r.refers_to, r.payload_bytes, r.sha1, r.payload if kind == "response" else None))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(
        unpack,
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary",
    )


def roundtrip(pages: DataFrame) -> DataFrame:
    """Per row: page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from archives written here.

    Null html is an empty payload, a null url leaves the record without a target. Rows without a page_id are responses.
    Repeated rows give a record each; of equal payloads all rows of the largest page_id are responses. An empty table gives no
    row; other columns are ignored.
    """
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to FROM t
"""
