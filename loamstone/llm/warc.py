"""WARC archives: a writer of record-at-a-time gzip members and a sequential reader.

Writing: of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest id is a response, the
others are revisit records that refer to it. Records are compressed one gzip member each (in Python) and written by Spark's
own text writer as raw bytes, some MB of members a row, so archives go wherever Spark can write. The writer ends each row
with a separator, here a zero byte; it stands for the last byte of the row's last member, which is zero unless the record
has 16 MiB or more (after such a one, at the end of a task's rows, it is padding). An archive has ``CHUNKS`` rows at most, so
its compressed bytes are bounded whatever the pages are, but for one record.

Reading: an archive's bytes are gone through in order: incremental zlib decompression of one member (zero padding is skipped
between members), the header block, then exactly Content-Length bytes, then the record's end, whose absence is an error;
WARC-Block-Digest and WARC-Payload-Digest are verified. Memory is one archive's compressed bytes and one record; archives of
others can be no larger than what Spark reads as one binary file, 2 GB.

Defined results: a null payload is empty; a null url is written as an empty target; equal rows are equal records; repeated
ids are records of their own; payloads of any length are one record; an empty table gives no archive and an empty reading;
other columns of the pages are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm.common import arrow_map, materialize, new_path, skew_join

MIN_REVISIT = 100
STEP = 1 << 16
#: Compression level of written members; bytes of them to a row, and rows to an archive.
LEVEL, CHUNK, CHUNKS = 1, 4 << 20, 16
READ_SCHEMA = "record_id string, record_type string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, truncated_read boolean, payload binary"


class WarcError(ValueError):
    """The archive isn't what its format or its digests say."""


def planned(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, and ``refers_to``: the response's page_id for revisits, else null."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    df = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # written first: where few payloads are there twice they are broadcast, and no payload is shuffled
    firsts = materialize(df.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first"), "warc-firsts")
    out = skew_join(df, firsts, ["digest"], "left")
    return out.select("page_id", "url", "payload", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogateescape")


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member holding one record. A revisit has the payload's digest and length, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Page-ID", str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{base64.b32encode(bytes.fromhex(digest)).decode().rstrip('=')}"),
        ("WARC-Block-Digest", f"sha256:{base64.b32encode(hashlib.sha256(block).digest()).decode().rstrip('=')}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("WARC-Refers-To-Page-ID", str(refers_to))]
    return _member(_header([*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n")


def write(pages: DataFrame, path: str, records: int = 20_000, chunks: int = CHUNKS, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each page into archives of at most ``chunks`` rows of at most ``records`` records or CHUNK bytes under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, small = [], 0, True

        def row() -> pa.RecordBatch:
            data = b"".join(made)
            return pa.RecordBatch.from_arrays([pa.array([data[:-1] if data[-1:] == b"\0" else data], pa.binary())], names=["value"])

        for b in batches:
            cols = [b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for values in zip(*cols, strict=True):
                made.append(record(*(x.as_py() for x in values), date))
                held, small = held + len(made[-1]), made[-1][-1] == 0
                if small and (held > CHUNK or len(made) >= records):
                    yield row()
                    made, held = [], 0
        if made:
            yield row()

    raw = planned(pages).transform(arrow_map, run, "value binary").select(F.col("value").cast("string").alias("value"))
    raw.write.option("lineSep", "\0").option("maxRecordsPerFile", chunks).option("compression", "none").text(path)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


class ArchiveReader:
    """Reads one archive from front to back; ``data`` may be any readable buffer."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.at = memoryview(data), 0

    def __iter__(self) -> Iterator[Record]:
        while True:
            while self.at < len(self.data) and self.data[self.at] == 0:
                self.at += 1
            if self.at >= len(self.data):
                return
            yield self._record()

    def _record(self) -> Record:
        inflate, out = zlib.decompressobj(31), bytearray()
        need = None
        while not inflate.eof:
            if self.at >= len(self.data):
                raise WarcError("the archive ends inside a member")
            piece = self.data[self.at : self.at + STEP]
            try:
                out += inflate.decompress(piece)
            except zlib.error as e:
                raise WarcError(f"bad member: {e}") from None
            self.at += len(piece) - len(inflate.unused_data)
            if need is None and (end := out.find(b"\r\n\r\n")) >= 0:
                headers = parse_header(bytes(out[:end]))
                need = end + 4 + int(headers["content-length"])
            if need is not None and len(out) > need + 4:
                raise WarcError("the member holds more than its record")
        if need is None:
            raise WarcError("no header block")
        if len(out) != need + 4 or out[need:] != b"\r\n\r\n":
            raise WarcError("the record's length isn't its Content-Length")
        block = bytes(out[end + 4 : need])
        check_digest(headers.get("warc-block-digest"), block, "block")
        return Record(headers, block)


def parse_header(block: bytes) -> dict[str, str]:
    """Field names in lower case; folded lines are joined."""
    lines = block.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError("not a WARC record")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError("bad header line")
        last = name.strip().lower()
        out[last] = value.strip()
    if "content-length" not in out or not out["content-length"].isdigit():
        raise WarcError("no Content-Length")
    return out


def digest_of(stated: str) -> tuple[str, bytes]:
    """Algorithm and bytes of a labelled digest in base 32 or hex."""
    name, _, value = stated.partition(":")
    size = hashlib.new(name).digest_size
    if len(value) == 2 * size:
        return name, bytes.fromhex(value)
    return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8))


def check_digest(stated: str | None, data: bytes, what: str) -> None:
    if stated is None:
        return
    name, want = digest_of(stated)
    if hashlib.new(name, data).digest() != want:
        raise WarcError(f"the {what} digest differs")


def payload_of(r: Record) -> bytes:
    """The body of an HTTP block, else the block."""
    if not r.headers.get("content-type", "").startswith("application/http"):
        return r.block
    _, _, body = r.block.partition(b"\r\n\r\n")
    return body


def _read_one(r: Record, keep: bool) -> tuple:
    h, payload = r.headers, payload_of(r)
    kind = h.get("warc-type", "")
    stated = h.get("warc-payload-digest")
    size = len(payload)
    if kind == "revisit":
        sent = [v for k, _, v in (line.partition(b":") for line in r.block.split(b"\r\n")) if k.lower() == b"content-length"]
        size = int(sent[0]) if sent else 0
    else:
        check_digest(stated, payload, "payload")
    digest = digest_of(stated)[1].hex() if stated else hashlib.sha256(payload).hexdigest()
    number = lambda k: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None
    return h.get("warc-record-id"), kind, h.get("warc-target-uri"), number("warc-page-id"), size, digest, number("warc-refers-to-page-id"), "warc-truncated" in h, payload if keep else None


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of the archives under ``path``, in ``READ_SCHEMA``; ``payloads=False`` leaves that column null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for r in ArchiveReader(content.as_buffer()):
                    rows.append(_read_one(r, payloads))
                    held += 200 + len(rows[-1][-1] or b"")
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("content")
    return files.transform(arrow_map, run, READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages into archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path, payloads=False)
