"""WARC archives in Zstandard: written with a shared dictionary in a leading skippable frame, read back frame by frame.

An archive begins with a skippable frame that holds the dictionary; then each record is one frame. Archives are written
through Spark's text sink, one archive a file, and read through its binaryFile source, so they can lie in any store Spark
reaches. The sink ends each file with its line separator; that is an empty skippable frame here, which readers pass over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact import salted_join
from .workspace import Workspace

#: Fixed values of the formats: magic numbers of a dictionary's skippable frame, of other ones (16 of them), of a frame.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
EMPTY_SKIPPABLE = "P*M\x18\x00\x00\x00\x00"
#: An archive is closed at about this many compressed bytes.
ARCHIVE_BYTES = 4 << 20
#: Bytes of the dictionary and of the payloads it is trained on (the first ones of each archive).
DICTIONARY_BYTES, TRAINING_BYTES = 16 << 10, 1 << 20
#: A record may claim at most this many bytes.
LARGEST_RECORD = 1 << 31
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STATUS = b"HTTP/1.1 200 OK\r\n"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, refers_to, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One response record, or a revisit record (its payload left out) if refers_to is given."""
    http = _STATUS + b"Content-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and block of a record that fills data; WarcError if a line, a needed header or a length is wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not sep or not re.fullmatch(rb"WARC/1\.[01]", first):
        raise WarcError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!-9;-~]+", name):
            raise WarcError("malformed header line")
        headers[name.decode().lower()] = value.strip().decode()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in headers:
            raise WarcError(f"no {needed}")
    if not headers["content-length"].isdigit():
        raise WarcError("bad content-length")
    n = int(headers["content-length"])
    if n > LARGEST_RECORD or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("content-length does not fit the record")
    return headers | {"": rest[:n]}


def make_archive(records: list[bytes], samples: list[bytes]) -> bytes:
    """Dictionary frame and one compressed frame for each record. Too few samples give no dictionary: the frame is empty."""
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 16 else None
    except zstandard.ZstdError:
        trained = None
    raw = trained.as_bytes() if trained else b""
    out = [struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw]
    made = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True) if trained else zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    out += [made.compress(r) for r in records]
    return b"".join(out)


def read_archive(data: bytes) -> Iterator[bytes]:
    """Each record frame of an archive, decoded. The first frame must be the dictionary's; it may be compressed itself."""
    view = memoryview(data)
    if len(view) < 8 or struct.unpack_from("<I", view)[0] != DICTIONARY_FRAME:
        raise WarcError("no leading dictionary frame")
    size = struct.unpack_from("<I", view, 4)[0]
    if 8 + size > len(view):
        raise WarcError("dictionary frame is cut off")
    raw = bytes(view[8 : 8 + size])
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=LARGEST_RECORD)
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    at = 8 + size
    while at < len(view):
        if at + 8 <= len(view) and struct.unpack_from("<I", view, at)[0] in SKIPPABLE_FRAMES:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            if at > len(view):
                raise WarcError("skippable frame is cut off")
            continue
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise WarcError("not a frame")
        one = context.decompressobj()
        try:
            record = one.decompress(view[at:])
        except zstandard.ZstdError as e:
            raise WarcError(str(e)) from e
        if not one.eof:
            raise WarcError("frame is cut off")
        yield record
        at = len(view) - len(one.unused_data)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with refers_to: of equal payloads of at least least_bytes bytes the smallest page_id is kept,
    the other rows refer to it. A null html is empty. Of repeated rows with the smallest page_id all are kept; a null page_id
    refers to the smallest non-null one, and nothing refers to a null one."""
    pages = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = pages.select("page_id", F.length("payload").alias("n"), F.sha2("payload", 256).alias("digest")).where(F.col("n") >= least_bytes)
    repeated = keyed.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL")
    marked = pages.withColumns({"digest": F.sha2("payload", 256), "n": F.length("payload")})
    marked = salted_join(marked, repeated, ["digest", "n"], "copies", F.col("page_id"), "left")
    return marked.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, to: str) -> None:
    """Write records(page_id, url, payload, refers_to) as .warc.zst contents under to, one archive a file."""

    def run(batches):
        held, samples, size, sampled = [], [], 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, refers = (batch.column(i)[row].as_py() for i in range(4))
                held.append(record_bytes(page_id, url, payload, refers))
                size += len(held[-1])
                if sampled < TRAINING_BYTES:
                    samples.append(held[-1][:8192])
                    sampled += len(samples[-1])
                if size > ARCHIVE_BYTES * 4:
                    yield pa.RecordBatch.from_arrays([pa.array([make_archive(held, samples)], pa.binary())], names=["archive"])
                    held, samples, size, sampled = [], [], 0, 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([make_archive(held, samples)], pa.binary())], names=["archive"])

    archives = records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", EMPTY_SKIPPABLE).option("maxRecordsPerFile", 1).text(to)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to, url, payload) of all records under path. The digest of
    a response is computed from its payload and held against the header; a revisit's length and digest come from its headers,
    its payload is null. WarcError on anything malformed."""

    def page(urn: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d*)>", urn)
        if not found:
            raise WarcError(f"unknown id {urn}")
        return int(found[1]) if found[1] else None

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                cols: list[list] = [[] for _ in range(7)]
                held = 0
                for data in read_archive(content.as_py()):
                    h = parse_record(data)
                    kind, block = h["warc-type"], h[""]
                    http, sep, payload = block.partition(b"\r\n\r\n")
                    length = re.search(rb"\r\nContent-Length: (\d+)", http)
                    if kind not in ("response", "revisit") or not sep or not http.startswith(b"HTTP/") or not length:
                        raise WarcError("not an HTTP record")
                    n, digest = int(length[1]), h["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != n or payload_digest(payload) != digest):
                        raise WarcError("payload does not fit its digest or length")
                    if kind == "revisit" and payload:
                        raise WarcError("revisit with a payload")
                    values = page(h["warc-record-id"]), kind, n, digest, page(h["warc-refers-to"]) if kind == "revisit" else None, h.get("warc-target-uri"), payload if kind == "response" else None
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                    held += len(payload)
                    if held > ARCHIVE_BYTES:
                        yield _read_batch(cols)
                        cols, held = [[] for _ in range(7)], 0
                yield _read_batch(cols)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary")


_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
_NAMES = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]


def _read_batch(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)


def archive_round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and read them back: one row for each record. An empty table gives an
    empty one."""
    ws = Workspace(spark, "warc")
    to = ws.path("archives")
    write_archives(with_revisits(pages, least_bytes), to)
    return read_archives(spark, to)
