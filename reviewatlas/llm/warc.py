"""Zstandard web archives: a dictionary in a leading skippable frame, then one frame per record.

Archives lie in the shared folder, or in any store that pyarrow's file systems reach by a URI. A task writes files of
its own names and reports them; a file counts only if the report of its task was kept, so a task that is
lost or run twice leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewatlas.llm.common import bounded_sample, written
from reviewatlas.session import scratch_path

#: Fixed: magic numbers of the skippable frame that holds a dictionary and of a Zstandard frame; the profile of revisits.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"

#: The dictionary is trained on so many pages of at most so many bytes, the first by a hash of the id.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 65536, 65536
#: Payloads of fewer bytes are never revisits; an archive ends after so many bytes.
LEAST_REVISIT, FILE_BYTES = 100, 256 << 20


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from a bounded sample of pages; the end of their text where they are too few to learn from."""
    small = pages.where(F.octet_length("html").between(1, SAMPLE_BYTES)).select("page_id", "html", F.lit(0).alias("_all"))
    rows = bounded_sample(small, "_all", "page_id", sample).select("page_id", "html").collect()
    texts = [r["html"].encode() for r in sorted(rows)]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes() if texts else b""
    except zstandard.ZstdError:
        return b"".join(texts)[-size:].rjust(8)


def leading_frame(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    body = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def record(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the headers alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", PROFILE if refers_to else None),
        ("WARC-Refers-To", f"<{refers_to}>" if refers_to else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of a decoded frame. Raises ValueError where the record is not well formed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", VERSION):
        raise ValueError(f"no record header: {data[:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line!r}")
        headers[name.strip().lower()] = value.strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in headers:
            raise ValueError(f"{needed} is missing")
    if not headers["content-length"].isdigit():
        raise ValueError("content-length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, {n} were announced")
    return headers, rest[:n]


def parse_response(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """(payload bytes, SHA-256, payload or None for a revisit), checked against the headers."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head.replace(b"\r", b""))
    if not gap or not head.startswith(b"HTTP/") or not length:
        raise ValueError("no HTTP message")
    n, digest = int(length[1]), headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if not re.fullmatch("[0-9a-f]{64}", digest):
        raise ValueError("no payload digest")
    if headers["warc-type"] == "revisit":
        if payload or headers.get("warc-profile") != PROFILE or "warc-refers-to" not in headers:
            raise ValueError("bad revisit")
        return n, digest, None
    if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("the payload is not what its headers announce")
    return n, digest, payload


def frames(stream, chunk: int = 1 << 14) -> Iterator[bytes]:
    """The decoded frames of an archive; memory holds one frame and a piece of the file."""
    data = stream.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:])[0]
        body = stream.read(size)
        if len(body) != size:
            raise ValueError("the dictionary is cut off")
        if body[:4] == struct.pack("<I", FRAME_MAGIC):
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
        dictionary, data = zstandard.ZstdCompressionDict(body), b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    data = data or stream.read(chunk)
    while data:
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("the last frame is cut off")
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
        yield b"".join(parts)
        data = data or stream.read(chunk)


def with_first(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to: the smallest page_id with the same payload where the page only revisits it.

    Pages that share that smallest id are all responses. A null page_id never is the smallest.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("html"))
    plain = plain.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    large = plain.where(F.octet_length("html") >= least)
    first = large.groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = plain.join(first, F.col("digest") == F.col("_digest"), "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.withColumn("refers_to", refers).select("page_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 3, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``folder``; returns (path, records, bytes) of each archive."""
    dictionary = train(pages)
    rows = with_first(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        out, path, done, sizes = None, "", [], [0, 0]

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, *sizes))
                out = None

        for batch in batches:
            html = batch.column("html").cast(pa.binary())
            ids, urls, digests, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            for i in range(batch.num_rows):
                if out is None:
                    store.create_dir(base, recursive=True)
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(open_store(path)[1], compression=None)
                    out.write(head := leading_frame(dictionary))
                    sizes = [0, len(head)]
                own = f"urn:page:{ids[i]}" if ids[i] is not None else f"urn:nopage:{digests[i][:32]}"
                first = None if refers[i] is None else f"urn:page:{refers[i]}"
                frame = packer.compress(record("revisit" if first else "response", own, urls[i], html[i].as_py(), digests[i], first, date))
                out.write(frame)
                sizes = [sizes[0] + 1, sizes[1] + len(frame)]
                if sizes[1] >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read_archives(paths: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row per record of the archives in ``paths`` (path): page_id, url, record_type, refers_to, payload (null in a
    revisit), payload_bytes and payload_digest of the full payload, archive. A record or frame that is not well formed ends the job with its file and number."""

    def number(urn: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
        return int(found[1]) if found else None

    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "archive"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                store, base = open_store(path)
                with store.open_input_stream(base, compression=None) as stream:
                    for at, frame in enumerate(frames(stream)):
                        try:
                            headers, block = parse_record(frame)
                            if headers["warc-type"] not in ("response", "revisit"):
                                continue
                            n, digest, payload = parse_response(headers, block)
                        except ValueError as wrong:
                            raise ValueError(f"{path}, record {at}: {wrong}") from wrong
                        rows.append((number(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], number(headers.get("warc-refers-to", "")), payload, n, digest, path))
                        held += len(frame)
                        if held >= batch_bytes or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, archive string"
    n = max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return paths.select("path").repartition(n).mapInArrow(run, schema)


def archives_below(spark, folder: str) -> DataFrame:
    """(path) of the archives in a folder that Spark can list; their content is not read here."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back (``read_archives``).

    Each row is a record; equal payloads of LEAST_REVISIT bytes or more are stored once, by the smallest page_id, and revisited by the
    others; pages that repeat that id are responses too. A null html is an empty payload, a null url leaves its header out, a null page_id gets a
    record id without a number and is read back as null; white space in a url is percent-encoded. Other columns are not stored; an empty table
    gives no archive and no rows.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder))
