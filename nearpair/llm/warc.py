"""Web archives (WARC 1.1) in Zstandard: one frame per record, the dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself in a
frame or plain; each record is one frame made with it; other skippable frames mean nothing. Archives
are files written by Spark's committer, so lost tasks leave nothing behind: the text writer puts
down the bytes as they are, and its line separator is an empty skippable frame.

A payload found more than once is stored once: the record of the smallest id is the response, the
others are revisits that refer to it. Every record keeps the HTTP header with the payload's full
length, and its digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpair.llm.tables import column, shared_path, written

ARCHIVE = 32 << 20  # bytes of records in an archive, about; a longer record is its own archive's last
SAMPLE = 2 << 20  # bytes of an archive's first records on which its dictionary is trained
SAMPLE_PART = 16 << 10  # bytes taken from one of them
DICTIONARY = 64 << 10  # most bytes of a dictionary
WINDOW = 8 << 10  # compressed bytes given to the decoder at once
HOT_GROUPS = 1 << 16  # groups of copies that may travel to every task

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50  # to ...5F
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # a skippable frame without content
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
REQUIRED = ("warc-record-id", "warc-type", "warc-date", "content-length")

_HEAD_END = b"\r\n\r\n"
_PAIR = struct.Struct("<II")


# -- writing -------------------------------------------------------------------------------


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """`id, url, n_bytes, sha1, refers_to, payload` of each page; refers_to is null for responses.

    Of equal payloads of at least `least_bytes` the smallest id's is the response; rows that repeat
    that id are responses too. A null id is larger than all; where all are null, none is a revisit.
    A null payload is empty. Revisits carry no payload. Groups of more than 1 / HOT_GROUPS of all
    copies (at most HOT_GROUPS, as counted) are broadcast and lose their payloads before the
    shuffle; the others' rows are joined by digest. Without copies nothing is shuffled.
    """
    payload = F.coalesce(column(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(column(id_col).cast("bigint").alias("id"), column(url_col).cast("string").alias("url"), payload.alias("payload"))
    size, key = F.octet_length("payload"), F.sha2("payload", 256)
    found = rows.filter(size >= least_bytes).groupBy(key.alias("key")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    found = written(found.filter((F.col("copies") > 1) & F.col("first").isNotNull()), "copies")
    total = found.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    rows = rows.select("id", "url", "payload", size.cast("bigint").alias("n_bytes"), F.sha1("payload").alias("sha1"), key.alias("key"))
    first = F.lit(None).cast("bigint")
    if total:
        hot = F.col("copies") > total // HOT_GROUPS
        rows = rows.join(F.broadcast(found.filter(hot).select("key", "first")), "key", "left")
        rows, first = rows.withColumn("payload", F.when(_stays("first"), F.col("payload"))), F.col("first")
        rest = found.filter(~hot).select(F.col("key").alias("rare"), F.col("first").alias("rare_first"))
        if total > HOT_GROUPS:
            # what a hot group decided is dealt by its id, not by the digest it shares
            deal = F.when(F.col("first").isNull(), F.col("key")).otherwise(F.concat(F.lit("-"), F.col("id").cast("string")))
            rows = rows.withColumn("deal", deal).join(rest, F.col("deal") == F.col("rare"), "left")
            first = F.coalesce("first", "rare_first")
    rows = rows.withColumn("first", first)
    return rows.select(
        "id", "url", "n_bytes", "sha1", F.when(~_stays("first"), F.col("first")).alias("refers_to"),
        F.when(_stays("first"), F.col("payload")).alias("payload"),
    )


def _stays(first: str) -> Column:
    return F.col(first).isNull() | F.col("id").eqNullSafe(F.col(first))


def record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _record(kind: str, name: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines)
    return head.encode() + b"\r\n" + block + _HEAD_END


def _uri(url: str) -> str:
    """Without control characters and spaces, which would end a header line."""
    return "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url)


def page_record(page: int | None, url: str | None, n_bytes: int, sha1: str, refers_to: int | None, payload: bytes | None, date: str) -> bytes:
    """The record's bytes; `sha1` in hexadecimal."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    headers = [("WARC-Target-URI", _uri(url))] if url else []
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return _record("response" if refers_to is None else "revisit", record_id(page), date, headers, http + (payload or b""))


def trained_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from the records, or none where they are too few."""
    parts = [r[:SAMPLE_PART] for r in records]
    total = sum(map(len, parts))
    if len(parts) < 8 or total < 4 << 10:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, total // 16)), parts, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_bytes(records: list[bytes], dictionary: bytes = b"", level: int = 3) -> list[bytes]:
    """The dictionary's frame, if there is one, and a frame for each record."""
    frames = [_PAIR.pack(DICTIONARY_MAGIC, len(dictionary)), dictionary] if dictionary else []
    return frames + _compress(records, _compressor(dictionary, level))


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level, dict_data=data, write_checksum=True, write_content_size=True)


def _compress(records: list[bytes], compressor: zstandard.ZstdCompressor) -> list[bytes]:
    return [compressor.compress(r) for r in records]


def _archives(size: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        frames: list[bytes] = []
        waiting: list[bytes] = []  # the first records, until there is a dictionary
        compressor, raw = None, 0

        def settle() -> None:
            nonlocal compressor
            if compressor is None:
                dictionary = trained_dictionary(waiting)
                frames.extend(archive_bytes(waiting, dictionary, level))
                compressor = _compressor(dictionary, level)
                waiting.clear()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], ["value"])

        for batch in batches:
            for page in zip(*[batch.column(c).to_pylist() for c in ("id", "url", "n_bytes", "sha1", "refers_to", "payload")]):
                if not raw:
                    waiting.append(_record("warcinfo", f"<urn:archive:{part}-{serial}>", date, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                record = page_record(*page, date)
                raw += len(record)
                if compressor is None:
                    waiting.append(record)
                    if raw >= SAMPLE:
                        settle()
                else:
                    frames.append(compressor.compress(record))
                if raw >= size:
                    settle()
                    yield row()
                    frames.clear()
                    compressor, raw, serial = None, 0, serial + 1
        if raw:
            settle()
            yield row()

    return run


def write_archives(records: DataFrame, path: str, size: int = ARCHIVE, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of `page_records` below `path`, a file each, in the records' order and partitions.

    An archive holds about `size` bytes of records, a task no more of them than that and its
    frames. An empty table writes no archive.
    """
    archives = records.mapInArrow(_archives(size, level, date), "value binary")
    archives = archives.select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


# -- reading -------------------------------------------------------------------------------


class BadArchive(ValueError):
    """What is wrong with an archive or a record."""


def frames_of(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each record's frame; the dictionary is read first.

    Raises BadArchive where the next frame cannot be found.
    """
    view, at, dictionary = memoryview(data), 0, None
    while at < len(view):
        if at + 8 > len(view):
            raise BadArchive(f"{len(view) - at} bytes after the last frame")
        magic, size = _PAIR.unpack_from(view, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            if at + 8 + size > len(view):
                raise BadArchive(f"skippable frame at {at} is cut off")
            if magic == DICTIONARY_MAGIC and not at:
                dictionary = _dictionary(bytes(view[8 : 8 + size]))
            at += 8 + size
            continue
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, low = [], at
        try:
            while not decoder.eof and at < len(view):
                some = view[at : at + WINDOW]
                parts.append(decoder.decompress(some))
                at += len(some) - len(decoder.unused_data)
        except zstandard.ZstdError as error:
            raise BadArchive(f"frame at {low}: {error}") from None
        if not decoder.eof:
            raise BadArchive(f"frame at {low} is cut off")
        yield low, at - low, b"".join(parts)


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    try:
        if raw[:4] == FRAME_MAGIC.to_bytes(4, "little"):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        return zstandard.ZstdCompressionDict(raw)
    except zstandard.ZstdError as error:
        raise BadArchive(f"dictionary: {error}") from None


def _headers(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or b" " in name:
            raise BadArchive(f"header line {line[:40]!r}")
        try:
            key, text = name.decode("ascii").lower(), value.strip().decode()
        except UnicodeDecodeError:
            raise BadArchive(f"header line {line[:40]!r}") from None
        if key in found and key in (*REQUIRED, "warc-payload-digest", "warc-refers-to"):
            raise BadArchive(f"two headers {key}")
        found[key] = text
    return found


def _length(text: str | None, what: str) -> int:
    if text is None or not (text.isascii() and text.isdigit()):
        raise BadArchive(f"{what} {text!r}")
    return int(text)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (names in lower case) and the block of a record that fills its frame."""
    end = raw.find(_HEAD_END)
    if end < 0:
        raise BadArchive("no end of the headers")
    version, *lines = raw[:end].split(b"\r\n")
    if version not in VERSIONS:
        raise BadArchive(f"version {version[:20]!r}")
    headers = _headers(lines)
    for name in REQUIRED:
        if name not in headers:
            raise BadArchive(f"no header {name}")
    if headers["warc-type"] not in TYPES:
        raise BadArchive(f"type {headers['warc-type']!r}")
    low, length = end + 4, _length(headers["content-length"], "content-length")
    if len(raw) != low + length + 4 or raw[low + length :] != _HEAD_END:
        raise BadArchive(f"content-length {length}, but {len(raw) - low - 4} bytes")
    return headers, raw[low : low + length]


def http_payload(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes]:
    """Length and digest of the full payload, and the payload as stored (none for a revisit)."""
    end = block.find(_HEAD_END)
    if end < 0:
        raise BadArchive("no end of the HTTP headers")
    status, *lines = block[:end].split(b"\r\n")
    if not status.startswith(b"HTTP/"):
        raise BadArchive(f"HTTP status {status[:20]!r}")
    length = _length(_headers(lines).get("content-length"), "HTTP content-length")
    kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
    payload = block[end + 4 :]
    if headers["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in headers or kind != "sha1":
            raise BadArchive("a revisit needs a digest, what it refers to, and no payload")
        return length, digest, b""
    if len(payload) != length:
        raise BadArchive(f"HTTP content-length {length}, but {len(payload)} bytes")
    real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest and (kind, digest) != ("sha1", real):
        raise BadArchive(f"digest {kind}:{digest}, but sha1:{real}")
    return length, real, payload


_FIELDS = [
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("error", pa.string()), ("payload", pa.binary()),
]
_RECORDS = (
    "archive string, offset bigint, length bigint, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_bytes bigint, payload_digest string, error string, payload binary"
)


def _read(archive: str, data: bytes, with_payload: bool) -> Iterator[tuple]:
    frames = frames_of(data)
    at = 0
    while True:
        try:
            offset, length, raw = next(frames)
        except StopIteration:
            return
        except BadArchive as error:
            yield (archive, at, None, None, None, None, None, None, None, str(error), None)
            return
        at = offset + length
        headers, size, digest, payload, wrong = {}, None, None, None, None
        try:
            headers, block = parse_record(raw)
            payload = block
            if headers["warc-type"] in ("response", "revisit"):
                size, digest, payload = http_payload(headers, block)
        except BadArchive as error:
            wrong = str(error)
        values = [headers.get(k) for k in ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to")]
        yield (archive, offset, length, *values, size, digest, wrong, payload if with_payload else None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives below `path`, read as files by Spark (2 GB at most each):
    `archive, offset, length` (of its frame), `record_type, record_id, target_uri, refers_to`,
    `payload_bytes, payload_digest` (of responses and revisits: the full payload's), `error`, `payload`.

    error: what is wrong with the record, null if nothing: version, headers, lengths, a frame
    that holds more or less than its record, a digest. Where a frame cannot be decoded, one row
    tells so and the archive's rest is not read. An empty file has no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                for row in _read(name, content.as_py(), with_payload):
                    rows.append(row)
                    held += len(row[-1] or b"") + 256
                    if held >= 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), _FIELDS)]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in _FIELDS])


def unresolved_revisits(records: DataFrame) -> DataFrame:
    """The revisits that refer to no response of their digest."""
    there = records.filter("record_type = 'response' AND error IS NULL")
    there = there.select(F.col("record_id").alias("refers_to"), "payload_digest").distinct()
    return records.filter("record_type = 'revisit'").join(there, ["refers_to", "payload_digest"], "left_anti")


def page_of(name: str) -> Column:
    """The page's id in a record's name; null for none."""
    return F.regexp_extract(F.col(name), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def archived_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the pages to archives (in the shared folder unless `path` is given), reads them back:
    `page_id, payload_bytes, payload_digest, record_type, refers_to, error`."""
    path = path or shared_path(pages.sparkSession, "archives")
    write_archives(page_records(pages, **options), path)
    found = read_archives(pages.sparkSession, path).filter("record_type IS NULL OR record_type <> 'warcinfo'")
    return found.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"), "error"
    )
