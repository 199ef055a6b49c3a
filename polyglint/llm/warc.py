"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: A record of more bytes isn't kept: a cell of a table can't hold much more.
MOST_RECORD = 1 << 30
_VERSION = re.compile(rb"WARC/1\.[01]$")
_LENGTH = re.compile(r"[0-9]{1,18}$")
_NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    payload: bytes
    error: str | None


class _Feed:
    """A file read from front to end, some bytes at a time."""

    def __init__(self, file: BinaryIO, piece: int = 1 << 16) -> None:
        self.file, self.piece, self.held, self.at = file, piece, b"", 0

    def peek(self, size: int) -> bytes:
        while len(self.held) < size and (more := self.file.read(max(self.piece, size - len(self.held)))):
            self.held += more
        return self.held[:size]

    def take(self, size: int) -> bytes:
        out = self.peek(size)
        self.held, self.at = self.held[len(out) :], self.at + len(out)
        return out

    def back(self, rest: bytes) -> None:
        self.held, self.at = rest + self.held, self.at - len(rest)


def _skippable(feed: _Feed, keep: bool) -> bytes:
    """Pass over a skippable frame; its content if it is to be kept."""
    magic, size = struct.unpack("<II", feed.take(8))
    parts, left = [], size
    while left:
        piece = feed.take(min(left, feed.piece))
        if not piece:
            raise ValueError(f"skippable frame cut short by {left} bytes")
        left -= len(piece)
        if keep:
            parts.append(piece)
    return b"".join(parts)


def _dictionary(feed: _Feed) -> zstandard.ZstdCompressionDict | None:
    head = feed.peek(4)
    if len(head) < 4 or struct.unpack("<I", head)[0] != DICTIONARY_MAGIC:
        return None
    if len(feed.peek(8)) < 8:
        raise ValueError("dictionary frame cut short")
    raw = _skippable(feed, keep=True)
    if raw[:4] == FRAME_MAGIC:  # the dictionary itself may be compressed
        unpacker = zstandard.ZstdDecompressor().decompressobj()
        raw = unpacker.decompress(raw)
        if not unpacker.eof:
            raise ValueError("compressed dictionary cut short")
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _digest_differs(said: str, block: bytes) -> bool:
    """Whether a labelled digest, in hexadecimal or base 32, isn't that of the block; unknown algorithms aren't judged."""
    name, colon, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in ("sha1", "sha256", "sha512", "md5"):
        return False
    found = hashlib.new(name, block, usedforsecurity=False)
    value = value.strip().rstrip("=")
    return value.lower() != found.hexdigest() and value.upper() != base64.b32encode(found.digest()).decode().rstrip("=")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Headers (names in lower case), block and error of one decoded record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not _VERSION.match(lines[0]):
        return {}, b"", "no WARC header"
    headers: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:  # a folded line
            headers[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            return headers, b"", f"malformed header line {line[:40]!r}"
        last = name.strip().lower()
        headers[last] = value.strip()
    missing = [n for n in _NEEDED if not headers.get(n)]
    if missing:
        return headers, b"", "missing " + ", ".join(missing)
    if not _LENGTH.match(headers["content-length"]):
        return headers, b"", "malformed content-length"
    length = int(headers["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) < length:
        return headers, block, f"block has {len(block)} of {length} bytes"
    if tail != b"\r\n\r\n":
        return headers, block, f"{len(tail)} bytes after the block instead of two line ends"
    if _digest_differs(headers.get("warc-block-digest", ""), block):
        return headers, block, "block digest differs"
    return headers, block, None


def read_archive(content: bytes | BinaryIO, most_record: int = MOST_RECORD) -> Iterator[Record]:
    """The records of an archive, given as bytes or as a file that is read once from front to end.

    A damaged frame ends the archive, as the next one can't be found for sure: it gives a
    last record with an error, and so does a skippable frame that runs past the end.  A
    record of more than most_record bytes is decoded to its end but not kept: it gives an
    error of its own, and the archive goes on.  Later skippable frames are passed over.
    """
    feed = _Feed(io.BytesIO(content) if isinstance(content, (bytes, bytearray, memoryview)) else content)
    try:
        dictionary = _dictionary(feed)
        unpacker = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    except (ValueError, zstandard.ZstdError) as e:
        yield Record(0, {}, b"", f"dictionary: {e}")
        return
    while head := feed.peek(8):
        at = feed.at
        try:
            if len(head) == 8 and 0x184D2A50 <= struct.unpack_from("<I", head)[0] <= 0x184D2A5F:
                _skippable(feed, keep=False)
                continue
            frame = unpacker.decompressobj()
            parts, size = [], 0
            # fed bit by bit, so that memory follows the record and not the rest of the file
            while not frame.eof:
                feed.peek(1)
                piece = feed.take(min(len(feed.held), feed.piece))
                if not piece:
                    raise ValueError("frame cut short")
                parts.append(frame.decompress(piece))
                size += len(parts[-1])
                if size > most_record:
                    parts.clear()
            feed.back(frame.unused_data)
        except (ValueError, zstandard.ZstdError) as e:
            yield Record(at, {}, b"", f"frame: {e}")
            return
        if size > most_record:
            yield Record(at, {}, b"", f"frame: record of more than {most_record} bytes")
        else:
            yield Record(at, *parse_record(b"".join(parts)))


def write_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archive(records: list[bytes], dictionary_bytes: int = 32 << 10, level: int = 3, samples: int = 400, sample_bytes: int = 8 << 10) -> bytes:
    """An archive of all records, with a dictionary fitted on the starts of up to `samples` of them (none where there are fewer than 16)."""
    head, options = b"", {}
    samples = [r[:sample_bytes] for r in records[:samples]]
    if len(samples) >= 16:
        try:
            trained = zstandard.train_dictionary(dictionary_bytes, samples)
        except zstandard.ZstdError:
            trained = None
        if trained:
            raw = zstandard.ZstdCompressor().compress(trained.as_bytes())
            head, options = struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw, {"dict_data": trained}
    packer = zstandard.ZstdCompressor(level=level, **options)
    return head + b"".join(packer.compress(r) for r in records)


_ARCHIVE_SQL = "name string, content binary"
_RECORD = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("length", pa.int64()), ("block", pa.binary()), ("error", pa.string()), ("headers", pa.map_(pa.string(), pa.string()))])
_RECORD_SQL = "archive string, offset long, record_id string, type string, uri string, date string, length long, block binary, error string, headers map<string,string>"


def pack_pages(pages: DataFrame, bytes_per_archive: int = 16 << 20) -> DataFrame:
    """(name, content): pages (page_id, url, html) as response records; one row per archive, closed by size.

    Null html is an empty block; a null url or page_id leaves its header out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                block = (html or "").encode()
                identity = uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {url}")
                headers = {"WARC-Type": "resource", "WARC-Record-ID": f"<urn:uuid:{identity}>", "WARC-Date": "2024-01-01T00:00:00Z"}
                if url is not None:
                    headers["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", url)
                if page is not None:
                    headers["X-Page-ID"] = str(page)
                if html is None:
                    headers["X-Null"] = "html"
                headers |= {"Content-Type": "text/html", "WARC-Block-Digest": "sha1:" + hashlib.sha1(block).hexdigest(), "Content-Length": str(len(block))}
                held.append(write_record(headers, block))
                size += len(held[-1])
                if size >= bytes_per_archive:
                    yield pa.RecordBatch.from_pydict({"name": [f"{partition:06d}-{number:05d}.warc.zst"], "content": pa.array([write_archive(held)], pa.binary())})
                    held, size, number = [], 0, number + 1
        if held:
            yield pa.RecordBatch.from_pydict({"name": [f"{partition:06d}-{number:05d}.warc.zst"], "content": pa.array([write_archive(held)], pa.binary())})

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, _ARCHIVE_SQL)


def _rows(archive: str | None, content: bytes | BinaryIO, most_record: int, slice_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    for r in read_archive(content, most_record):
        h = r.headers
        rows.append((archive, r.offset, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), len(r.payload), r.payload, r.error, list(h.items())))
        size += len(r.payload)
        if size >= slice_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)


def read_records(archives: DataFrame, name: str = "name", content: str = "content", most_record: int = MOST_RECORD) -> DataFrame:
    """One row per record of each archive in a table, `error` null for valid ones.

    Null and empty content holds no records, and an empty table gives no rows.  A damaged
    archive gives its good records and one with the error; a record of more than
    most_record bytes gives an error and no block.  Header names are in lower case, of
    repeated headers the last one counts.  Extra columns are ignored, whatever their names;
    repeated archives are read each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _rows(batch.column("name")[k].as_py(), batch.column("content")[k].as_py() or b"", most_record)

    return archives.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInArrow(run, _RECORD_SQL)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as Spark writes it, and the path in it."""
    uri = re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]:", "s3:", uri))
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def scan(spark: SparkSession, path: str, most_record: int = MOST_RECORD) -> DataFrame:
    """Records of all .warc.zst files below a folder, one task per file at least.

    Workers read the files as streams, so an archive may be of any size; a file that can't
    be read fails its task, to be tried again.  Otherwise like read_records(); a folder
    without archives gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                files, place = _opened(uri)
                with files.open_input_stream(place, compression=None) as file:
                    yield from _rows(uri, file, most_record)

    return files.select("path").mapInArrow(run, _RECORD_SQL)


def write_archives(archives: DataFrame, folder: str) -> int:
    """Archives (name, content) as files below folder, a URI that all workers can write to; how many they are.

    A file appears under its name only once it is whole, so a task may run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                files.create_dir(root, recursive=True)
                waiting = f"{root}/.{name}.{attempt}"
                with files.open_output_stream(waiting, compression=None) as out:
                    out.write(content.as_buffer())
                files.move(waiting, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return archives.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
