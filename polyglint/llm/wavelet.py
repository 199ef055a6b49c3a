"""Token ids of documents as wavelet matrices, one compressed file per shard.

A wavelet matrix keeps one plane of bits per bit of a token id, the ids stably sorted by
the bits above.  With counts of ones before every chunk a plane answers rank, and so the
matrix answers access, count, rank and select without ever holding the ids themselves.

The file has its rank directory at the front and each chunk of a plane as a frame of its
own: a question reads the directory and a few chunks, whatever the size of the shard.
"""

from __future__ import annotations

import base64
import io
import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

MAGIC = b"PGWM2\n\0\0"
_HEAD = struct.Struct("<8sqqqq")  # magic, tokens, planes, documents, bits per chunk
CHUNK_BITS = 1 << 16
#: The pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class WaveletMatrix:
    """Token access, counting and occurrence lookup over one shard file.

    source is the file's bytes or a readable, seekable file.  The directory is read at
    once; document ids, token offsets and chunks of planes when they are asked for.
    """

    def __init__(self, source, kept_chunks: int = 256) -> None:
        self._file = io.BytesIO(source) if isinstance(source, (bytes, bytearray, memoryview)) else source
        head = self._read(0, _HEAD.size)
        if len(head) < _HEAD.size or head[: len(MAGIC)] != MAGIC:
            raise ValueError("no wavelet shard")
        _, self.n, self.width, self.documents, self.chunk = _HEAD.unpack(head)
        self.chunks = -(-self.n // self.chunk)
        cells = self.width * self.chunks
        directory = np.frombuffer(self._read(_HEAD.size, 8 * (self.width + 3 + 2 * cells)), "<i8")
        if len(directory) < self.width + 3 + 2 * cells:
            raise ValueError("shard cut short")
        self.zeros = directory[: self.width].tolist()
        #: ones of a plane before each of its chunks
        self.ones = directory[self.width : self.width + cells].reshape(self.width, self.chunks)
        self._ends = directory[self.width + cells :]  # of the frames: document ids, which of them are null, offsets, chunks
        self._data = _HEAD.size + 8 * len(directory)
        self._unpack = zstandard.ZstdDecompressor().decompress
        self._cache: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        self._kept, self._doc_ids, self._starts = kept_chunks, None, None
        #: chunks that were unpacked so far
        self.unpacked = 0

    def _read(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        return self._file.read(size)

    def _frame(self, k: int) -> bytes:
        start = int(self._ends[k - 1]) if k else 0
        return self._unpack(self._read(self._data + start, int(self._ends[k]) - start))

    @property
    def doc_ids(self) -> np.ndarray:
        if self._doc_ids is None:
            ids = np.frombuffer(self._frame(0), "<i8").astype(object)
            ids[np.unpackbits(np.frombuffer(self._frame(1), np.uint8))[: len(ids)].astype(bool)] = None
            self._doc_ids = ids
        return self._doc_ids

    @property
    def starts(self) -> np.ndarray:
        """Token offsets of the documents, and the end."""
        if self._starts is None:
            self._starts = np.frombuffer(self._frame(2), "<i8")
        return self._starts

    def _bits(self, level: int, chunk: int) -> np.ndarray:
        """The packed bits of a chunk, in whole words."""
        key = (level, chunk)
        if key not in self._cache:
            raw = self._frame(3 + level * self.chunks + chunk)
            self._cache[key] = np.frombuffer(raw + b"\0" * (-len(raw) % 8), np.uint8)
            self.unpacked += 1
            if len(self._cache) > self._kept:
                self._cache.popitem(last=False)
        else:
            self._cache.move_to_end(key)
        return self._cache[key]

    def bit(self, level: int, i: int) -> int:
        bits, i = self._bits(level, i // self.chunk), i % self.chunk
        return int(bits[i >> 3] >> (7 - (i & 7))) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        if i >= self.n:
            return self.n - self.zeros[level]
        chunk, rest = divmod(i, self.chunk)
        count = int(self.ones[level, chunk])
        if rest:
            bits, words = self._bits(level, chunk), rest >> 6
            count += int(np.bitwise_count(bits[: words * 8].view(np.uint64)).sum()) + int(np.bitwise_count(bits[words * 8 : rest >> 3]).sum())
            if rest & 7:
                count += int(np.bitwise_count(bits[rest >> 3] >> np.uint8(8 - (rest & 7))))
        return count

    def _rank(self, level: int, bit: int, i: int) -> int:
        return self.rank1(level, i) if bit else i - self.rank1(level, i)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane: its chunk by the directory, then within it."""
        before = self.ones[level] if bit else np.arange(self.chunks) * self.chunk - self.ones[level]
        chunk = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._bits(level, chunk))[: min(self.chunk, self.n - chunk * self.chunk)]
        return chunk * self.chunk + int(np.flatnonzero(bits == bit)[k - int(before[chunk])])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.width):
            bit = self.bit(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + self.rank1(level, i) if bit else i - self.rank1(level, i)
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """The run of the token's copies among the first i places, in the order of the last plane."""
        lo, hi = 0, i
        if token < 0 or token >> self.width:
            return 0, 0
        for level in range(self.width):
            bit = token >> (self.width - 1 - level) & 1
            lo, hi = self._rank(level, bit, lo), self._rank(level, bit, hi)
            if bit:
                lo, hi = lo + self.zeros[level], hi + self.zeros[level]
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before place i."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of the token."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(self.width)):
            bit = token >> (self.width - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens, undoing the planes from the last to the first."""
        order = np.zeros(self.n, dtype=np.uint32)
        for level in reversed(range(self.width)):
            parts = [np.unpackbits(self._bits(level, c))[: min(self.chunk, self.n - c * self.chunk)] for c in range(self.chunks)]
            bits = np.concatenate(parts).astype(bool) if parts else np.zeros(0, dtype=bool)
            back = np.empty(self.n, dtype=np.uint32)
            back[~bits] = order[: self.zeros[level]]
            back[bits] = order[self.zeros[level] :]
            order = back | (bits.astype(np.uint32) << np.uint32(self.width - 1 - level))
        return order

    def document(self, k: int) -> list[int]:
        """Tokens of the k-th document of the shard."""
        return [self.access(i) for i in range(int(self.starts[k]), int(self.starts[k + 1]))]


def encode(ids: np.ndarray, width: int, doc_ids: list[int | None], starts: np.ndarray, level: int = 1, chunk_bits: int = CHUNK_BITS) -> bytes:
    """The shard file: head, directory (zeros of each plane, ones before each chunk, ends of the frames), zstandard frames."""
    pack = zstandard.ZstdCompressor(level=level, write_checksum=False).compress
    blank = np.array([d is None for d in doc_ids], dtype=bool)
    frames = [pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes()), pack(np.packbits(blank).tobytes()), pack(starts.astype("<i8").tobytes())]
    now, zeros, ones = ids, [], []
    for at in range(width - 1, -1, -1):
        set_bits = (now >> now.dtype.type(at)) & now.dtype.type(1) != 0
        packed = np.packbits(set_bits)
        frames += [pack(packed[c : c + chunk_bits // 8].tobytes()) for c in range(0, len(packed), chunk_bits // 8)]
        if len(now):
            found = np.add.reduceat(set_bits, np.arange(0, len(now), chunk_bits), dtype=np.int64)
            ones.append(np.cumsum(found) - found)
        low = now[~set_bits]
        zeros.append(len(low))
        now = np.concatenate([low, now[set_bits]])
    directory = np.concatenate([np.array(zeros, "<i8"), *ones, np.cumsum([len(f) for f in frames])]).astype("<i8")
    return _HEAD.pack(MAGIC, len(ids), width, len(doc_ids), chunk_bits) + directory.tobytes() + b"".join(frames)


def decode(blob: bytes) -> WaveletMatrix:
    """Open a shard's content; raises ValueError if it isn't one."""
    return WaveletMatrix(blob)


def open_shard(path: str) -> WaveletMatrix:
    """Open a shard file on any file system that pyarrow knows; only what a question needs is read."""
    files, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return WaveletMatrix(files.open_input_file(place))


def write_shards(shard_table: DataFrame, folder: str) -> DataFrame:
    """(shard, path, bytes): each shard as a file `<shard>.pgwm` below folder, a URI that all workers can write to.

    A file appears under its name only once it is whole, so a task that is run again loses
    and doubles nothing.  Written when the result is read; an empty table writes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                files.create_dir(root, recursive=True)
                waiting = f"{root}/.{name}.{attempt}"
                with files.open_output_stream(waiting) as out:
                    out.write(content.as_buffer())
                files.move(waiting, f"{root}/{name}.pgwm")
                rows.append((name, f"{folder.rstrip('/')}/{name}.pgwm", len(content.as_buffer())))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["shard", "path", "bytes"])

    return shard_table.select("shard", "content").mapInArrow(run, "shard string, path string, bytes long")


class Tokenizer:
    """A public byte-level vocabulary (rank file), with a cache of the pieces between blanks.

    A text may be cut before any blank that a word follows without changing its tokens, as
    a blank only ever starts a piece of the pattern there; the same holds around a single
    line break between words.  Equal pieces of a batch are tokenised once.
    """

    def __init__(self, path: str, cached: int = 300_000) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary = max(ranks.values()) + 1
        self.width = max(1, (self.vocabulary - 1).bit_length())
        self.kind = np.uint16 if self.width <= 16 else np.uint32
        self.encoding = tiktoken.Encoding("shard", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cached = cached
        self._reset()

    def _reset(self) -> None:
        """The cache: sorted piece hashes, and where the tokens of each lie in one long array."""
        self.keys = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    #: bytes that surely aren't white space, alone or as the first byte of a character
    _SOLID = np.zeros(256, dtype=bool)
    _SOLID[33:127] = True
    _SOLID[0xC3:0xE0] = True
    _SOLID[0xE4:] = True

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Start of every piece."""
        size = len(data)
        cut = np.zeros(size + 1, dtype=bool)
        cut[offsets] = True
        solid = self._SOLID[data]
        if size > 1:
            cut[:-2] |= (data[:-1] == 32) & solid[1:]
        if size > 2:
            ascii_solid = (data > 32) & (data < 127)
            single = np.flatnonzero((data[1:-1] == 10) & ascii_solid[:-2] & solid[2:]) + 1
            cut[single] = True
            cut[single + 1] = True
        return np.flatnonzero(cut[:size])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of an Arrow string array, joined, and the len+1 offsets; null has none."""
        data, offsets = tokens.utf8(texts)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        starts = self.cuts(data, offsets)
        stops = np.append(starts[1:], len(data))
        up, down = tokens._POWERS.get(len(data) + 1)
        with np.errstate(over="ignore"):
            part = data.astype(np.uint64)
            part += np.uint64(1)
            part *= up[: len(part)]
            total = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
            del part
            keys = tokens.mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
            del total
        order = np.argsort(keys)
        sorted_keys = keys[order]
        new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        unique, first = sorted_keys[new], order[new]
        inverse = np.empty(len(keys), dtype=np.int64)
        inverse[order] = np.cumsum(new) - 1
        at = np.searchsorted(self.keys, unique)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), dtype=bool)
        missing = np.flatnonzero(~known)
        if len(missing):
            if len(self.keys) + len(missing) > self.cached:
                self._reset()
                missing = np.arange(len(unique))
            raw = data.tobytes()
            pieces = [raw[a:b].decode("utf-8") for a, b in zip(starts[first[missing]].tolist(), stops[first[missing]].tolist())]
            encode = self.encoding._core_bpe.encode_ordinary
            lists = [encode(p) for p in pieces]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((t for x in lists for t in x), self.kind, int(lengths.sum()))
            places = len(self.pool) + np.cumsum(lengths) - lengths
            keys_all = np.concatenate([self.keys, unique[missing]])
            order = np.argsort(keys_all, kind="stable")
            self.keys = keys_all[order]
            self.places = np.concatenate([self.places, places])[order]
            self.lengths = np.concatenate([self.lengths, lengths])[order]
            self.pool = np.concatenate([self.pool, flat])
            at = np.searchsorted(self.keys, unique)
        lengths, places = self.lengths[at][inverse], self.places[at][inverse]
        ends = np.cumsum(lengths)
        source = np.repeat(places - (ends - lengths), lengths) + np.arange(int(ends[-1]))
        piece_offsets = np.searchsorted(starts, offsets)
        return self.pool[source], np.concatenate([[0], ends])[piece_offsets]

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes([int(i) for i in ids]).decode("utf-8")


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One per worker and path."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


_SHARD_SQL = "shard string, documents long, tokens long, doc_ids array<long>, starts array<long>, content binary"
_SHARD = pa.schema([("shard", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("content", pa.binary())])


def shards(docs: DataFrame, vocabulary: str, tokens_per_shard: int = 2_000_000) -> DataFrame:
    """One row per shard: its name, sizes, document ids, token offsets and the file's content.

    Documents stay where and in the order in which they lie, so nothing is shuffled; a
    shard is closed once it has tokens_per_shard tokens, never within a document.  A null
    or empty text is a document without tokens, a null doc_id stays null, repeated rows
    are kept, extra columns are ignored, and an empty table gives no shards.  A very long
    text is one document of one shard, which it may make larger than asked for.
    vocabulary is the path of a rank file that all workers can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        partition = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        total = number = 0

        def close() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
            blob = encode(np.concatenate(held), coder.width, ids, starts)
            row = [[f"{partition:06d}-{number:05d}"], [len(ids)], [total], [ids], [starts.tolist()], [blob]]
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(row, _SHARD)], schema=_SHARD)

        for batch in batches:
            for part in tokens.slices(batch, "text"):
                found, offsets = coder.encode(part.column("text"))
                names = part.column("doc_id").to_pylist()
                at = 0
                while at < len(names):
                    stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + tokens_per_shard - total)))
                    stop = min(stop, len(names))
                    held.append(found[offsets[at] : offsets[stop]])
                    ids += names[at:stop]
                    lengths.append(np.diff(offsets[at : stop + 1]))
                    total += int(offsets[stop] - offsets[at])
                    if total >= tokens_per_shard:
                        yield close()
                        held, ids, lengths, total, number = [], [], [], 0, number + 1
                    at = stop
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SHARD_SQL)


def occurrences(shard_table: DataFrame, token: int) -> DataFrame:
    """(shard, doc_id, offset) of every occurrence of a token, found by select in each shard's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist()):
                matrix = decode(content)
                places = [matrix.select(token, k) for k in range(matrix.count(token))]
                doc = np.searchsorted(matrix.starts, places, side="right") - 1
                yield pa.RecordBatch.from_pydict({"shard": [name] * len(places), "doc_id": pa.array([matrix.doc_ids[d] for d in doc], pa.int64()), "offset": pa.array([p - int(matrix.starts[d]) for p, d in zip(places, doc)], pa.int64())})

    return shard_table.select("shard", "content").mapInArrow(run, "shard string, doc_id long, offset long")
