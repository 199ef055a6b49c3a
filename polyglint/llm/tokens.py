"""Vectorised word hashing shared by the text operators of this subpackage.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of
the lower-cased text.  All texts of an Arrow batch are handled at once on their
UTF-8 buffer: a polynomial prefix hash gives every word its 64-bit hash without a
Python loop over words or characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_PATTERN = r"[a-z0-9\u0080-\U0010ffff]+"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_WORD = np.zeros(256, dtype=bool)
for _r in (range(48, 58), range(97, 123), range(65, 91), range(128, 256)):
    _IS_WORD[list(_r)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _CHUNK + (1 << 16))
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()
_CHUNK = 1 << 20
#: Texts are worked on in pieces of about so many bytes, so that a worker's arrays stay small.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about most_bytes of a string or binary column each; a longer value is a piece of its own."""
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        stop = min(stop, at + 60_000)
        yield batch.slice(at, stop - at)
        at = stop


def utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the len+1 offsets into them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their byte starts and ends, and the len+1 word offsets of each text.

    Byte positions refer to the concatenated lower-cased texts.  Null and empty texts
    have no words.
    """
    if lower:
        texts = pc.utf8_lower(texts)
    data, offsets = utf8(texts)
    return runs(data, offsets, _IS_WORD[data])


def lines(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the non-empty lines, and the len+1 offsets of each text."""
    data, offsets = utf8(texts)
    hashes, _, _, bounds = runs(data, offsets, data != 10)
    return hashes, bounds


def runs(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the maximal runs of wanted bytes, and the len+1 offsets of each text."""
    size = len(data)
    if size == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.empty(size + 1, dtype=bool)
    inside[:size] = wanted
    inside[size] = False
    # a word never crosses a text boundary
    start = inside[:size].copy()
    start[1:] &= ~inside[: size - 1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < size]
    start[cuts] = inside[cuts]
    stop = inside[:size] & ~inside[1:]
    before = cuts[cuts > 0] - 1
    stop[before] |= inside[before]
    starts = np.flatnonzero(start)
    stops = np.flatnonzero(stop) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = np.searchsorted(starts, np.arange(0, size + _CHUNK, _CHUNK))
    with np.errstate(over="ignore"):
        for k in range(len(at) - 1):
            lo, hi = at[k], at[k + 1]
            if lo == hi:
                continue
            first, last = starts[lo], stops[hi - 1]
            up, down = _POWERS.get(last - first + 1)
            part = data[first:last].astype(np.uint64)
            part += np.uint64(1)
            part *= up[: len(part)]
            total = np.empty(len(part) + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(part, out=total[1:])
            s, e = starts[lo:hi] - first, stops[lo:hi] - first
            hashes[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return hashes, starts, stops, np.searchsorted(starts, offsets)


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text and the len+1 offsets.

    A text of 1..n-1 words has one n-gram, all its words; a text without words has none.
    """
    counts = np.diff(bounds)
    out_counts = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(out_counts)])
    total = int(out_bounds[-1])
    owner = np.repeat(np.arange(len(counts)), out_counts)
    first = np.arange(total) - out_bounds[owner] + bounds[owner]
    length = np.minimum(counts[owner], n)
    out = np.full(total, 0x243F6A8885A308D3, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            if (length > k).all():
                out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[first + k]
            else:
                has = np.flatnonzero(length > k)
                out[has] = out[has] * np.uint64(0xD6E8FEB86659FD93) + hashes[first[has] + k]
        return mix(out), out_bounds


def distinct_per_text(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and the len+1 offsets."""
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    grams = grams.copy()
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        grams[lo:hi].sort()
    first = np.ones(len(grams), dtype=bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    kept = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(counts)))])
    return grams[first], kept.astype(np.int64)
