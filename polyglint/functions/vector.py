"""Normalisation and ngram windows of whole Arrow batches at once.

The rules are those of polyglint.functions.text; a table of all characters of the basic
plane, made from the same patterns, replaces the regular expressions.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from polyglint.functions.text import BLANK, MAX_N, MERGED

#: Texts are worked on in pieces of about so many bytes.
SLICE_BYTES = 1 << 18


def _python(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m.group(1), 16):04x}", pattern))


@functools.cache
def fold_table() -> np.ndarray:
    """What each character of the basic plane becomes, as a number; 32 for all blanks."""
    out = np.arange(1 << 16, dtype=np.uint32)
    merged = [(_python(p), ord(letter)) for p, letter in MERGED]
    blank = _python(BLANK)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        low = {"Σ": "σ", "İ": "i"}.get(chr(c)) or chr(c).lower()
        for pattern, letter in merged:
            if pattern.match(low):
                low = chr(letter)
        out[c] = 32 if blank.match(low) else ord(low[0])
    return out


def fold(codes: np.ndarray) -> np.ndarray:
    """Folded characters, as numbers."""
    table = fold_table()
    if int(codes.max(initial=0)) < 1 << 16:
        return table[codes]
    far = codes >= 1 << 16
    out = table[np.where(far, 0, codes)]
    astral, place = np.unique(codes[far], return_inverse=True)
    out[far] = np.array([ord(chr(c).lower()) for c in astral.tolist()], dtype=np.uint32)[place]
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def squeezed(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which characters stay: of blanks in a row only the first, counted anew from each of `firsts` on."""
    blank = codes == 32
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[firsts] = True
    return keep


def normalized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The normalised characters of all texts, and the len+1 offsets; a null text has none."""
    rows = texts.to_pylist()
    codes = fold(codes_of("".join([f" {t} " for t in rows if t is not None])))
    lengths = pc.fill_null(pc.add(pc.utf8_length(texts), 2), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    keep = squeezed(codes, offsets[:-1][lengths > 0])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], kept[offsets]


def padded(chars: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """chars with `pad` zeros behind each text: the array, the places of the characters in it, the text of each."""
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(chars)) + pad * text
    out = np.zeros(len(chars) + pad * len(lengths), dtype=chars.dtype)
    out[place] = chars
    return out, place, text


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about most_bytes of text each; a longer text is a piece of its own."""
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def window_starts(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of normalised characters, those that the hashed mode has, and those at which its windows start.

    It has no blank behind a text, unless that is all of it, and of N characters starts at
    those from 0 to max(0, N - n + 1).
    """
    lengths = np.diff(offsets)
    size = np.repeat(np.maximum(lengths - 1, np.minimum(lengths, 1)), lengths)
    at = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], lengths)
    there = at < size
    return there, there & (at <= np.maximum(0, size - (n - 1)))


def window_counts(texts: pa.Array, n: int = MAX_N, clipped: bool = False) -> tuple[list[str], np.ndarray]:
    """The distinct windows of n characters (fewer at the end of a text) and how often each occurs; if clipped, those of the hashed mode."""
    chars, offsets = normalized(texts)
    if not len(chars):
        return [], np.zeros(0, np.int64)
    if int(chars.max()) < 1 << 16:
        there = np.zeros(1 << 16, dtype=bool)
        there[chars] = True
        alphabet, ids = np.flatnonzero(there), (np.cumsum(there) - 1)[chars]
    else:
        alphabet, ids = np.unique(chars, return_inverse=True)
    bits = int(len(alphabet)).bit_length()
    if bits * n > 64:  # more characters than fit: count the texts in two parts
        half = len(texts) // 2
        if not half:
            return _counted_plainly(chars, offsets, n, clipped)
        one, two = window_counts(texts.slice(0, half), n, clipped), window_counts(texts.slice(half), n, clipped)
        return one[0] + two[0], np.concatenate([one[1], two[1]])
    ids = (ids + 1).astype(np.uint64)
    if clipped:
        kept, starts = window_starts(offsets, n)
        ids[~kept] = 0
    spaced, place, _ = padded(ids, offsets, n - 1)
    if clipped:
        place = place[starts]
    keys = spaced[place]
    for k in range(1, n):
        keys = keys | spaced[place + k] << np.uint64(bits * k)
    found, counts = np.unique(keys, return_counts=True)
    letters = np.concatenate([[0], alphabet]).astype(np.uint32)
    digits = np.stack([letters[((found >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)).astype(np.int64)] for k in range(n)], axis=1)
    # numpy's own strings of fixed width drop the zeros at the end
    return np.ascontiguousarray(digits).view(f"<U{n}").ravel().tolist(), counts


def _counted_plainly(chars: np.ndarray, offsets: np.ndarray, n: int, clipped: bool) -> tuple[list[str], np.ndarray]:
    """window_counts() of one text."""
    starts = range(len(chars))
    if clipped:
        kept, first = window_starts(offsets, n)
        chars, starts = chars[kept], np.flatnonzero(first).tolist()
    text = chars.tobytes().decode("utf-32-le", "surrogatepass")
    seen: dict[str, int] = {}
    for at in starts:
        seen[text[at : at + n]] = seen.get(text[at : at + n], 0) + 1
    return list(seen), np.array(list(seen.values()), dtype=np.int64)


class Tally:
    """Sums of a column `n` by some keys, of rows that come bit by bit; more than `most` rows are given out and begun anew."""

    def __init__(self, keys: list[str], most: int = 1 << 18) -> None:
        self.keys, self.most, self.held, self.rows = keys, most, [], 0

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Partial sums, if there are too many to keep."""
        self.held.append(rows)
        self.rows += rows.num_rows
        if self.rows > 2 * self.most:
            self._settle()
            if self.rows > self.most:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """The sums that are left."""
        if self.held:
            self._settle()
            found, self.held, self.rows = self.held[0], [], 0
            yield from found.to_batches(max_chunksize=1 << 16)

    def _settle(self) -> None:
        found = pa.concat_tables(self.held).group_by(self.keys, use_threads=False).aggregate([("n", "sum")])
        self.held = [found.select([*self.keys, "n_sum"]).rename_columns([*self.keys, "n"])]
        self.rows = found.num_rows
