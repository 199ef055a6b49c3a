"""A table of ngrams that workers hold: exact keys, vectorised look-ups, sums along prefixes.

The characters of the table get small numbers, so that an ngram packs into one 64-bit key
without collisions; a character that no ngram has is 0, as is the end of a text, so a key
with zeros behind is that of the shorter ngram.

The values of the ngrams are a dense matrix while there are few columns, and else only
those that are there, as most ngrams are known to a few of many languages.
"""

from __future__ import annotations

import numpy as np

from polyglint.functions import vector

_ODD = np.uint64(0x9E3779B97F4A7C15)


#: Tables of more columns are kept sparse.
DENSE_COLUMNS = 16


class Dense:
    """Rows of values as a matrix."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix, self.columns = matrix, matrix.shape[1]

    def add_rows(self, to: np.ndarray, of: np.ndarray, origin: Dense) -> None:
        self.matrix[to] += origin.matrix[of]

    def copied(self) -> Dense:
        return Dense(self.matrix.copy())

    def settled(self) -> None:
        pass

    def grouped(self, rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """Sums of rows by ascending group."""
        out = np.zeros((groups, self.columns))
        if len(rows):
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            for c in range(self.columns):
                out[group[starts], c] = np.add.reduceat(self.matrix[rows, c], starts)
        return out


class Sparse:
    """Rows of values as columns and values of those that aren't 0."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int) -> None:
        self.rows, self.columns = rows, columns
        self._parts = [(row.astype(np.int64), column.astype(np.int64), value)]
        self.settled()

    def settled(self) -> None:
        """Entries of equal row and column become one; rows are found by their starts."""
        row, column, value = (np.concatenate(x) for x in zip(*self._parts))
        key = row * self.columns + column
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        row, self.column = key[first] // self.columns, (key[first] % self.columns).astype(np.int32)
        self.value = np.add.reduceat(value, first) if len(first) else value
        self.starts = np.searchsorted(row, np.arange(self.rows + 1))
        self._parts = []

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of rows, one row after the other, and how many each row has."""
        each = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        return np.repeat(self.starts[rows] - ends + each, each) + np.arange(total), each

    def copied(self) -> Sparse:
        out = Sparse.__new__(Sparse)
        out.__dict__ = dict(self.__dict__)
        out._parts = [(np.repeat(np.arange(self.rows), np.diff(self.starts)), self.column.astype(np.int64), self.value)]
        return out

    def add_rows(self, to: np.ndarray, of: np.ndarray, origin: Sparse) -> None:
        place, each = origin._entries(of)
        self._parts.append((np.repeat(to, each), origin.column[place].astype(np.int64), origin.value[place]))

    def grouped(self, rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        place, each = self._entries(rows)
        key = np.repeat(group, each) * self.columns + self.column[place]
        return np.bincount(key, weights=self.value[place], minlength=groups * self.columns).reshape(groups, self.columns)


class Lookup:
    """ngrams (distinct, up to n characters) with a row of values each."""

    def __init__(self, ngrams: list[str], values: np.ndarray | Dense | Sparse, n: int) -> None:
        values = Dense(values) if isinstance(values, np.ndarray) else values
        chars = [vector.codes_of(g) for g in ngrams]
        used = np.unique(np.concatenate(chars)) if chars else np.zeros(0, np.uint32)
        self.n, self.bits = n, max(1, int(len(used)).bit_length())
        if self.bits * n > 64:
            raise ValueError(f"{len(used)} characters are too many for keys of {n}")
        self.alphabet = np.zeros(1 << 16, dtype=np.uint64)
        near = used[used < 1 << 16]
        self.alphabet[near] = np.flatnonzero(used < 1 << 16) + 1
        self.far = {int(c): k + 1 for k, c in enumerate(used.tolist()) if c >= 1 << 16}
        lengths = np.array([len(c) for c in chars], dtype=np.int64)
        ids = self.ids(np.concatenate(chars)) if chars else np.zeros(0, np.uint64)
        spaced, place, _ = vector.padded(ids, np.concatenate([[0], np.cumsum(lengths)]), n)
        firsts = place[np.concatenate([[0], np.cumsum(lengths)[:-1]])] if chars else np.zeros(0, np.int64)
        self.keys, self.values, self.lengths = self.packed(spaced, firsts, n), values, lengths
        self._hash()

    def ids(self, chars: np.ndarray) -> np.ndarray:
        far = chars >= 1 << 16
        if not far.any():
            return self.alphabet[chars]
        out = self.alphabet[np.where(far, 0, chars)]
        out[far] = [self.far.get(c, 0) for c in chars[far].tolist()]
        return out

    def packed(self, spaced: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """Keys of `size` characters from each place on; spaced has size - 1 zeros behind each text at least."""
        keys = spaced[place]
        for k in range(1, size):
            keys = keys | spaced[place + k] << np.uint64(self.bits * k)
        return keys

    def _hash(self) -> None:
        """Open addressing with at most a third of the slots in use."""
        size = max(8, int(3 * len(self.keys)).bit_length())
        self.shift = np.uint64(64 - size)
        self.slots, self.rows = np.zeros(1 << size, dtype=np.uint64), np.full(1 << size, -1, dtype=np.int32)
        left = np.arange(len(self.keys))
        slot = (self.keys * _ODD >> self.shift).astype(np.int64)
        while len(left):
            free = self.slots[slot] == 0
            taken, first = np.unique(slot[free], return_index=True)
            mine = np.flatnonzero(free)[first]
            self.slots[taken], self.rows[taken] = self.keys[left[mine]], left[mine]
            rest = np.ones(len(left), dtype=bool)
            rest[mine] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << size) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it isn't in the table."""
        slot = (keys * _ODD >> self.shift).astype(np.int64)
        held = self.slots[slot]
        out = np.where(held == keys, self.rows[slot], -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.slots) - 1)
            held = self.slots[slot]
            hit = held == keys[left]
            out[left[hit]] = self.rows[slot[hit]]
            more = ~hit & (held != 0)
            left, slot = left[more], slot[more]
        out[keys == 0] = -1
        return out

    def along_prefixes(self) -> Lookup:
        """The same ngrams with the sums over all of their prefixes that are in the table, themselves included."""
        out = Lookup.__new__(Lookup)
        out.__dict__ = dict(self.__dict__)
        out.values = self.values.copied()
        for size in range(1, self.n):
            row = self.find(self.keys & np.uint64((1 << self.bits * size) - 1))
            there = (row >= 0) & (self.lengths > size)
            # a key cut to `size` characters is that of a prefix of just this length
            out.values.add_rows(np.flatnonzero(there), row[there], self.values)
        out.values.settled()
        return out

    def sums(self, texts, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """(ngram occurrences, sums of values) of each text of an Arrow array, for a table with sums along prefixes.

        Each place of a text looks up the longest ngram of the table that starts there.
        """
        chars, offsets = vector.normalized(texts)
        lengths = np.diff(offsets)
        total = np.zeros((len(lengths), self.values.columns))
        spaced, place, text = vector.padded(self.ids(chars), offsets, self.n - 1)
        chunk = max(1 << 12, min(chunk, (1 << 23) // max(1, self.values.columns)))
        for at in range(0, len(place), chunk):
            keys = self.packed(spaced, place[at : at + chunk], self.n)
            row = self.find(keys)
            for size in range(self.n - 1, 0, -1):
                left = np.flatnonzero(row < 0)
                if not len(left):
                    break
                row[left] = self.find(keys[left] & np.uint64((1 << self.bits * size) - 1))
            hit = row >= 0
            row, owner = row[hit], text[at : at + chunk][hit]
            if len(row):
                low, high = int(owner[0]), int(owner[-1]) + 1
                total[low:high] += self.values.grouped(row, owner - low, high - low)
        return sum(np.maximum(lengths - k, 0) for k in range(self.n)), total


class Reader:
    """Reads texts from front to end until their language is sure: a table of gains by language, without sums along prefixes."""

    def __init__(self, table: Lookup, base: float, every: int, good: float) -> None:
        self.table, self.base, self.every, self.good = table, base, every, good

    def start(self) -> tuple[int, np.ndarray, int, bool]:
        """known ngrams, sums of gains, leading language or -1, enough?"""
        return 0, np.zeros(self.table.values.columns), -1, False

    def read(self, text: str | None, state: tuple[int, np.ndarray, int, bool] | None = None) -> tuple[int, np.ndarray, int, bool]:
        """The state after a text; what is behind the place where it is sure is neither normalised nor looked up."""
        known, sums, leader, enough = state or self.start()
        if text is None or enough or not len(self.table.keys):
            return known, sums, leader, enough
        n, at, block = self.table.n, 0, 384
        held, last = np.array([32], dtype=np.uint32), False
        while not last:
            piece = vector.codes_of(text[at : at + block])
            at, block = at + block, min(2 * block, 1 << 16)
            last = at >= len(text)
            codes = vector.fold(np.append(piece, np.uint32(32)) if last else piece)
            codes = np.concatenate([held, codes])
            # the characters held back are squeezed already and stay so
            codes = codes[vector.squeezed(codes, np.zeros(0, np.int64))]
            usable = len(codes) if last else max(0, len(codes) - n + 1)
            held = codes[usable:]
            spaced = np.concatenate([self.table.ids(codes), np.zeros(n, np.uint64)])
            place = np.arange(usable)
            keys = np.zeros((usable, n), dtype=np.uint64)
            keys[:, 0] = spaced[:usable]
            for k in range(1, n):
                more = spaced[place + k]
                # 0 where the next character is unknown or the text over: no ngram of this length, and none longer
                keys[:, k] = np.where((more > 0) & (keys[:, k - 1] > 0), keys[:, k - 1] | more << np.uint64(self.table.bits * k), 0)
            row = self.table.find(keys.ravel())
            row = row[row >= 0]
            if len(row):
                # one group of known ngrams up to each look, and one behind the last
                group = (known % self.every + np.arange(len(row))) // self.every
                running = sums + np.cumsum(self.table.values.grouped(row, group, int(group[-1]) + 1), axis=0)
                looks = (known % self.every + len(row)) // self.every
                for k in range(looks):
                    weights = np.exp(running[k] - running[k].max())
                    best = int(weights.argmax())
                    now = best if weights[best] > self.good * weights.sum() else -1
                    if now >= 0 and now == leader:
                        return known - known % self.every + (k + 1) * self.every, running[k], now, True
                    leader = now
                sums, known = running[-1], known + len(row)
        return known, sums, leader, False

    def scores(self, state: tuple[int, np.ndarray, int, bool]) -> np.ndarray:
        return state[0] * self.base + state[1]
