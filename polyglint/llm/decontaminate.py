"""Benchmark decontamination: passages of a corpus within a small edit distance of a benchmark item.

Texts are sequences of words.  A CGK random walk turns edit distance into Hamming
distance: at step j the walk emits the current word and moves on by a random bit of
(j, word).  Some emitted words, sampled at fixed steps, make a key; an item and a
window of its size that starts at any word meet if one of many keys is equal.  Pairs
that meet are verified by exact edit distance against all passages around the window.

Windows are opened where the text shares enough word trigrams with some item for a match
to be possible at all (the q-gram lemma), so nothing is lost by skipping the rest.

Items that are too short for that (fewer than least_words words, or so short that the
allowed edits could leave no trigram) are matched exactly, word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import small, written

Q = 3


def allowed(words: int, share: float) -> int:
    """Word edits that an item of so many words may differ by."""
    return int(share * words + 1e-9)


def least_shared(words: int, share: float) -> int:
    """So many trigrams of an item survive the allowed edits, at least."""
    return words - Q + 1 - Q * allowed(words, share)


class Walks:
    """CGK walks with sampled steps: `repeats` keys of `bits` emitted words each."""

    def __init__(self, repeats: int, bits: int, steps: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.repeats, self.bits, self.steps = repeats, bits, steps
        self.salts = rng.integers(1, 1 << 63, size=(repeats, -(-steps // 64)), dtype=np.uint64)
        self.sampled = np.sort(np.stack([rng.choice(steps, size=bits, replace=False) for _ in range(repeats)]), axis=1)

    def keys(self, words: np.ndarray, starts: np.ndarray, repeat: int) -> np.ndarray:
        """A key per start.  words ends with padding so that no walk leaves it."""
        at = starts.copy()
        key = np.full(len(starts), repeat, dtype=np.uint64)
        sampled = set(self.sampled[repeat].tolist())
        last = int(self.sampled[repeat][-1])
        top = len(words) - 1
        with np.errstate(over="ignore"):
            for block in range(len(self.salts[repeat])):
                moves = tokens.mix(words ^ self.salts[repeat][block])
                for j in range(block * 64, min(self.steps, block * 64 + 64)):
                    if j in sampled:
                        key = tokens.mix(key * np.uint64(0x9E3779B97F4A7C15) + words[at])
                        if j == last:
                            return key
                    at += ((moves[at] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
                    np.minimum(at, top, out=at)
        return key


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = list(words)
    for _ in range(edits):
        kind, at = int(rng.integers(3)), int(rng.integers(len(out)))
        if kind == 0:
            out[at] = rng.integers(1, 1 << 63)
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, rng.integers(1, 1 << 63))
    return np.array(out, dtype=np.uint64)


class Index:
    """Items by length class, with walks enough for the target recall at the allowed distance.

    Made once, by the driver; workers get it as it is.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], share: float, recall: float, bits: int, seed: int, least_words: int = 8) -> None:
        self.share, self.items = share, items
        self.classes: list[dict] = []
        by: dict[int, list[int]] = {}
        short: dict[int, list[int]] = {}
        for i, (_, words) in enumerate(items):
            if len(words) >= least_words and least_shared(len(words), share) > 0:
                by.setdefault(int(math.log(len(words), 1.25)), []).append(i)
            else:
                short.setdefault(len(words), []).append(i)
        #: by number of words: sorted hashes of all words of the items that are matched exactly, and the items
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, members in short.items():
            keys = np.array([tokens.ngrams(items[i][1], np.array([0, size]), size)[0][0] for i in members])
            order = np.argsort(keys, kind="stable")
            self.exact[size] = keys[order], np.array(members)[order]
        grams = [tokens.ngrams(items[i][1], np.array([0, len(items[i][1])]), Q)[0] for members in by.values() for i in members]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[(self.grams >> np.uint64(44)).astype(np.int64)] = True
        for members in by.values():
            shortest = min(len(items[i][1]) for i in members)
            longest = max(len(items[i][1]) for i in members)
            # two steps a word on average: sampled steps stay clear of the end of the shortest item
            steps = max(bits, int(1.5 * shortest))
            repeats = self._repeats([items[i][1] for i in members], bits, steps, share, recall, seed)
            walks = Walks(repeats, bits, steps, seed)
            padded, starts = self._joined([items[i][1] for i in members], steps)
            tables = []
            for r in range(repeats):
                keys = walks.keys(padded, starts, r)
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], np.array(members)[order]))
            need = min(least_shared(len(items[i][1]), share) for i in members)
            self.classes.append({"walks": walks, "tables": tables, "need": need, "reach": longest + allowed(longest, share), "longest": longest})

    @staticmethod
    def _joined(parts: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
        pad = np.full(steps + 1, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        starts = np.concatenate([[0], np.cumsum([len(p) + len(pad) for p in parts])[:-1]]).astype(np.int64)
        return np.concatenate([x for p in parts for x in (p, pad)]), starts

    def _repeats(self, parts: list[np.ndarray], bits: int, steps: int, share: float, recall: float, seed: int, trial_keys: int = 64) -> int:
        """Keys needed: from the share of equal keys between items and copies with all allowed edits.

        An error where that takes more than 1024 keys, or the share is too small to be told:
        fewer bits a key then reach the recall.
        """
        rng = np.random.default_rng(seed + 1)
        trials = Walks(trial_keys, bits, steps, seed + 2)
        pairs = [parts[int(rng.integers(len(parts)))] for _ in range(64)]
        a, sa = self._joined(pairs, steps)
        b, sb = self._joined([_edited(p, allowed(len(p), share), rng) for p in pairs], steps)
        equal = np.stack([trials.keys(a, sa, r) == trials.keys(b, sb, r) for r in range(trial_keys)])
        # the mean over items of the chance that all keys miss, for growing numbers of keys; none seen counts as half a one
        chance = np.clip(equal.mean(axis=0), 0.5 / trial_keys, 0.999)
        for repeats in range(1, 1025):
            if ((1 - chance) ** repeats).mean() <= 1 - recall:
                return repeats
        raise ValueError(f"a recall of {recall} at a share of {share} takes more than 1024 keys of {bits} words: use fewer bits")


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """(distance, start, end) of the passage of text nearest to item: any start, any end.

    Of equal distances the first end counts, and of its alignments the one that starts
    last.  Distances above `most` are reported as most + 1.
    """
    m, n = len(item), len(text)
    row = np.zeros(n + 1, dtype=np.int64)
    begin = np.arange(n + 1)
    scale = n + 2
    for i in range(1, m + 1):
        # distance and start in one number: smaller distance first, then the later start
        packed = row * scale + (n - begin)
        diagonal = packed[:-1] + np.where(text == item[i - 1], 0, scale)
        up = packed + scale
        best = up.copy()
        best[1:] = np.minimum(best[1:], diagonal)
        # steps along the text cost one each: a running minimum after removing the slope
        slope = np.arange(n + 1) * scale
        best = np.minimum.accumulate(best - slope) + slope
        row, begin = best // scale, n - best % scale
    end = int(np.argmin(row))
    distance = int(row[end])
    return (distance, int(begin[end]), end) if distance <= most else (most + 1, 0, 0)


def find(index: Index, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item place, distance, start word, end word) for each text and item that match."""
    return sorted(_exact(index, words, bounds) + _near(index, words, bounds))


def _exact(index: Index, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The first place of each short item in each text."""
    found: dict[tuple[int, int], int] = {}
    for size, (keys, members) in index.exact.items():
        grams, gram_bounds = tokens.ngrams(words, bounds, size)
        hits = np.flatnonzero(np.isin(grams, keys))
        for at, text in zip(hits.tolist(), (np.searchsorted(gram_bounds, hits, side="right") - 1).tolist()):
            place = at - int(gram_bounds[text])
            if place + size <= bounds[text + 1] - bounds[text]:
                for k in range(int(np.searchsorted(keys, grams[at])), int(np.searchsorted(keys, grams[at], side="right"))):
                    found.setdefault((text, int(members[k])), place)
    return [(text, item, 0, place, place + len(index.items[item][1])) for (text, item), place in found.items()]


def _near(index: Index, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    if not len(words) or not len(index.grams):
        return []
    grams, gram_bounds = tokens.ngrams(words, bounds, Q)
    maybe = np.flatnonzero(index.bitmap[(grams >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(index.grams, grams[maybe])
    at[at == len(index.grams)] = 0
    hits = maybe[index.grams[at] == grams[maybe]]
    if not len(hits):
        return []
    owner = np.searchsorted(gram_bounds, hits, side="right") - 1
    place = hits - gram_bounds[owner] + bounds[owner]
    pad = max(c["walks"].steps for c in index.classes) + 1
    words = np.concatenate([words, np.full(pad, 0xFFFFFFFFFFFFFFFF, np.uint64)])
    met: list[np.ndarray] = []
    for c in index.classes:
        need, reach = c["need"], c["reach"]
        if len(hits) < need:
            continue
        first, last = place[: len(place) - need + 1], place[need - 1 :]
        dense = (last - first <= reach) & (owner[: len(place) - need + 1] == owner[need - 1 :])
        anchors = np.flatnonzero(dense)
        if not len(anchors):
            continue
        # every word from one reach before the first shared trigram to the anchor starts a window
        low = np.maximum(place[anchors] - reach, bounds[owner[anchors]])
        high = place[anchors]
        covered = np.maximum.accumulate(high)
        low = np.maximum(low, np.concatenate([[0], covered[:-1] + 1]))
        lengths = np.maximum(high - low + 1, 0)
        starts = np.repeat(low - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        if not len(starts):
            continue
        # walks run on the neighbourhood of the windows only
        text_of = np.searchsorted(bounds, starts, side="right") - 1
        for piece in np.array_split(np.arange(len(starts)), -(-len(starts) // 200_000)):
            s = starts[piece]
            used = np.unique((s[:, None] + np.arange(0, c["walks"].steps + 1, 64)[None, :]) // 64)
            used = used[used * 64 < len(words)]
            if (used[-1] - used[0] + 1) > 4 * len(used):
                # far apart: renumber the blocks of 64 words that are touched
                blocks = np.unique(np.concatenate([used, used + 1]))
                blocks = blocks[blocks * 64 < len(words)]
                index_of = (blocks[:, None] * 64 + np.arange(64)[None, :]).ravel()
                local = np.where(index_of < len(words), words[np.minimum(index_of, len(words) - 1)], np.uint64(0xFFFFFFFFFFFFFFFF))
                shifted = np.searchsorted(blocks, s // 64) * 64 + s % 64
            else:
                base = used[0] * 64
                local, shifted = words[base : used[-1] * 64 + 128 + pad], s - base
            for r, (keys, members) in enumerate(c["tables"]):
                mine = c["walks"].keys(local, shifted, r)
                lo, hi = np.searchsorted(keys, mine, side="left"), np.searchsorted(keys, mine, side="right")
                k = np.flatnonzero(hi > lo)
                if len(k):
                    each = hi[k] - lo[k]
                    ends = np.cumsum(each)
                    item = members[np.repeat(lo[k] - ends + each, each) + np.arange(int(ends[-1]))]
                    met.append(np.stack([np.repeat(text_of[piece[k]], each), item, np.repeat(s[k], each)]))
            if sum(m.shape[1] for m in met) > 1_000_000:
                met = [np.unique(np.concatenate(met, axis=1), axis=1)]
    meetings = np.unique(np.concatenate(met, axis=1), axis=1).T.tolist() if met else []
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    by: dict[tuple[int, int], list[int]] = {}
    for text, item, start in meetings:
        by.setdefault((text, item), []).append(start)
    for (text, item), starts_here in by.items():
        wanted = index.items[item][1]
        most = allowed(len(wanted), index.share)
        reach = len(wanted) + most
        starts_here.sort()
        at = 0
        while at < len(starts_here):
            stop = at
            while stop + 1 < len(starts_here) and starts_here[stop + 1] - starts_here[stop] <= reach:
                stop += 1
            low = max(int(bounds[text]), starts_here[at] - reach)
            high = min(int(bounds[text + 1]), starts_here[stop] + 2 * reach)
            distance, begin, end = edit_distance(wanted, words[low:high], most)
            if distance <= most:
                new = (distance, low + begin - int(bounds[text]), low + end - int(bounds[text]))
                found[text, item] = min(found.get((text, item), new), new)
            at = stop + 1
    return [(text, item, *rest) for (text, item), rest in sorted(found.items())]


def load_items(benchmark: DataFrame, least_exact: int, most_bytes: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(item_id, word hashes) of items of at least least_exact words, in parts of about most_bytes of text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    parts = max(1, -(-size // most_bytes))
    for part in range(parts):
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        table = mine.distinct().orderBy("item_id", "text").toArrow()
        words, _, _, bounds = tokens.words(table.column("text"))
        ids = table.column("item_id").to_pylist()
        yield [(ids[i], words[bounds[i] : bounds[i + 1]].copy()) for i in range(len(ids)) if bounds[i + 1] - bounds[i] >= least_exact]


_FOUND_SQL = "doc_id long, item_id long, distance int, start_word int, end_word int"
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start_word", pa.int32()), ("end_word", pa.int32())])


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.97, bits: int = 2, least_words: int = 8, least_exact: int = 5, seed: int = 7, most_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word): the passage nearest to an item, where one is near enough.

    Near enough: at most share x words of the item in word insertions, deletions and
    replacements; case and punctuation don't count.  recall is the least share of such
    passages with all allowed edits that is found, by simulation over the items.  Items
    below least_words words, and those of which so many edits could leave no trigram, are
    found by exact copies; items below least_exact words, which ordinary texts hold by
    chance, and null ones, match nothing.

    Null and empty texts match nothing; very long ones are searched whole.  Of passages
    of equal distance the one that ends first counts, and of its alignments the one that
    starts last.  Repeated rows give repeated results, a null doc_id stays null; items
    with one item_id are items of their own.  Extra columns are ignored, whatever their
    names; empty tables give no rows.  A benchmark of more than most_bytes of text is
    searched for in parts, each a pass over docs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in tokens.slices(batch, "text"):
                    words, _, _, bounds = tokens.words(part.column("text"))
                    found = find(index, words, bounds)
                    if found:
                        ids = part.column("doc_id").to_pylist()
                        each = [(ids[t], index.items[i][0], d, s, e) for t, i, d, s, e in found]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*each), _FOUND)], schema=_FOUND)

        return rows.mapInArrow(run, _FOUND_SQL)

    out = None
    for items in load_items(benchmark, least_exact, most_bytes):
        if items:
            found = search(spark.sparkContext.broadcast(Index(items, share, recall, bits, seed, least_words)))
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], _FOUND_SQL) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a passage near a benchmark item; columns stay.

    All rows of a doc_id go together; a row without doc_id can't be named and stays.
    Otherwise like contaminated().
    """
    bad = written(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("__found")).where("__found is not null").distinct(), "contaminated")
    return docs.join(small(bad), docs["doc_id"].cast("long") == bad["__found"], "left_anti")
