"""N-gram Jaccard join: texts whose word n-gram sets reach a Jaccard threshold.

Texts with equal n-gram sets are collapsed into one set first.  Candidate sets meet
through prefix n-grams in rarest-first order and are seated in tiles; a tile is split
into bands of set size, each a threshold's factor wide, so that a set meets those of
its own band and of the next one only.  In such a cell hashed bitmap signatures of one
width bound each overlap from above before the sorted arrays are intersected exactly.

Nothing is capped.  A pair that meets in several tiles counts in the smallest of them,
so numbers of links add up without listing pairs: a cell gives one row per set, with its
links and the root of its part of the graph.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import discard, partitions_for, shuffle_partitions, small, written

#: A candidate link through an n-gram of a crowd; far below any number of shared n-grams.
NEVER = 1_000_000
#: N-grams that a task gathers before it hands them out to the buckets: at least, and at most where buckets are many.
FLUSH, MOST_FLUSH = 1_000_000, 12_000_000
#: Bytes of the stored table per partition of the candidate search; more partitions than this come from the session only.
PARTITION_BYTES, MOST_PARTITIONS = 8 << 20, 1 << 18


def gram_sets(texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes per text, their offsets, and a 64-bit identity per set."""
    hashes, _, _, bounds = tokens.words(texts)
    grams, bounds = tokens.distinct_per_text(*tokens.ngrams(hashes, bounds, n))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(tokens.mix(grams), dtype=np.uint64)])
        sums = total[bounds[1:]] - total[bounds[:-1]]
        ids = tokens.mix(sums ^ tokens.mix(np.diff(bounds).astype(np.uint64)))
    return grams, bounds, ids.view(np.int64)


def asked(sizes: np.ndarray, common: int, share: float) -> np.ndarray:
    """Prefix n-grams that a similar pair must share, by the smaller set's size."""
    return np.maximum(common, np.ceil(share * sizes - 1e-9).astype(np.int64))


def prefix_length(sizes: np.ndarray, threshold: float, common: int, share: float) -> np.ndarray:
    """So many first n-grams of a set that two similar sets share as many of them as asked, or all they must share."""
    need = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
    return np.minimum(sizes, sizes - need + asked(sizes, common, share))


def _small(values: np.ndarray) -> bytes:
    """Whole numbers in one, two or four bytes each, after a byte that tells which."""
    most = int(values.max(initial=0))
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _back(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32}[blob[0]], offset=1)


def _steps(places: np.ndarray) -> bytes:
    """Ascending places by their differences."""
    return _small(np.diff(places, prepend=0))


def _places(blob: bytes) -> np.ndarray:
    return np.cumsum(_back(blob), dtype=np.int64)


_GATHERED = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("grams", pa.binary()), ("places", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary())])
_GATHERED_SQL = "bucket int, batch long, grams binary, places binary, ids binary, sizes binary, docs binary"
MEMBERS, SETS = -1, -2


def _gather(n: int, buckets: int):
    """The one pass that makes the n-grams of all texts.

    Rows of bucket MEMBERS hold document ids with set ids and sizes; those of SETS and
    below, spread over as many buckets, the sets of a batch; the others the n-grams of a batch that fall into a bucket, 32 bits each, in
    the order of the sets.  Bucket and 32 bits stand for an n-gram from here on: two that
    fall together only add candidates.  A set that a task has met before isn't handed out
    again, so that a hot text comes once per task and not once per copy.
    """

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        waiting = sets = 0

        def flush() -> pa.RecordBatch:
            low, bucket, owner, ids, sizes = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            low, owner, ends = low[order], owner[order], np.append(first, len(order))
            spans = list(zip(ends[:-1], ends[1:]))
            columns = [
                pa.array([*used.tolist(), SETS - number % buckets], pa.int32()),
                pa.array([number] * (len(used) + 1), pa.int64()),
                pa.array([*[low[a:b].tobytes() for a, b in spans], None], pa.binary()),
                pa.array([*[_steps(owner[a:b]) for a, b in spans], None], pa.binary()),
                pa.array([*[None] * len(used), ids.tobytes()], pa.binary()),
                pa.array([*[None] * len(used), sizes.tobytes()], pa.binary()),
                pa.array([None] * (len(used) + 1), pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=_GATHERED)

        for batch in batches:
            for part in tokens.slices(batch, "text"):
                grams, bounds, ids = gram_sets(part.column("text"), n)
                sizes = np.diff(bounds).astype(np.int32)
                docs = part.column("doc_id").to_numpy()
                yield pa.RecordBatch.from_pydict({"bucket": [MEMBERS], "batch": [0], "grams": [None], "places": [None], "ids": [ids.tobytes()], "sizes": [sizes.tobytes()], "docs": [docs.tobytes()]}, schema=_GATHERED)
                fresh = np.zeros(len(ids), dtype=bool)
                for k, (i, size) in enumerate(zip(ids.tolist(), sizes.tolist())):
                    if size and i not in seen:
                        seen.add(i)
                        fresh[k] = True
                if not fresh.any():
                    continue
                owner = np.repeat(np.arange(len(ids)), sizes)
                mine = fresh[owner]
                grams, place = grams[mine], sets + np.cumsum(fresh) - 1
                kind = np.uint16 if buckets <= 1 << 16 else np.int32
                held.append((grams.astype(np.uint32), ((grams >> np.uint64(32)) % np.uint64(buckets)).astype(kind), place[owner[mine]].astype(np.int32), ids[fresh], sizes[fresh]))
                waiting, sets = waiting + len(grams), sets + int(fresh.sum())
                if waiting >= min(MOST_FLUSH, max(FLUSH, 40 * buckets)):
                    yield flush()
                    held, waiting, sets, number = [], 0, 0, number + 1
                if len(seen) > 250_000:  # forgetting only repeats work
                    seen.clear()
        if held:
            yield flush()

    return run


def _members(batches):
    """(doc_id, set_id, size) of the rows of MEMBERS, without repeated rows."""
    for batch in batches:
        for ids, sizes, docs in zip(*(batch.column(c) for c in ("ids", "sizes", "docs"))):
            rows = np.stack([np.frombuffer(docs.as_buffer(), np.int64), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(sizes.as_buffer(), np.int32).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32))], ["doc_id", "set_id", "size"])


_SHARED = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()), ("places", pa.binary()), ("levels", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])
_SHARED_SQL = "batch long, bucket int, grams binary, places binary, levels binary, ids binary, sizes binary"


def _shared(batches):
    """Of each batch's n-grams those that another batch or set has too.

    The shared n-grams of a bucket are numbered; the level of one is the binary order of
    magnitude of how often it was handed out.
    """
    by: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["grams"] is None:
                yield pa.RecordBatch.from_pylist([{"batch": row["batch"], "bucket": None, "grams": None, "places": None, "levels": None, "ids": row["ids"], "sizes": row["sizes"]}], schema=_SHARED)
            else:
                by.setdefault(row["bucket"], []).append((row["batch"], row["grams"], row["places"]))
    for bucket in sorted(by):
        blobs = by.pop(bucket)
        grams = np.frombuffer(b"".join(g for _, g, _ in blobs), np.uint32)
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        seen = np.diff(np.append(starts, len(ordered)))
        many = seen > 1
        of_run = np.where(many, np.cumsum(many) - 1, -1)
        number, level = np.empty(len(grams), dtype=np.int32), np.empty(len(grams), dtype=np.uint8)
        number[order] = np.repeat(of_run, seen)
        level[order] = np.repeat(np.log2(seen).astype(np.uint8), seen)
        rows: dict[str, list] = {f.name: [] for f in _SHARED}
        at = 0
        for name, blob, places in blobs:
            size = len(blob) // 4
            mine = np.flatnonzero(number[at : at + size] >= 0)
            if len(mine):
                values = (name, bucket, _small(number[at : at + size][mine]), _steps(_places(places)[mine]), level[at : at + size][mine].tobytes(), None, None)
                for key, value in zip(rows, values):
                    rows[key].append(value)
            at += size
        if rows["batch"]:
            yield pa.RecordBatch.from_pydict(rows, schema=_SHARED)


def _prefixes(threshold: float, common: int, share: float):
    """Postings of the prefix n-grams that another set has too, packed per bucket.

    A set's order is rarest first: n-grams of its own, which can meet nothing and aren't
    listed, then the shared ones by level, bucket and number.
    """

    def run(batches):
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is not None:
                    sets[row["batch"]] = (np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int32).astype(np.int64))
                else:
                    held.setdefault(row["batch"], []).append(row)
        out: list[tuple[np.ndarray, ...]] = []
        for name in sorted(held):
            rows = held.pop(name)
            ids, sizes = sets[name]
            parts = [_back(r["grams"]) for r in rows]
            grams = np.concatenate(parts).astype(np.uint32)
            level = np.frombuffer(b"".join(r["levels"] for r in rows), np.uint8)
            places = np.concatenate([_places(r["places"]) for r in rows])
            bucket = np.repeat(np.array([r["bucket"] for r in rows], np.int32), [len(g) for g in parts])
            shared = np.bincount(places, minlength=len(ids))
            wanted = prefix_length(sizes, threshold, common, share) - (sizes - shared)
            some = wanted[places] > 0
            grams, places, level, bucket = grams[some], places[some], level[some], bucket[some]
            order = np.lexsort((grams, bucket, level, places))
            starts = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=len(ids)))])
            ranked = places[order]
            chosen = order[np.arange(len(order)) - starts[ranked] < wanted[ranked]]
            out.append((bucket[chosen], grams[chosen], ids[places[chosen]], sizes[places[chosen]].astype(np.int32)))
        if not out:
            return
        bucket, grams, ids, sizes = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(bucket, kind="stable")
        bucket, grams, ids, sizes = bucket[order], grams[order], ids[order], sizes[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        for lo, hi in zip(starts, np.append(starts[1:], len(bucket))):
            yield pa.RecordBatch.from_pydict({"bucket": [int(bucket[lo])], "grams": [grams[lo:hi].tobytes()], "ids": [ids[lo:hi].tobytes()], "sizes": [sizes[lo:hi].tobytes()]}, schema=_PACKED)

    return run


_PACKED = pa.schema([("bucket", pa.int32()), ("grams", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])
_PACKED_SQL = "bucket int, grams binary, ids binary, sizes binary"
_HITS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int32()), ("hits", pa.int32())])
_HITS_SQL = "a long, b long, need int, hits int"


def _count_pairs(left: list[np.ndarray]) -> np.ndarray:
    """Rows (a, b, hits needed, hits) summed over equal a, b."""
    rows = np.concatenate(left, axis=1)
    order = np.lexsort((rows[1], rows[0]))
    rows = rows[:, order]
    new = np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
    starts = np.flatnonzero(new)
    out = rows[:, starts]
    out[3] = np.add.reduceat(rows[3], starts)
    return out


def _bucket_hits(threshold: float, common: int, share: float, crowd: int, never: int):
    """Pairs of sets that share a prefix n-gram, with how many they share in this partition.

    A n-gram of more than `crowd` sets gives no pairs but links of all of them to their
    smallest set, marked with `never` hits, so that work stays linear in the crowd.
    """

    def one(parts: list[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
        grams, ids, sizes = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        same = grams[1:] == grams[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        grams, order = grams[shared], order[shared]
        ids, sizes = ids[order], sizes[order]
        order = np.lexsort((ids, sizes, grams))
        grams, ids, sizes = grams[order], ids[order], sizes[order]
        if not len(grams):
            return
        fresh = np.concatenate([[True], (grams[1:] != grams[:-1]) | (ids[1:] != ids[:-1])])
        grams, ids, sizes = grams[fresh], ids[fresh], sizes[fresh].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        counts = np.diff(np.append(starts, len(grams)))
        run = np.repeat(np.arange(len(starts)), counts)
        big = counts > crowd
        if big.any():
            leader = np.minimum.reduceat(ids, starts)
            inside = big[run]
            links = _count_pairs([np.stack([leader[run[inside]], ids[inside], sizes[inside], np.full(inside.sum(), -never)])])
            links[3] = -never  # once, however many such n-grams: a sum could leave 32 bits
            yield links
        alive = np.flatnonzero(~big[run])
        held: list[np.ndarray] = []
        waiting = 0
        step = 1
        while len(alive):
            alive = alive[alive + step < len(grams)]
            alive = alive[(run[alive] == run[alive + step]) & (sizes[alive] >= threshold * sizes[alive + step] - 1e-9)]
            if len(alive):
                x, y = alive, alive + step
                swap = ids[x] > ids[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                least, most = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
                need = np.minimum(asked(least, common, share), np.ceil(threshold * most - 1e-9).astype(np.int64))
                held.append(np.stack([ids[x], ids[y], need, np.ones(len(x), np.int64)]))
                waiting += len(x)
                if waiting > 1_500_000:
                    held = [_count_pairs(held)]
                    waiting = held[0].shape[1]
                    if waiting > 1_000_000:
                        yield held.pop()
                        waiting = 0
            step += 1
        if held:
            yield _count_pairs(held)

    def run(batches):
        by: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                by.setdefault(row["bucket"], []).append((np.frombuffer(row["grams"], np.uint32), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int32)))
        for bucket in sorted(by):
            for rows in one(by.pop(bucket)):
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])] + [pa.array(r.astype(np.int32)) for r in rows[2:]], schema=_HITS)

    return run


def bitmap(grams: np.ndarray, bits: int) -> np.ndarray:
    """Hashed bitmap signature: one bit per n-gram, as 64-bit words; bits is a power of two."""
    out = np.zeros(bits, dtype=bool)
    out[(grams >> np.uint64(64 - int(math.log2(bits)))).astype(np.int64)] = True
    return np.packbits(out).view(np.uint64)


def signature_bits(size: int) -> int:
    """Four bits for each n-gram of the largest set in the size band, between 256 and 65,536."""
    return min(1 << 16, max(256, 4 << max(0, int(size) - 1).bit_length()))


_SEAT = ("tile", "band", "low", "high", "set_id")


def _array_rows(n: int):
    """Texts of seated sets become sorted arrays; the columns of their seats stay.

    A task gives each seat one array, however many rows of the document it holds.
    """

    def run(batches):
        seen: set[tuple[int, ...]] = set()
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                grams, bounds, ids = gram_sets(part.column("text"), n)
                # a doc_id may have other texts, too
                mine = ids == part.column("set_id").to_numpy()
                for k, seat in enumerate(zip(*(part.column(c).to_pylist() for c in _SEAT))):
                    if mine[k]:
                        mine[k] = seat not in seen
                        seen.add(seat)
                blobs = pa.array([grams[lo:hi].tobytes() if keep else None for lo, hi, keep in zip(bounds[:-1], bounds[1:], mine)], pa.binary())
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], blobs], [*kept, "grams"]).filter(pa.array(mine))

    return run


def _common_before(earlier: list, m: int) -> np.ndarray | None:
    """Bits of the earlier tiles of each of m sets, of those tiles that several have; None if there are none."""
    owner = np.repeat(np.arange(m), [len(x) for x in earlier])
    if not len(owner):
        return None
    tiles, place, count = np.unique(np.concatenate([np.asarray(x, np.int64) for x in earlier]), return_inverse=True, return_counts=True)
    wide = count > 1
    if not wide.any():
        return None
    column = np.cumsum(wide) - 1
    mine = wide[place]
    bits = np.zeros((m, -(-int(wide.sum()) // 64) * 64), dtype=bool)
    bits[owner[mine], column[place[mine]]] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def cell_links(ids: np.ndarray, sets: list[np.ndarray], visitor: np.ndarray, block: np.ndarray, across: bool, earlier: list, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, places of similar sets, overlaps): each similar pair of a cell once, in the order of size.

    Visitors, from the next size band, meet only sets that aren't; across: only sets of
    two blocks meet.  earlier: tiles before this one in which a set is seated, too; a pair
    with one in common counts there.
    """
    m = len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    order = np.lexsort((ids, sizes))
    sizes, visitor, block = sizes[order], visitor[order], block[order]
    flat = np.concatenate([sets[k] for k in order])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    # all arrays of the cell are merged once; an intersection is then a look at marked places
    distinct, local = np.unique(flat, return_inverse=True)
    marked = np.zeros(len(distinct), dtype=bool)
    bits = signature_bits(int(sizes[-1]))
    signs = np.zeros((m, bits), dtype=bool)
    signs[np.repeat(np.arange(m), sizes), (flat >> np.uint64(64 - int(math.log2(bits)))).astype(np.int64)] = True
    signs = np.packbits(signs, axis=1).view(np.uint64)
    ones = np.bitwise_count(signs).sum(axis=1, dtype=np.int64)
    before = _common_before([earlier[k] for k in order], m)
    last = np.searchsorted(sizes, sizes / threshold + 1e-9, side="right")
    for i in range(m - 1):
        lo, hi = i + 1, int(last[i])
        if lo >= hi:
            continue
        wanted = np.ones(hi - lo, dtype=bool)
        if visitor[i]:
            wanted &= ~visitor[lo:hi]
        if across:
            wanted &= block[lo:hi] != block[i]
        if before is not None and before[i].any():
            wanted &= ~(before[lo:hi] & before[i]).any(axis=1)
        if not wanted.any():
            continue
        # of the ones that a signature has alone each stands for an n-gram that the other set lacks, at least
        both = np.bitwise_count(signs[lo:hi] & signs[i]).sum(axis=1, dtype=np.int64)
        bound = np.minimum(sizes[i] - ones[i], sizes[lo:hi] - ones[lo:hi]) + both
        need = threshold / (1 + threshold) * (sizes[i] + sizes[lo:hi])
        left = np.flatnonzero(wanted & (bound >= need - 1e-9)) + lo
        if not len(left):
            continue
        mine = local[bounds[i] : bounds[i + 1]]
        marked[mine] = True
        if 2 * len(left) > hi - lo:
            found = np.add.reduceat(marked[local[bounds[lo] : bounds[hi]]].view(np.uint8), bounds[lo:hi] - bounds[lo], dtype=np.int64)[left - lo]
        else:
            long = sizes[left]
            starts = np.cumsum(long) - long
            found = np.add.reduceat(marked[local[np.repeat(bounds[left] - starts, long) + np.arange(int(long.sum()))]].view(np.uint8), starts, dtype=np.int64)
        marked[mine] = False
        near = found >= threshold * (sizes[i] + sizes[left] - found) - 1e-9
        if near.any():
            yield int(order[i]), order[left[near]], found[near]


_LINKS_SQL = "set_id long, first long, links long, root long"
_LINKS = pa.schema([("set_id", pa.int64()), ("first", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
_PAIRS_SQL = "doc_a long, doc_b long, overlap int, jaccard double"
_PAIRS = pa.schema([("doc_a", pa.int64()), ("doc_b", pa.int64()), ("overlap", pa.int32()), ("jaccard", pa.float64())])


def _cell(table: pa.Table, threshold: float) -> tuple[pa.Table, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """The cell's sets, each once, and their similar pairs."""
    table = table.take(np.unique(table.column("set_id").to_numpy(), return_index=True)[1])
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")]
    ids, block = table.column("set_id").to_numpy(), table.column("mine").to_numpy()
    across = bool(table.column("low")[0].as_py() != table.column("high")[0].as_py())
    visitor = table.column("visitor").to_numpy().astype(bool)
    return table, cell_links(ids, sets, visitor, block, across, table.column("earlier").to_pylist(), threshold)


def _count_links(threshold: float):
    """One row per set with a link: the copies of its partners, and the root of its part of the graph in this cell."""

    def run(table: pa.Table) -> pa.Table:
        table, found = _cell(table, threshold)
        ids, copies, first = (table.column(c).to_numpy() for c in ("set_id", "copies", "first"))
        links, part = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for i, others, _ in found:
            links[i] += copies[others].sum()
            links[others] += copies[i]
            joined = np.unique(np.append(part[others], part[i]))
            if len(joined) > 1:
                part[np.isin(part, joined)] = joined[0]
        some = np.flatnonzero(links)
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, part, first)
        return pa.Table.from_arrays([pa.array(ids[some]), pa.array(first[some]), pa.array(links[some]), pa.array(root[part[some]])], schema=_LINKS)

    return run


def _list_pairs(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table, found = _cell(table, threshold)
        first, sizes = table.column("first").to_numpy(), np.array([len(x.as_buffer()) // 8 for x in table.column("grams")])
        rows = [(min(first[i], first[j]), max(first[i], first[j]), n, n / (sizes[i] + sizes[j] - n)) for i, others, counts in found for j, n in zip(others, counts)]
        return pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _PAIRS)], schema=_PAIRS)

    return run


class Search:
    """The stored tables of one join: members, sets and cells."""

    def __init__(self, docs: DataFrame, threshold: float = 0.5, n: int = 3, common: int = 4, share: float = 0.04, crowd: int = 256, block: int = 1000, block_grams: int = 2_000_000) -> None:
        self.threshold, self.n, self.block, self.block_grams = threshold, n, block, block_grams
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
        partitions = max(shuffle_partitions(docs.sparkSession), min(partitions_for(docs, PARTITION_BYTES), MOST_PARTITIONS))
        # a few buckets for each partition even out what partitions hold, while that leaves rows of some length
        buckets = max(partitions, min(4 * partitions, 4096))
        gathered = written(self.docs.mapInArrow(_gather(n, buckets), _GATHERED_SQL), "grams")
        members = gathered.where(F.col("bucket") == MEMBERS).select("ids", "sizes", "docs").mapInArrow(_members, "doc_id long, set_id long, size int")
        #: doc_id, set_id, size: one row per document and set
        self.members = written(members.distinct(), "members")
        #: set_id, size, first, copies: sets with words, their smallest document and how many they have
        self.sets = written(self.members.where("size > 0").groupBy("set_id", "size").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "sets")

        shared = gathered.where(F.col("bucket") != MEMBERS).drop("docs").repartition(partitions, "bucket").mapInArrow(_shared, _SHARED_SQL)
        packed = shared.repartition(partitions, "batch").mapInArrow(_prefixes(threshold, common, share), _PACKED_SQL)
        hits = packed.repartition(partitions, "bucket").mapInArrow(_bucket_hits(threshold, common, share, crowd, NEVER), _HITS_SQL)
        hits = hits.groupBy("a", "b").agg(F.max("need").alias("need"), F.sum(F.col("hits").cast("long")).alias("hits"))
        self.hits = written(hits.where((F.col("hits") < 0) | (F.col("hits") >= F.col("need"))).select("a", "b"), "hits")
        discard(gathered)

    def cells(self) -> DataFrame:
        """Seats of sets with their arrays: tile, band, low, high name a cell.

        A tile is named by the smallest set of a candidate link, and then by the smallest tile in
        which that set itself is seated, so that the tiles of one group fall together.
        """
        seats = self.hits.select(F.col("a").alias("tile"), F.col("b").alias("set_id")).union(self.hits.select("a", "a").distinct())
        named = written(seats.groupBy("set_id").agg(F.min("tile").alias("least")), "tiles")
        seats = seats.join(small(named.select(F.col("set_id").alias("tile"), "least")), "tile").select(F.col("least").alias("tile"), "set_id").distinct()
        seats = seats.join(self.sets, "set_id")
        # a similar pair's sizes differ by the factor 1 / threshold at most, so its bands by one
        band = F.floor(F.log("size") / F.lit(math.log(1 / self.threshold * (1 + 1e-6)))).cast("int") if self.threshold < 1 else F.col("size")
        seats = written(seats.select("tile", "set_id", "first", "copies", "size", band.alias("band")), "seats")

        # the cells that have a set of their own band, and anything to compare
        each = seats.groupBy("tile", "band").agg(F.count(F.lit(1)).alias("own"), F.sum("size").alias("grams"))
        visits = each.select("tile", (F.col("band") - 1).alias("band"), F.col("own").alias("guests"), F.col("grams").alias("more"))
        cells = each.join(visits, ["tile", "band"], "left").fillna(0, ["guests", "more"]).where("own + guests > 1")
        blocks = F.ceil(F.greatest((F.col("own") + F.col("guests")) / self.block, (F.col("grams") + F.col("more")) / self.block_grams)).cast("int")
        cells = small(written(cells.select("tile", "band", blocks.alias("blocks")), "cells"))

        tiles = seats.groupBy("set_id").agg(F.sort_array(F.collect_set("tile")).alias("tiles"))
        several = small(written(tiles.where(F.size("tiles") > 1), "several"))
        seats = seats.join(several, "set_id", "left")
        earlier = F.coalesce(F.filter("tiles", lambda t: t < F.col("tile")), F.array().cast("array<long>"))
        seats = seats.withColumn("earlier", earlier).drop("tiles").withColumn("visitor", F.explode(F.array(F.lit(0), F.lit(1))))
        seats = seats.withColumn("band", F.col("band") - F.col("visitor")).join(cells, ["tile", "band"])
        # cells of more than `block` sets become blocks that meet two at a time
        seats = seats.withColumn("mine", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        seats = seats.select("tile", "band", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "visitor", "set_id", "first", "copies", "earlier")
        seats = written(seats, "seated")

        # one text of each seated set brings the array: texts of all others are left out before their n-grams are made
        rows = self.docs.join(small(seats.withColumnRenamed("first", "doc_id")), "doc_id").withColumnRenamed("doc_id", "first")
        kinds = ", ".join(f"{name} {kind}" for name, kind in rows.drop("text").dtypes)
        arrays = rows.mapInArrow(_array_rows(self.n), f"{kinds}, grams binary")
        return arrays

    def per_cell(self, function, sql: str) -> DataFrame:
        return self.cells().groupBy("tile", "band", "low", "high").applyInArrow(function(self.threshold), sql)

    def classes(self) -> DataFrame:
        """(doc_id, class_id, links) of every document; see classes()."""
        found = written(self.per_cell(_count_links, _LINKS_SQL), "links")
        several = written(self.members.where("size > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several")
        edges = found.select(F.col("first").alias("u"), F.col("root").alias("v"))
        repeated = not several.isEmpty()
        if repeated:  # all texts of a doc_id belong to its class
            firsts = self.members.join(small(several), "doc_id").join(self.sets.select("set_id", "first"), "set_id").select("doc_id", "first")
            edges = edges.union(firsts.join(firsts.groupBy("doc_id").agg(F.min("first").alias("least")), "doc_id").select("first", "least"))
        parts = components(edges)
        # only sets that have something to tell meet their members: the others' documents are alone
        total = found.groupBy("set_id").agg(F.sum("links").alias("links"))
        told = self.sets.join(total, "set_id", "left").join(parts.withColumnRenamed("node", "first"), "first", "left").where("copies > 1 or links > 0 or part is not null")
        told = told.select("set_id", F.coalesce("part", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
        # a hot set's members are one key of this join, which adaptive execution splits; told itself has a row per set
        rows = self.members.join(small(written(told, "told")), "set_id", "left")
        rows = rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
        blank = not self.members.where("size = 0").isEmpty()
        if repeated or blank:  # a doc_id may have several rows, one without words among them
            rows = rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
        return rows


def components(edges: DataFrame) -> DataFrame:
    """(node, part) of the nodes of edges (u, v), equal ones ignored: part is the smallest node that can be reached.

    Large-star and small-star steps alternate until the edges stop changing; each round is
    written to the shared folder and the one before deleted.
    """
    edges = edges.toDF("u", "v").where("u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        # the fold of a sum of hashes changes whenever the set of edges does
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now.n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("part")).union(edges.select("v", "v").distinct())
        before, last = now, edges
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m"))
        edges = written(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(last)


def classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, links): one row per document.

    Documents are linked whose n-gram sets reach the Jaccard threshold (option threshold,
    0.5; n, 3 words).  links: how many other documents a document is linked to, copies and
    near copies alike; class_id: the smallest doc_id that links lead to, its own where
    there is none.

    docs needs doc_id and text; further columns are ignored, whatever their names.  Texts
    without words, null, empty or of symbols only, are linked to nothing; a text of fewer
    than n words is one n-gram.  Very long texts are whole sets like any other.  Rows
    without doc_id are left out; repeated rows of one doc_id with equal text count once;
    with different texts they share a class, and their links add up.  Ties don't arise, as
    a pair is linked or not.  An empty table gives no rows.  The options common, share,
    crowd, block and block_grams steer the work only, never the result.
    """
    return Search(docs, **options).classes()


def similar_pairs(docs: DataFrame, **options) -> DataFrame:
    """(doc_a, doc_b, overlap, jaccard): all similar pairs of different n-gram sets, each set by its smallest doc_id.

    Copies aren't listed; otherwise like classes().
    """
    pairs = Search(docs, **options).per_cell(_list_pairs, _PAIRS_SQL)
    return pairs.where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.max("overlap").alias("overlap"), F.max("jaccard").alias("jaccard"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the smallest doc_id of each class of similar texts; columns and order of columns stay.

    Rows without doc_id, and rows whose text has no words, are kept.  Of repeated rows
    with one doc_id all are kept or all dropped.  Otherwise like classes().
    """
    dropped = written(classes(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("__dropped")), "dropped")
    return docs.join(small(dropped), docs["doc_id"].cast("long") == dropped["__dropped"], "left_anti")
