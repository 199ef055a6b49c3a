"""The vectorised twins of the column expressions: equal results, character by character."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polyglint.functions import text as T
from polyglint.functions import vector as V
from polyglint.operators import model as M
from polyglint.operators.detect import stops
from polyglint.operators.lookup import Lookup, Reader, Sparse

ODD = ["", " ", "abc", "A ,!", "\r\t\n", "ΑΣ İ", "カタカナ ひらがな 한국", "«a»…b c", None, "x" * 300, "Ä-ß 🙂𐐀z", " lead  and trail  ", "a b c", "1234", "the quick brown fox " * 40]


def test_every_character_folds_alike(spark):
    """All of the basic plane, and some beyond it, by the engine and by the table."""
    codes = [c for c in [*range(1 << 16), *range(0x10400, 0x10450), 0x1F642] if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, chr(c)) for c in codes], "c int, t string")
    want = {r.c: r.n for r in rows.select("c", T.normalize(F.col("t")).alias("n")).collect()}
    folded = V.fold(np.array(codes, np.uint32))
    differing = [hex(c) for c, f in zip(codes, folded.tolist()) if want[c] != (" " if f == 32 else f" {chr(f)} ")]
    # letters that one of the two runtimes' Unicode tables doesn't know yet
    assert len(differing) < 20, differing[:40]


def test_normalized_equals_the_expression(spark):
    want = [r.n for r in spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, t string").orderBy("k").select(T.normalize(F.col("t")).alias("n")).collect()]
    chars, offsets = V.normalized(pa.array(ODD))
    got = [chars[a:b].tobytes().decode("utf-32-le") for a, b in zip(offsets, offsets[1:])]
    assert got == [w or "" for w in want]


@pytest.mark.parametrize("n", [1, 3, 4])
def test_window_counts(n):
    texts = pa.array([t for t in ODD if t is not None])
    chars, offsets = V.normalized(texts)
    want = Counter()
    for a, b in zip(offsets, offsets[1:]):
        norm = chars[a:b].tobytes().decode("utf-32-le")
        want.update(norm[k : k + n] for k in range(len(norm)))
    windows, counts = V.window_counts(texts, n)
    assert len(set(windows)) == len(windows) and dict(zip(windows, counts.tolist())) == want
    assert V.window_counts(pa.array([], pa.string()), n)[0] == [] and V.window_counts(pa.array([None], pa.string()), n)[0] == []


def test_more_characters_than_a_key_holds():
    texts = pa.array(["".join(chr(c) for c in range(0x4E00 + k, 0x4E00 + 20_000, 4)) + "".join(chr(c) for c in range(0x20000 + k, 0x2A000, 2)) for k in range(2)] + ["ab"] * 3)
    windows, counts = V.window_counts(texts, 4)
    merged = Counter()
    for w, c in zip(windows, counts.tolist()):
        merged[w] += c
    assert merged[" ab "] == 3 and sum(merged.values()) == sum(len(t.as_py()) + 2 for t in texts)


def plain_sums(table: dict[str, list[float]], norm: str, n: int) -> tuple[int, np.ndarray]:
    total, count = np.zeros(2), 0
    for at in range(len(norm)):
        for k in range(1, min(n, len(norm) - at) + 1):
            count += 1
            total += np.array(table.get(norm[at : at + k], [0.0, 0.0]))
    return count, total


def test_lookup_sums_equal_a_plain_loop():
    rng = random.Random(1)
    letters = "ab cdeé漢🙂"
    table = {"".join(rng.choices(letters, k=rng.randint(1, 4))): [rng.random(), rng.random()] for _ in range(400)}
    look = Lookup(list(table), np.array(list(table.values())), 4)
    assert (look.find(look.keys) == np.arange(len(table))).all() and look.find(np.array([0, 1 << 63], np.uint64)).tolist() == [-1, -1]
    texts = ["".join(rng.choices(letters + "xyz?", k=rng.randint(0, 60))) for _ in range(200)] + [None, ""]
    chars, offsets = V.normalized(pa.array(texts))
    for chunk in (1 << 18, 1):
        count, sums = look.along_prefixes().sums(pa.array(texts), chunk=chunk)
        for k in range(len(texts)):
            want = plain_sums(table, chars[offsets[k] : offsets[k + 1]].tobytes().decode("utf-32-le"), 4)
            assert count[k] == want[0] and np.allclose(sums[k], want[1])
    row, column = np.nonzero(np.array(list(table.values())))
    sparse = Lookup(list(table), Sparse(row, column, np.array(list(table.values()))[row, column], len(table), 2), 4).along_prefixes()
    assert all(np.allclose(a, b) for a, b in zip(sparse.sums(pa.array(texts)), look.along_prefixes().sums(pa.array(texts))))
    none = Lookup([], Sparse(np.zeros(0), np.zeros(0), np.zeros(0), 0, 3), 4).along_prefixes()
    assert none.sums(pa.array(["abc", None]))[1].tolist() == [[0.0] * 3] * 2
    empty = Lookup([], np.zeros((0, 2)), 4)
    assert empty.along_prefixes().sums(pa.array(["abc"]))[1].tolist() == [[0.0, 0.0]]


def test_reader_reads_as_a_plain_loop_does():
    rng = random.Random(3)
    words = {"en": ["the", "fox", "and"], "de": ["der", "fuchs", "und"]}
    table = {}
    for k, lang in enumerate(words):
        for w in words[lang]:
            for a in range(len(w) + 2):
                for b in range(1, 5):
                    if g := f" {w} "[a : a + b]:
                        table.setdefault(g, [0.0, 0.0])[k] += 0.05
    matrix = np.array(list(table.values()))
    row, column = np.nonzero(matrix)
    reader = Reader(Lookup(list(table), matrix, 4), -0.1, 7, 0.99)
    sparse = Reader(Lookup(list(table), Sparse(row, column, matrix[row, column], len(table), 2), 4), -0.1, 7, 0.99)
    for trial in range(120):
        text = "".join(rng.choice([*words["en"], *words["de"], "\n\n ", "zz", "  "]) + rng.choice([" ", ""]) for _ in range(rng.choice([0, 3, 40, 900])))
        chars, _ = V.normalized(pa.array([text]))
        norm, known, sums, leader, stopped = chars.tobytes().decode("utf-32-le"), 0, np.zeros(2), -1, False
        for at in range(len(norm)):
            for k in range(1, min(4, len(norm) - at) + 1):
                gain = table.get(norm[at : at + k])
                if gain is None or stopped:
                    continue
                known, sums = known + 1, sums + np.array(gain)
                if known % 7 == 0:
                    w = np.exp(sums - sums.max())
                    now = int(w.argmax()) if w.max() > 0.99 * w.sum() else -1
                    stopped, leader = now >= 0 and now == leader, now
        for each in (reader, sparse):
            found = each.read(text)
            assert (found[0], found[3]) == (known, stopped) and np.allclose(found[1], sums)
        cut = rng.randrange(len(text) + 1)
        assert reader.read(None, reader.read(text))[:1] == reader.read(text)[:1] and reader.read(text[cut:], reader.read(text[:cut]))[0] >= 0
    assert reader.read(None)[0] == 0


def test_clipped_windows_equal_the_column_expressions(spark):
    """Of the hashed mode, counted batch by batch: the same as a row per occurrence, without such rows."""
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))
    texts = ["", " ", "a", "ab", "abc", "abc  ", "abcd e", "A ,!", None, "\U0001f600 x\U0001f600", wide, "the fox " * 50]
    docs = spark.createDataFrame([(lang, t) for lang in ("en", None) for t in texts], "lang string, text string").repartition(3)
    for n in (1, 3, 6):
        found = M.hashed_counts(docs, n=n)
        want = T.clipped(docs, "text", ["lang"], n).select("lang", T.joaat(F.col("ngram")).alias("ngram")).groupBy("lang", "ngram").agg(F.count(F.lit(1)).alias("n"))
        assert found.schema.simpleString() == want.schema.simpleString() and sorted(found.collect(), key=str) == sorted(want.collect(), key=str)
        assert "regexp_extract_all" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_tally_gives_all_counts_in_few_rows():
    tally = V.Tally(["w"], 10)
    parts = [pa.table({"w": pa.array([f"{(k + x) % 30}" if k % 2 else "x" for x in range(8)]), "n": pa.array([1] * 8, pa.int64())}) for k in range(40)]
    given = [r for p in parts for b in tally.add(p) for r in b.to_pylist()]
    kept = [r for b in tally.rest() for r in b.to_pylist()]
    assert len(given) + len(kept) < 320 and len(kept) <= 20 and not list(tally.rest())
    sums = {}
    for r in given + kept:
        sums[r["w"]] = sums.get(r["w"], 0) + r["n"]
    assert sums["x"] == 160 and sum(sums.values()) == 320


def test_early_stop_reads_a_batch_in_pieces():
    reader = Reader(Lookup(["a", "b"], np.array([[1.0, 0.0], [0.0, 1.0]]), 4), -7.0, 110, 0.99)
    texts = ["ab " * 40_000] * 30 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["key", "t"])
    found = list(stops(iter([batch]), reader))
    assert len(found) > 3 and [k for b in found for k in b.column("key").to_pylist()] == list(range(len(texts)))
    assert [s for b in found for s in b.column("scores").to_pylist()] == [reader.scores(reader.read(t)).tolist() for t in texts]


@pytest.mark.parametrize("clipped", [False, True])
def test_training_holds_little_beside_a_batch(clipped):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    V.fold_table()
    tracemalloc.start()
    try:
        total = sum(sum(b.column("n").to_pylist()) for b in M._window_rows(4, clipped)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # a window per character: with a blank in front, and one behind or three clipped at the tail
    assert total == sum(len(t) + 2 - 3 * clipped for t in texts) and batch.nbytes > 8 << 20 and most < 128 << 20


@pytest.mark.parametrize("clipped", [False, True])
def test_more_text_of_the_same_words_trains_on_no_more_rows(clipped):
    """What a task of training gives out grows with its words, not with its text."""
    words = [a + b for a in "abcdefgh" for b in "ijklmnop"]
    texts = [" ".join(random.Random(k).choices(words, k=2000)) for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 50), pa.array(texts)], ["lang", "text"])
    once, often = (list(M._window_rows(4, clipped)(iter([batch] * times))) for times in (1, 8))
    assert batch.nbytes > M.TRAIN_BYTES and sum(b.num_rows for b in often) == sum(b.num_rows for b in once)
    assert sum(sum(b.column("n").to_pylist()) for b in often) == 8 * sum(sum(b.column("n").to_pylist()) for b in once)


def test_texts_are_looked_up_in_small_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab " * 1000] * 1400)], ["t"])
    parts = list(V.pieces(batch, "t"))
    assert sum(p.num_rows for p in parts) == 1400 and max(p.num_rows for p in parts) * 3000 <= 1 << 18
