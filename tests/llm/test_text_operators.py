"""Near copies, decontamination, language ID, quality rules, secrets, ordinal classifier: brute force and edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from polyglint.llm import decontaminate, jaccard, language_id, ordinal, quality_rules, secrets, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, failed string, found string"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 8))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def table(spark, rows: list[tuple]):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, la, s, len(t) if t is not None else None, "x", "y", "z") for i, t, la, s in rows], SCHEMA)


def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, symbols only, one very long text."""
    long = prose(60_000, 1)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n ", None, "a"), (4, "!!! ###", "en", None), (None, "alpha beta gamma delta", "en", "a"), (5, prose(30, 2), "en", "a"), (5, prose(30, 2), "en", "a"), (6, long, "fr", "b"), (7, "Ünïcode ẞ 漢字 🙂 text", "de", "b"), (8, "one", "en", "a"), (9, "one", "en", "a")]
    return table(spark, rows)


def shingles(text: str | None, n: int = 3) -> frozenset:
    words = re.findall(tokens.WORD_PATTERN, (text or "").lower())
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def similar_by_force(rows: list[tuple[int, str]], threshold: float = 0.5) -> dict[tuple[int, int], float]:
    sets: dict[frozenset, list[int]] = {}
    for i, t in sorted(set(rows)):
        if s := shingles(t):
            sets.setdefault(s, []).append(i)
    out = {}
    keys = list(sets)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            score = len(a & b) / len(a | b)
            if score >= threshold:
                out[tuple(sorted((sets[a][0], sets[b][0])))] = score
        for i in sets[a][1:]:
            out[sets[a][0], i] = 1.0
    return out


def near_copies() -> list[tuple[int, str]]:
    """Copies with edits of every strength, exact ones, and a crowd that shares one passage."""
    rng = random.Random(9)
    rows, shared = [], prose(25, 77)
    for k in range(60):
        base = prose(rng.randint(5, 120), 100 + k).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 4)):
            copy = [w if rng.random() > 0.08 else rng.choice(VOCABULARY) for w in base]
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, shared) for k in range(40)]
    rows += [(len(rows) + k, f"{shared} {prose(12 + k % 20, 900 + k)}") for k in range(80)]
    return rows


OPTIONS = [{}, {"crowd": 8, "block": 10}, {"crowd": 3, "block": 4, "block_grams": 500}]


@pytest.mark.parametrize("options", OPTIONS)
def test_similar_pairs_equal_brute_force(spark, options):
    rows = near_copies()
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    found = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.similar_pairs(docs, **options).collect()}
    want = {k: v for k, v in similar_by_force(rows).items() if v < 1}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def classes_by_force(rows: list[tuple[int, str | None]], threshold: float = 0.5) -> dict[int, tuple[int, int]]:
    """doc_id -> (class, links), by comparing every two documents."""
    sets = [(i, shingles(t)) for i, t in sorted(set(rows), key=str)]
    parent, links = {i: i for i, _ in rows}, dict.fromkeys([i for i, _ in rows], 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (root(i), n) for i, n in links.items()}


@pytest.mark.parametrize("options", [*OPTIONS, {"threshold": 0.8}, {"threshold": 0.3, "crowd": 8, "block": 10}])
def test_classes_equal_brute_force(spark, options):
    rows = near_copies()
    rows += [(len(rows) + k, rows[3 * k][1]) for k in range(30)]
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    found = [(r.doc_id, (r.class_id, r.links)) for r in jaccard.classes(docs, **options).collect()]
    assert len(found) == len(rows) and dict(found) == classes_by_force(rows, options.get("threshold", 0.5))


@pytest.mark.parametrize("sizes", [(4, 8), (8, 16), (16, 32), (3, 6), (100, 200), (1, 2)])
def test_sizes_at_the_edge_of_a_band_meet(spark, sizes):
    words = [f"w{k}" for k in range(max(sizes) + 2)]
    rows = [(k, " ".join(words[: n + 2])) for k, n in enumerate(sizes)]
    assert {r.links for r in jaccard.classes(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()} == {1}


def test_classes_of_odd_rows(spark):
    rows = [(1, prose(30, 1)), (1, prose(30, 1)), (2, prose(30, 1)), (2, prose(30, 7)), (3, prose(30, 7)), (4, prose(30, 8)), (4, None), (5, prose(30, 9)), (5, "")]
    docs = odd(spark).unionByName(table(spark, [(100 + i, t, "en", "a") for i, t in rows]))
    found = sorted((r.doc_id, r.class_id, r.links) for r in jaccard.classes(docs).collect())
    assert found == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 1), (9, 8, 1), (101, 101, 1), (102, 101, 2), (103, 101, 1), (104, 104, 0), (105, 105, 0)]
    kept = jaccard.drop_near_copies(odd(spark))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 2 3 4 None 5 5 6 7 8".split())
    for f in (jaccard.classes, jaccard.similar_pairs, jaccard.drop_near_copies):
        assert f(docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000 + k, 1000) for k in range(200)] + [(7000, 7000)]
    found = {r.node: r.part for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in range(301)}, **{1000 + k: 1000 for k in range(200)}}


def test_one_of_each_group_stays(spark):
    rows = near_copies()
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in similar_by_force(rows):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r.doc_id for r in jaccard.drop_near_copies(docs).collect()} == {root(i) for i, _ in rows}


def test_links_of_many_crowded_ngrams_stay_negative():
    grams, ids = np.repeat(np.arange(2200, dtype=np.uint32), 4), np.tile(np.arange(4, dtype=np.int64), 2200)
    packed = pa.RecordBatch.from_pydict({"bucket": [0], "grams": [grams.tobytes()], "ids": [ids.tobytes()], "sizes": [np.full(len(ids), 3000, np.int32).tobytes()]}, schema=jaccard._PACKED)
    found = pa.Table.from_batches(jaccard._bucket_hits(0.5, 4, 0.04, 3, 1_000_000)([packed])).to_pylist()
    assert sorted((r["a"], r["b"]) for r in found) == [(0, 0), (0, 1), (0, 2), (0, 3)] and all(r["hits"] < 0 for r in found)


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([b, a[: len(a) // 2]]))
        x, y = jaccard.bitmap(a, 256), jaccard.bitmap(b, 256)
        bound = min(len(a) - int(np.bitwise_count(x & ~y).sum()), len(b) - int(np.bitwise_count(y & ~x).sum()))
        assert bound >= len(np.intersect1d(a, b))


def best_passage(item: list[str], text: list[str]) -> int:
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_recall_against_brute_force(spark):
    rng = random.Random(4)
    items = [(k, prose(rng.randint(8, 60), 500 + k)) for k in range(40)] + [(40, None), (41, ""), (42, "too short")]
    rows = []
    for k in range(160):
        words = prose(rng.randint(0, 300), 2000 + k).split()
        item = items[k % 40][1].split()
        for _ in range(rng.randint(0, int(0.3 * len(item)))):
            at = rng.randrange(len(item))
            kind = rng.randrange(3)
            item[at : at + 1] = [] if kind == 0 else [rng.choice(VOCABULARY)] if kind == 1 else [item[at], rng.choice(VOCABULARY)]
        at = rng.randint(0, len(words))
        rows.append((k, " ".join(words[:at] + ([w.upper() for w in item] if k % 4 else []) + words[at:]), "en", "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(table(spark, rows), bench).collect()}
    want = {}
    for i, t, *_ in rows:
        for item, x in items[:40]:
            words = x.split()
            if (d := best_passage(words, t.lower().split())) <= decontaminate.allowed(len(words), 0.2):
                want[i, item] = d
    assert found.keys() <= want.keys() and len(found) >= 0.95 * len(want) > 50
    for (i, item), r in found.items():
        assert r.distance == want[i, item]
        passage = rows[i][1].lower().split()[r.start_word : r.end_word]
        assert best_passage(dict(items)[item].split(), passage) == r.distance


def test_short_items_are_found_by_exact_copies(spark):
    items = [(1, "what is the tallest mountain"), (2, "one two three four"), (3, "Is it, or is it NOT so?"), (4, "Is it, or is it NOT so?"), (5, prose(9, 800)), (6, prose(30, 801))]
    rows = [(10, "Well: what is the TALLEST mountain? Who knows.", "en", "a"), (11, "what is the tallest of the mountains", "en", "a"), (12, "one two three four", "en", "a"), (13, "is it or is it not so", "en", "a"), (14, "so is it or is it not", "en", "a"), (15, prose(9, 800), "en", "a"), (16, f"x {prose(30, 801)} y", "en", "a"), (17, "what is the tallest", "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "9 AS doc_id", "'z' AS distance")
    found = {(r.doc_id, r.item_id, r.distance, r.start_word, r.end_word) for r in decontaminate.contaminated(table(spark, rows), bench).collect()}
    assert found == {(10, 1, 0, 1, 6), (13, 3, 0, 0, 7), (13, 4, 0, 0, 7), (15, 5, 0, 0, 9), (16, 6, 0, 1, 31)}
    strict = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, rows), bench, share=0.34, bits=1).collect()}
    assert strict >= {(15, 5), (16, 6), (10, 1)}
    parts = {(r.doc_id, r.item_id, r.distance, r.start_word, r.end_word) for r in decontaminate.contaminated(table(spark, rows), bench, most_bytes=60).collect()}
    assert parts == found
    with pytest.raises(ValueError, match="fewer bits"):
        decontaminate.Index([(1, np.arange(1, 60, dtype=np.uint64))], 0.3, 0.999999, 16, 1)


def test_decontamination_of_odd_rows(spark):
    docs = odd(spark)
    bench = spark.createDataFrame([(1, prose(30, 2)), (1, prose(30, 2)), (None, "x"), (2, None)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def labelled_languages() -> list[tuple]:
    rng = random.Random(8)
    endings = {"en": ["ing", "tion", "the", "ed"], "fr": ["eaux", "oir", "ment", "è"], "de": ["ung", "lich", "ß", "keit"]}
    rows = []
    for k in range(240):
        lang = list(endings)[k % 3]
        words = ["".join(rng.choices("bcdfglmnprst", k=2)) + rng.choice(endings[lang]) for _ in range(rng.randint(20, 200))]
        rows.append((k, " ".join(words), lang, "a"))
    return rows


def test_language_of_held_out_texts(spark):
    rows = labelled_languages()
    docs, rest = table(spark, rows[:120]), table(spark, rows[120:])
    found = language_id.identify(rest, docs).select("doc_id", "lang", "identified.*").collect()
    assert sum(r.language == r.lang for r in found) >= 0.98 * len(found)
    content = language_id.dictionaries(docs)[0]
    packers = language_id.Compressors(content, 5)
    for r in found[:20]:  # the judgement follows from the sizes
        sizes = packers.sizes(dict((i, t) for i, t, *_ in rows)[r.doc_id])
        assert r.size == sizes.min() and r.runner_up == sorted(sizes)[1]


def judged_by_force(text: str | None, content: dict[str, bytes]) -> str | None:
    """The language by zstandard alone: pieces of 8 KB, each with the raw dictionary."""
    solid = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
    if not solid:
        return None
    data, sizes = f" {solid} ".encode(), []
    for lang in sorted(content):
        options = {"dict_data": zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(content[lang]) >= 8 else {}
        coder = zstandard.ZstdCompressor(level=5, write_content_size=False, write_checksum=False, write_dict_id=False, **options)
        sizes.append((sum(len(coder.compress(data[a : a + 8192])) for a in range(0, len(data), 8192)), lang))
    sizes.sort()
    if len(sizes) > 1 and sizes[1][0] - sizes[0][0] < max(1, 0.01 * sizes[0][0]):
        return None
    return sizes[0][1] if sizes else None


def test_no_text_is_judged_by_itself(spark):
    rows = labelled_languages() + [(900, "zzkx qqvw " * 400, "en", "a"), (901, "12 ##", "en", "a"), (902, None, "fr", "a"), (903, " ".join(r[1] for r in labelled_languages()[:30:3]), "en", "a")]
    docs = table(spark, rows)
    content = language_id.dictionaries(docs, folds=2)
    fold = {t: xxhash.xxh64_intdigest(t.encode(), 42) & 1 for _, t, *_ in rows if t}
    assert len(content) == 2 and all(c.keys() == {"en", "fr", "de"} for c in content)
    for part in range(2):
        mine = " ".join(t for t in fold if fold[t] == part).lower()
        for joined in content[part].values():
            words = joined.decode().split()
            assert len(words) > 100 and all(w in mine for w in words)
    found = {r.doc_id: r.language for r in language_id.identify(docs).select("doc_id", "identified.language").collect()}
    assert found == {i: judged_by_force(t, content[1 - fold[t]] if t else {}) for i, t, *_ in rows}
    assert np.mean([found[i] == lang for i, _, lang, _ in rows[:240]]) > 0.98 and found[903] == "en"


def test_language_of_odd_rows(spark):
    labelled = table(spark, labelled_languages())
    found = language_id.identify(odd(spark), labelled).select("doc_id", "identified.language").collect()
    assert len(found) == 11 and all(r.language is None for r in found if r.doc_id in (1, 2, 3, 4))
    docs = odd(spark)
    kept = language_id.keep_identified(docs, labelled=labelled)
    assert kept.columns == docs.columns
    assert language_id.keep_identified(docs.limit(0)).count() == 0
    assert language_id.judge(np.array([10, 10]), ["a", "b"], 1, 0.01)[0] is None  # a tie is rejected


def test_features_equal_a_plain_count(spark):
    texts = ["", None, "Ab 12 ##\nAb\nAb", "é É x", prose(50, 3), "a\n\n\na\nb", "\n"]
    got = list(zip(*[x.tolist() for x in quality_rules.features(pa.array(texts))]))
    for text, row in zip(texts, got):
        t = text or ""
        solid = [c for c in t if c not in " \t\r\n"]
        share = lambda n: 1000 * n // (len(solid) + 30)
        lines = [x for x in t.split("\n") if x]
        words = max(1, len(t.split()))
        want = (share(sum(not (c.isascii() and c.isalnum()) and ord(c) < 128 for c in solid)), share(sum(c in "0123456789" for c in solid)), share(sum("A" <= c <= "Z" for c in solid)), 100 * len(solid) // words, 1000 * (len(lines) - len(set(lines))) // len(lines) if lines else 0)
        assert row == want


def test_quality_rules_adapt_to_their_group(spark):
    rows = [(k, prose(60, k), "en", "a") for k in range(80)] + [(100 + k, prose(60, k).replace(" ", " # ! "), "en", "code") for k in range(80)]
    rows += [(300, prose(60, 1).replace(" ", " ### !!! "), "en", "a")]
    kept = {r.doc_id for r in quality_rules.keep_good(table(spark, rows)).collect()}
    assert 300 not in kept and kept >= {r[0] for r in rows} - {300}


def test_adaptive_fences_equal_a_plain_recount(spark):
    rng = random.Random(12)
    rows = []
    for k in range(400):
        text = prose(rng.randint(40, 120), 3000 + k)
        if k % 25 == 0:
            text = text.replace(" ", "! ", 4) + " 12" * rng.randint(1, 6)
        if k % 40 == 1:
            text = text[: len(text) // 2] + "\n" + "same line\n" * rng.randint(2, 9)
        rows.append((k, text, "en" if k % 2 else "fr", "ab"[k % 3 == 0] if k < 380 else "rare"))
    rows += [(400, " ".join("a" * 60), "en", "a"), (401, prose(80, 1).upper(), "en", "a")]
    docs = table(spark, rows)
    features = dict(zip((r[0] for r in rows), zip(*[x.tolist() for x in quality_rules.features(pa.array([r[1] for r in rows]))])))
    want = {}
    for i, _, lang, source in rows:
        own = [k for k, _, la, s in rows if (la, s) == (lang, source)]
        tongue = [k for k, _, la, _ in rows if la == lang]
        group = own if len(own) >= 50 else tongue
        failed = []
        for j, name in enumerate(quality_rules.FEATURES):
            values = sorted(grid(features[k][j]) for k in group)
            at = lambda share: values[int(np.ceil(share * len(values) - 1e-9)) - 1]
            q1, q3, value = at(0.25), at(0.75), features[i][j]
            if q3 > q1:
                bad = value < q1 - 3 * (q3 - q1) or value > q3 + max(3 * (q3 - q1), q3)
            else:
                tail = max(q3, 3 * (at(0.95) - q3), at(0.99) - q3)
                bad = value > q3 + (tail or at(1.0) // 2)
            if bad:
                failed.append(name)
        want[i] = ",".join(failed)
    assert {r.doc_id: r.failed for r in quality_rules.judged(docs).collect()} == want
    assert "word_length" in want[400] and "capitals" in want[401]
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == {i for i, x in want.items() if not x}


def grid(value: int) -> int:
    step = 1
    while value // step >= 64:
        step *= 2
    return value // step * step


def test_grid_cells_are_bounded(spark):
    values = sorted({v + d for k in range(31) for v in (1 << k, 3 << max(0, k - 1)) for d in (-1, 0, 1) if 0 <= v + d < 1 << 31})
    found = spark.createDataFrame([(v,) for v in values], "v int").selectExpr("v", f"{quality_rules.cell('v')} AS c").collect()
    assert all(r.c == grid(r.v) and r.c <= r.v <= r.c + r.c / 32 for r in found)
    assert len({grid(v) for v in range(1 << 16)}) == 64 + 10 * 32


def test_quality_rules_of_odd_rows(spark):
    docs = odd(spark)
    assert quality_rules.judged(docs).count() == 11
    assert quality_rules.keep_good(docs.limit(0)).count() == 0
    long = quality_rules.judged(table(spark, [(1, "x" * 5_000_000, "en", "a"), (2, "y\n" * 500_000, "en", "a")])).orderBy("doc_id").collect()
    assert [r.word_length for r in long] == [500_000_000, 100] and long[1].repeated_lines == 999
    null = quality_rules.judged(docs).where("doc_id = 1").first()
    assert (null.symbols, null.digits, null.capitals, null.word_length, null.repeated_lines) == (0, 0, 0, 0, 0)


def plain_ratio(secret: list[str], ordinary: list[str]):
    """Log-likelihood ratio of two character models, counted pair by pair."""
    letters = secrets.ALPHABET

    def model(samples):
        seen = {}
        for x in samples:
            x = ["edge", *[c if c in letters else "edge" for c in x], "edge"]
            for a, b in zip(x, x[1:]):
                seen.setdefault(a, {}).setdefault(b, 0)
                seen[a][b] += 1
        states = [*letters, "edge"]
        return {a: {b: math.log((seen.get(a, {}).get(b, 0) + 0.5) / (sum(seen.get(a, {}).values()) + 0.5 * len(states))) for b in states} for a in states}

    one, two = model(secret), model(ordinary)

    def score(token):
        x = ["edge", *token, "edge"]
        return sum(one[a][b] - two[a][b] for a, b in zip(x, x[1:]))

    return score


def test_scan_equals_plain_models(spark):
    secret, ordinary = secrets.random_samples(600, seed=5), secrets.identifier_samples(VOCABULARY[:80], 900, seed=6)
    score = plain_ratio(secret, ordinary)
    models = secrets.Models(secret, ordinary)
    fresh = secrets.random_samples(300, seed=8) + secrets.identifier_samples(VOCABULARY, 300, seed=9)
    assert all(abs(models.score(t) - score(t)) < 1e-6 for t in fresh)
    rng = random.Random(1)
    tokens_ = [t for t in fresh if t.isalnum()]  # runs of one part: nothing within them is looked for
    rows = [(k, " ".join(rng.choice([rng.choice(tokens_), rng.choice(VOCABULARY), "!", "é"]) for _ in range(12)), "en", "a") for k in range(150)]
    want = {(k, m.start(), m.end()) for k, t, *_ in rows for m in re.finditer(r"[A-Za-z0-9]+", t) if len(m.group()) >= 16 and score(m.group()) >= max(12.0, 0.35 * len(m.group()))}
    found = {(r.doc_id, r.start, r.end) for r in secrets.scan(table(spark, rows), secret, ordinary).collect()}
    assert found == want and len(want) > 100


def test_secrets_on_held_out_samples():
    words = [w for w in VOCABULARY if len(w) > 2]
    models = secrets.Models(secrets.random_samples(), secrets.identifier_samples(words))
    fresh = [s for s in secrets.random_samples(700, seed=99) if len(s) >= 20]
    plain = [s for s in secrets.identifier_samples(words[:50], 500, seed=98) if len(s) >= 16]
    flagged = lambda x: bool(secrets.find(x, models, 12.0, 0.35))
    assert np.mean([flagged(x) for x in fresh]) >= 0.9 and np.mean([flagged(x) for x in plain]) <= 0.02


def test_secrets_within_long_paths():
    words = [w for w in VOCABULARY if len(w) > 2]
    models = secrets.Models(secrets.random_samples(), secrets.identifier_samples(words))
    find = lambda x: secrets.find(x, models, 12.0, 0.35)
    rng = random.Random(6)
    alone = missed = lost = 0
    for key in [s for s in secrets.random_samples(400, seed=97) if len(s) >= 20 and s.isalnum()]:
        if not find(key):
            continue
        alone += 1
        path = ["/".join(rng.choices(words, k=rng.randint(4, 12))) for _ in range(2)]
        text = f"{path[0]}{rng.choice('/=_-')}{key}/{path[1]}"
        missed += not any(text[a:b] in key or key in text[a:b] for a, b, _ in find(text))
        lost += len(find(f"{path[0]}/{key}/{path[1]}/{key}/{path[0]}")) < 1
    assert alone > 200 and missed == lost == 0
    long = secrets.identifier_samples(words[:50], 2000, seed=96)
    paths = ["/".join(rng.choices(long, k=6)) for _ in range(500)]
    paths = [p for p in paths if not re.search(r"[0-9]{10}", p)]
    assert len(paths) > 300 and np.mean([bool(find(p)) for p in paths]) <= 0.02


def test_best_stretch_equals_brute_force():
    models = secrets.Models(secrets.random_samples(), secrets.identifier_samples(VOCABULARY))
    rng = random.Random(7)
    seen = 0
    for _ in range(300):
        parts = [rng.choice(VOCABULARY) if rng.random() < 0.5 else "".join(rng.choices("0123456789abcdef", k=rng.randint(2, 24))) for _ in range(rng.randint(1, 9))]
        token = "".join(rng.choice(["/", "-", "_", "=", "//"]) + p for p in parts)
        spans = [m.span() for m in re.finditer("[A-Za-z0-9]+", token)]
        want = [models.score(token[a:b]) for i, (a, _) in enumerate(spans) for _, b in spans[i:] if b - a >= 16 and models.score(token[a:b]) >= max(12.0, 0.35 * (b - a))]
        found = secrets.stretches(token, models, 12.0, 0.35)
        assert bool(found) == bool(want) and all(abs(models.score(token[a:b]) - x) < 1e-9 for a, b, x in found)
        assert not want or abs(max(x for *_, x in found) - max(want)) < 1e-9
        seen += bool(want)
    assert seen > 50


def test_secret_positions_and_odd_rows(spark):
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    rows = [(1, f"é {key} and {key}", "en", "a"), (2, prose(40, 1), "en", "a"), (3, None, "en", "a"), (3, f"key={key}", None, None)]
    found = secrets.scan(table(spark, rows), ordinary=secrets.identifier_samples(VOCABULARY)).collect()
    assert sorted((r.doc_id, r.start) for r in found)[:2] == [(1, 2), (1, 47)] and {r.doc_id for r in found} == {1, 3}
    text = dict((i, t) for i, t, *_ in rows)
    assert all(text[r.doc_id][r.start : r.end] == r.secret and key in r.secret for r in found)
    assert secrets.scan(odd(spark)).count() == 0 and secrets.scan(odd(spark).limit(0)).count() == 0


def graded(n: int, seed: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    groups = [VOCABULARY[:60], VOCABULARY[60:120], VOCABULARY[120:]]
    docs, labels = [], []
    for k in range(n):
        g = rng.randrange(3)
        docs.append((k, " ".join(rng.choice(groups[g] if rng.random() < 0.4 else VOCABULARY) for _ in range(rng.randint(30, 200))), "en", "a"))
        labels.append((k, int(g == 2), int(g == 0)))
    return docs, labels


def test_ordinal_grades_held_out_texts(spark):
    docs, labels = graded(600, 1)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ratings = ordinal.ratings(labels)
    model = ordinal.train(table(spark, docs[:400]), ratings)
    assert (np.diff(model.thresholds) > 0).all()
    want = {r.doc_id: r.grade for r in ratings.collect()}
    found = ordinal.grade(table(spark, docs[400:]), model).collect()
    right = [round(r.expected_grade) == want[r.doc_id] for r in found]
    assert len(found) == 200 and np.mean(right) >= 0.8
    for r in found[:5]:  # the weights give the same by hand
        tails = model.tails(model.scores(*ordinal.hashed(pa.array([docs[r.doc_id][1]]))))[0]
        assert abs(tails.sum() - r.expected_grade) < 1e-4 and abs(tails[1] - r.tail) < 1e-4


def plain_features(text: str) -> list[float]:
    """Values of a text's features: words, and the first four bytes of what follows each, by frequency."""
    low = text.lower().encode()
    spans = [m.span() for m in re.finditer(rb"[a-z0-9\x80-\xff]+", low)]
    gaps = [low[b : min(b + 4, following)] for (_, b), following in zip(spans, [a for a, _ in spans[1:]] + [spans[-1][1]])] if spans else []
    seen = Counter([("word", low[a:b]) for a, b in spans] + [("gap", g.ljust(4, b"\0")) for g in gaps])
    return sorted(math.log1p(n) / len(spans) ** 0.25 for n in seen.values())


def test_features_of_graded_texts_by_hand():
    texts = ["one two, two!", "", None, "Ünï 12 -- x", prose(60, 4), "a b c"]
    places, values, bounds = ordinal.hashed(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(np.sort(values[bounds[k] : bounds[k + 1]]), plain_features(t) if t else [])
        assert len(set(places[bounds[k] : bounds[k + 1]].tolist())) == bounds[k + 1] - bounds[k]


def likelihood(weights, thresholds, rows, grades, ridge):
    """Penalised mean log-likelihood of the cumulative-link model, row by row."""
    total, cuts = 0.0, [-math.inf, *thresholds, math.inf]
    above = lambda score, cut: 1.0 if cut == -math.inf else 0.0 if cut == math.inf else 1 / (1 + math.exp(cut - score))
    for row, g in zip(rows, grades):
        score = sum(weights[p] * v for p, v in row)
        total += math.log(above(score, cuts[g]) - above(score, cuts[g + 1]))
    return total / len(rows) - ridge / 2 * sum(w * w for w in weights.values())


def test_the_fit_is_the_likeliest_model():
    rng = random.Random(2)
    rows, grades = [], []
    for _ in range(150):
        row = [(p, rng.random()) for p in rng.sample(range(12), rng.randint(1, 5))]
        rows.append(row)
        grades.append(min(3, max(0, int(1.5 + sum((p - 6) * v for p, v in row) / 3 + rng.gauss(0, 1)))))
    bounds = np.cumsum([0, *map(len, rows)])
    places, values = (np.array([x[k] for row in rows for x in row]) for k in (0, 1))
    ridge = 0.01
    model = ordinal.fit(places.astype(np.int32), values, bounds, np.array(grades), 4, ridge=ridge, rounds=3000, rate=0.02)
    weights, thresholds = {p: float(model.weights[p]) for p in range(12)}, model.thresholds.tolist()
    top = likelihood(weights, thresholds, rows, grades, ridge)
    for p in range(12):  # the slope is 0 in every direction, and it goes down on either side
        for d in (-0.05, 0.05):
            assert likelihood({**weights, p: weights[p] + d}, thresholds, rows, grades, ridge) < top + 1e-6
    for k in range(3):
        for d in (-0.05, 0.05):
            assert likelihood(weights, [t + d * (j == k) for j, t in enumerate(thresholds)], rows, grades, ridge) < top + 1e-6
    step = 1e-4
    slopes = [(likelihood({**weights, p: weights[p] + step}, thresholds, rows, grades, ridge) - likelihood({**weights, p: weights[p] - step}, thresholds, rows, grades, ridge)) / (2 * step) for p in range(12)]
    assert max(map(abs, slopes)) < 1e-3
    scores = model.scores(places.astype(np.int32), values, bounds)
    assert np.allclose(scores, [sum(weights[p] * v for p, v in row) for row in rows])
    assert np.allclose(model.tails(scores), [[1 / (1 + math.exp(t - s)) for t in thresholds] for s in scores])


def test_rated_documents_count_once(spark):
    docs, labels = graded(60, 3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = ordinal.train(table(spark, docs), ordinal.ratings(labels), rounds=20)
    twice = ordinal.train(table(spark, docs + docs[:30] * 3), ordinal.ratings(labels), rounds=20)
    assert np.allclose(once.weights, twice.weights) and np.allclose(once.thresholds, twice.thresholds)


def test_ordinal_of_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (6, 1, 0), (8, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = odd(spark)
    model = ordinal.train(docs, ordinal.ratings(labels))
    found = ordinal.grade(docs, model).collect()
    assert len(found) == 11 and {r.doc_id for r in found if r.tail is None} == {1, 2}
    assert ordinal.select(docs.limit(0), labels).count() == 0 and ordinal.select(docs, labels.limit(0)).count() == 0
