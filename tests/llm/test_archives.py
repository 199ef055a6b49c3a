"""Mixing, wavelet shards, archives, HTML consensus and the pipeline: brute force, round trips and edge cases."""

from __future__ import annotations

import base64
import hashlib
import html
import random
import re
import struct
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from polyglint.llm import html_consensus, mixing, registry, warc, wavelet
from tests.llm.test_text_operators import odd, prose, table


def mixed_by_force(rows, weights, share):
    served, timed = {}, []
    key = lambda r: (int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16), hashlib.md5((r[1] or "").encode()).hexdigest())
    for r in sorted(rows, key=key):
        served[r[3]] = served.get(r[3], 0) + len((r[1] or "").split())
        timed.append((served[r[3]] / weights.get(r[3], 1.0), *key(r), r))
    timed.sort(key=lambda x: x[:3])
    budget, spent, out = int(sum(len((r[1] or "").split()) for r in rows) * share), 0, []
    for t in timed:
        spent += len((t[3][1] or "").split())
        if spent > budget:
            break
        out.append((t[3][0], t[0]))
    return out


@pytest.mark.parametrize("share", [0.0, 0.37, 0.9, 1.0])
def test_mix_equals_plain_fair_queueing(spark, share):
    rng = random.Random(2)
    rows = [(k, prose(rng.randint(0, 60), k) if k % 9 else None, "en", rng.choice(["a", "b", "c", None])) for k in range(300)]
    weights = {"a": 3.0, "b": 0.25}
    found = mixing.mix(table(spark, rows), weights, budget_share=share, slices=5).collect()
    want = mixed_by_force(rows, weights, share)
    assert [r.doc_id for r in found] == [i for i, _ in want] or sorted((r.doc_id, r.virtual_finish) for r in found) == sorted(want)
    assert all(a.virtual_finish <= b.virtual_finish for a, b in zip(found, found[1:]))


def test_cut_narrows_in_bins(spark):
    rows = [(k, prose(k % 17, k), "en", "ab"[k % 2]) for k in range(200)]
    timed = mixing.mix(table(spark, rows), budget_share=1.0).select("doc_id", "tokens", "virtual_finish")
    timed = timed.withColumnsRenamed({"virtual_finish": "finish", "doc_id": "key"}).selectExpr("*", "cast(key as string) AS tie")
    every = sorted(timed.collect(), key=lambda r: (r.finish, r.key, r.tie))
    for budget in (0, 333, 10_000):
        spent, last = 0, None
        for r in every:
            spent += r.tokens
            if spent > budget:
                break
            last = (r.finish, r.key, r.tie)
        assert mixing._cut(timed, budget, bins=4, few=5) == last


def test_cut_among_many_documents_of_one_time(spark):
    rows = [(k, " " * (k % 7) if k % 10 else prose(3, k), "en", "ab"[k % 2]) for k in range(400)] + [(1, "", "en", "a")] * 50
    want = [i for i, _ in mixed_by_force(rows, {}, 0.5)]
    timed = mixing.mix(table(spark, rows), budget_share=1.0)
    assert timed.where("virtual_finish = 0").count() > 10
    found = timed.select(F.col("virtual_finish").alias("finish"), mixing.shuffle_key(F.col("doc_id")).alias("key"), F.md5("text").alias("tie"), "tokens")
    budget = int(timed.agg(F.sum("tokens")).first()[0] * 0.5)
    assert mixing._cut(found, budget, bins=4, few=5) == mixing._cut(found, budget)
    kept = [r.doc_id for r in mixing.mix(table(spark, rows), budget_share=0.5).collect()]
    assert sorted(kept) == sorted(want)


def test_mix_of_plain_files_and_of_other_plans(spark, tmp_path):
    rows = [(k, prose(k % 23, k), "en", "abc"[k % 3]) for k in range(200)]
    table(spark, rows).repartition(5).write.parquet(f"{tmp_path}/d")
    files = spark.read.parquet(f"{tmp_path}/d")
    assert mixing._is_scan(files) and mixing._is_scan(files.where("doc_id > 3").select("doc_id", "text", "source"))
    assert not mixing._is_scan(files.union(files)) and not mixing._is_scan(table(spark, rows)) and not mixing._is_scan(files.join(files, "doc_id"))
    want = [i for i, _ in mixed_by_force(rows, {"a": 2.0}, 0.6)]
    for docs in (files, files.union(files.limit(0)), table(spark, rows)):
        assert [r.doc_id for r in mixing.mix(docs, {"a": 2.0}, budget_share=0.6).collect()] == want


def test_word_counts_equal_split():
    texts = ["", " ", "a", " a", "a ", "a\tb\r\nc", None, "b", "\u00a0x y", "é è", "x" * 3_000_000 + " y"]
    assert mixing.word_counts(pa.array(texts)).tolist() == [len([w for w in re.split("[ \\t\\r\\n]+", t or "") if w]) for t in texts]

def test_mix_of_odd_rows(spark):
    docs = odd(spark)
    assert mixing.mix(docs, budget_share=1.0).count() == 11
    assert mixing.mixed_documents(docs, budget_share=1.0).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0.0})


def test_wavelet_answers_as_a_list_does():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 37, n).astype(np.uint16)
        matrix = wavelet.decode(wavelet.encode(ids, 6, [5, None], np.array([0, n // 2, n]), chunk_bits=64))
        assert matrix.doc_ids.tolist() == [5, None] and matrix.starts.tolist() == [0, n // 2, n]
        assert matrix.tokens().tolist() == ids.tolist() == [matrix.access(i) for i in range(n)]
        for token in (0, 5, 36, 63, 64):
            places = np.flatnonzero(ids == token).tolist()
            assert matrix.count(token) == len(places) and [matrix.select(token, k) for k in range(len(places))] == places
            assert all(matrix.rank(token, i) == int((ids[:i] == token).sum()) for i in range(0, n, 97))
    with pytest.raises(ValueError):
        wavelet.decode(b"something else")


def test_a_question_reads_little_of_a_shard_file(spark, tmp_path):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50_000, 1_500_000).astype(np.uint16)
    blob = wavelet.encode(ids, 16, [1], np.array([0, len(ids)]))
    shards = spark.createDataFrame([("a", bytearray(blob)), ("b", bytearray(wavelet.encode(ids[:0], 16, [], np.array([0]))))], "shard string, content binary")
    for _ in range(2):  # writing again changes nothing
        written = {r.shard: r for r in wavelet.write_shards(shards, f"file://{tmp_path}/out").collect()}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.pgwm", "b.pgwm"] and written["a"].bytes == len(blob)
    assert wavelet.open_shard(written["b"].path).n == 0
    matrix = wavelet.open_shard(written["a"].path)
    assert [matrix.access(i) for i in (0, 777_777, 1_499_999)] == ids[[0, 777_777, 1_499_999]].tolist()
    assert matrix.unpacked <= 3 * 16 < 0.2 * 16 * matrix.chunks
    token = int(ids[123_456])
    places = np.flatnonzero(ids == token)
    assert matrix.count(token) == len(places) and matrix.select(token, len(places) // 2) == places[len(places) // 2]
    assert (wavelet.decode(blob).tokens() == ids).all() and len(blob) < 1.01 * ids.nbytes
    for bad in (blob[:20], blob[:100], b""):
        with pytest.raises(ValueError):
            wavelet.decode(bad)


def test_shards_hold_the_tokenizers_ids(spark):
    coder = wavelet.tokenizer(registry.VOCABULARY)
    texts = ["", "a  b\n\nc", "it's  we'll\tdon't 12345 ###", " lead and trail ", "línea 漢字　🙂 x", "a\nb\nc", "<|endoftext|>", prose(500, 1), "x  y z\u0085w"]
    found, offsets = coder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert found[offsets[k] : offsets[k + 1]].tolist() == coder.encoding.encode_ordinary(t) and coder.decode(found[offsets[k] : offsets[k + 1]]) == t
    docs = odd(spark).coalesce(1)
    rows = wavelet.shards(docs, registry.VOCABULARY, tokens_per_shard=50).collect()
    back = []
    for r in rows:
        matrix = wavelet.decode(bytes(r.content))
        assert r.documents == len(r.doc_ids) and r.tokens == matrix.n and list(matrix.starts) == r.starts
        all_ids = matrix.tokens()
        back += [(i, coder.decode(all_ids[a:b])) for i, a, b in zip(r.doc_ids, r.starts, r.starts[1:])]
    key = lambda x: (str(x[0]), x[1])
    assert len(rows) > 1 and sorted(back, key=key) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=key)
    assert wavelet.shards(docs.limit(0), registry.VOCABULARY).count() == 0


def test_occurrences_of_a_token(spark):
    docs = table(spark, [(1, "one two one", "en", "a"), (2, "two", "en", "a"), (3, None, "en", "a")])
    coder = wavelet.tokenizer(registry.VOCABULARY)
    token = coder.encoding.encode_ordinary(" two")[0]
    found = wavelet.occurrences(wavelet.shards(docs, registry.VOCABULARY), token).collect()
    assert [(r.doc_id, r.offset) for r in found] == [(1, 1)]


def page_rows():
    return [(k, f"http://host{k % 3}.org/{k}", f"<html lang='en'><body><p>{prose(80, k)} é</p></body></html>") for k in range(40)] + [(100, None, None), (None, "http://x.org", ""), (101, "http://y.org/a\nb", "<p>x")]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").selectExpr("*", "1 AS content", "2 AS name")
    archives = warc.pack_pages(pages.coalesce(1), bytes_per_archive=20_000)
    found = warc.read_records(archives).collect()
    assert archives.count() > 1 and all(r.error is None for r in found)
    key = lambda x: (str(x[0]), x[1])
    got = sorted(((r.headers.get("x-page-id"), bytes(r.block).decode()) for r in found), key=key)
    assert got == sorted(((None if i is None else str(i), h or "") for i, _, h in page_rows()), key=key)
    assert warc.read_records(warc.pack_pages(pages.limit(0))).count() == 0


def test_damaged_archives():
    good = [warc.write_record({"WARC-Type": "resource", "WARC-Record-ID": "<a>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": "3"}, b"abc")] * 20
    whole = warc.write_archive(good)
    assert struct.unpack_from("<I", whole)[0] == warc.DICTIONARY_MAGIC or whole[:4] == warc.FRAME_MAGIC
    assert [r.error for r in warc.read_archive(whole)] == [None] * 20
    assert [r.error for r in warc.read_archive(whole[:-3])][-1].startswith("frame") and list(warc.read_archive(b"")) == []
    packed = zstandard.ZstdCompressor().compress
    bad = {
        b"HTTP/1.1 200\r\n\r\n": "no WARC header",
        good[0].replace(b"WARC-Date", b"X"): "missing warc-date",
        good[0].replace(b"Length: 3", b"Length: x"): "malformed content-length",
        good[0].replace(b"Length: 3", b"Length: 9"): "block has",
        good[0].replace(b"Length: 3", b"Length: 2"): "bytes after the block",
        good[0].replace(b"Content-Length", b"WARC-Block-Digest: sha1:00\r\nContent-Length"): "block digest differs",
    }
    for record, error in bad.items():
        first, second = warc.read_archive(packed(record) + packed(good[0]))
        assert error in first.error and second.error is None and second.payload == b"abc"
    raw = bytes(range(200)) * 40
    head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    assert [r.payload for r in warc.read_archive(head + coder.compress(good[0]))] == [b"abc"]
    assert next(warc.read_archive(head[:50])).error.startswith("dictionary")


def by_hand(block: bytes, *lines: str, length: str | None = None) -> bytes:
    """A record written without the module's writer."""
    head = ["WARC/1.0", "WARC-Type: response", "WARC-Record-ID: <urn:x>", "WARC-Date: 2020-02-02T02:02:02Z", *lines, f"Content-Length: {len(block) if length is None else length}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archive_files_written_by_hand(spark, tmp_path):
    pack = zstandard.ZstdCompressor().compress
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    sha1, sha256 = hashlib.sha1(block).digest(), hashlib.sha256(block).digest()
    good = [f"sha1:{base64.b32encode(sha1).decode()}", f"SHA1: {sha1.hex().upper()}", f"sha-256:{sha256.hex()}", f"sha256:{base64.b32encode(sha256).decode().rstrip('=')}", "blake9:whatever"]
    records = [by_hand(block, f"WARC-Block-Digest: {d}", "WARC-Target-URI: http://x/", f"X-N: {k}") for k, d in enumerate(good)]
    bad = [by_hand(block, f"WARC-Block-Digest: sha1:{base64.b32encode(sha256).decode()[:32]}"), by_hand(block, length="\u00b2"), by_hand(block, length="9" * 30), by_hand(block, length="-1"), by_hand(block, length="\u0664")]
    dictionary = b"WARC/1.0 WARC-Type: response WARC-Record-ID: <urn:x> HTTP/1.1 200 OK" * 4
    squeeze = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
    skipped = struct.pack("<II", 0x184D2A50, 5) + b"other"
    for name, raw in (("raw", dictionary), ("packed", pack(dictionary))):
        head = struct.pack("<II", 0x184D2A5D, len(raw)) + raw
        (tmp_path / f"{name}.warc.zst").write_bytes(head + b"".join(map(squeeze, records[:2])) + skipped + b"".join(map(squeeze, records[2:] + bad)))
    (tmp_path / "none.warc.zst").write_bytes(b"")
    (tmp_path / "plain.warc.zst").write_bytes(pack(records[0]))
    (tmp_path / "other.txt").write_bytes(b"not an archive")
    rows = warc.scan(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.archive.rsplit("/", 1)[1], []).append(r)
    assert by.keys() == {"raw.warc.zst", "packed.warc.zst", "plain.warc.zst"}
    for name in ("raw.warc.zst", "packed.warc.zst"):
        assert [r.error for r in by[name]] == [None] * 5 + ["block digest differs"] + ["malformed content-length"] * 4
        assert [r.headers.get("x-n") for r in by[name][:5]] == list("01234") and all(bytes(r.block) == block and r.uri == "http://x/" for r in by[name][:5])
    assert warc.scan(spark, str(tmp_path)).count() == 21 and spark.createDataFrame([(None, None)], "name string, content binary").transform(warc.read_records).count() == 0


def test_cut_archives_say_so():
    pack = zstandard.ZstdCompressor().compress
    whole = pack(by_hand(b"abc"))
    raw = pack(random.Random(1).randbytes(4000))
    for cut, error in (
        (whole + struct.pack("<II", 0x184D2A51, 100) + b"x" * 50, "skippable frame cut short"),
        (whole + struct.pack("<II", 0x184D2A51, 1), "skippable frame cut short"),
        (whole + whole[:-2], "frame cut short"),
        (whole + b"\x50\x2a", "frame"),
        (whole + b"rubbish that is no frame", "frame"),
    ):
        found = list(warc.read_archive(cut))
        assert len(found) == 2 and found[0].error is None and error in found[1].error
    for head in (raw[:-500], raw[:2000]):
        found = list(warc.read_archive(struct.pack("<II", 0x184D2A5D, len(head)) + head + whole))
        assert len(found) == 1 and found[0].error.startswith("dictionary")
    for n in range(1, 8):
        assert [bool(r.error) for r in warc.read_archive(struct.pack("<II", 0x184D2A5D, 9)[:n])] == [True]
    assert next(warc.read_archive(struct.pack("<II", 0x184D2A5D, 99) + b"short")).error.startswith("dictionary")


def test_records_after_an_oversized_one():
    rng = random.Random(3)
    blocks = [b"first", rng.randbytes(400_000), b"a" * 400_000, b"last", b"very last"]
    packed = [warc.write_record({"WARC-Type": "resource", "WARC-Record-ID": f"<{k}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": str(len(b))}, b) for k, b in enumerate(blocks)]
    content = warc.write_archive(packed)
    found = list(warc.read_archive(content, most_record=100_000))
    assert [r.payload for r in found] == [b"first", b"", b"", b"last", b"very last"]
    assert [bool(r.error) for r in found] == [False, True, True, False, False] and "100000" in found[1].error
    assert [r.offset for r in found] == [r.offset for r in warc.read_archive(content)]
    cut = list(warc.read_archive(warc.write_archive(packed[:2])[:-9], most_record=100_000))
    assert len(cut) == 2 and "cut short" in cut[1].error


def site(host: int, page: int) -> str:
    body = f"<div class='post-{page} main'><p>{prose(60, page)}</p><p>{prose(20, page + 1)}</p></div>"
    return f"<html><body><nav><a href='#'>{prose(30, 1)}</a></nav>{body}<footer>{prose(8, host)}</footer><script>var x = '<div>';</script></body></html>"


def test_winning_paths_are_re_extracted(spark):
    rows = [(h * 100 + p, f"http://h{h}.org/{p}", site(h, p)) for h in range(3) for p in range(12)]
    rows += [(900, "http://h0.org/odd", f"<html><body><div class='post-1 main'><p>short</p></div><div class='aside'>{prose(200, 4)}</div></body></html>"), (901, "http://h0.org/none", f"<section>{prose(30, 5)}</section>")]
    found = {r.page_id: r for r in html_consensus.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for h in range(3):
        for p in range(12):
            r = found[h * 100 + p]
            assert r.consensus and r.text == f"{prose(60, p)}\n{prose(20, p + 1)}" and r.path.endswith(">div.main.post-#")
    assert found[900].text == "short" and found[900].consensus  # the host's path, not the page's best
    assert not found[901].consensus and found[901].text == prose(30, 5)


def test_consensus_equals_a_plain_vote(spark):
    rows = [(k, f"http://h{k % 4}.org/", site(k % 4, k) if k % 5 else f"<div>{prose(9, k)}</div>") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    ballots = {}
    for k, _, h in rows:
        path, score = html_consensus.best_path(h)
        count = ballots.setdefault(k % 4, {}).setdefault(path, [0, 0])
        count[0] += 1
        count[1] += score
    want = {h: min(b, key=lambda p: (-b[p][0], -b[p][1], p)) for h, b in ballots.items()}
    for r in html_consensus.extract_pages(pages).collect():
        found = html_consensus.containers(rows[r.page_id][2])
        hits = [c.text for c in found if c.path == want[r.page_id % 4] and c.text]
        top = max(found, key=lambda c: c.score)
        assert (r.text, r.path, r.consensus) == (("\n".join(hits), want[r.page_id % 4], True) if hits else (top.text, top.path, False))


class Tree(HTMLParser):
    """Containers of well-formed pages by the standard library's parser: path, score and text."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.found, self.link, self.silent = [["", 0, []]], [], False, 0

    def handle_starttag(self, tag, attrs):
        if tag in html_consensus.SILENT:
            self.silent += 1
        self.link |= tag == "a"
        if tag in html_consensus.BREAKS:
            self.handle_text("\n", 0)
        if tag in html_consensus.CONTAINERS:
            names = sorted({re.sub(r"\d+", "#", c.lower()) for c in (dict(attrs).get("class") or "").split()})
            self.open.append([f"{self.open[-1][0]}>{'.'.join([tag, *names])}", 0, []])
            self.found.append(self.open[-1])

    def handle_endtag(self, tag):
        if tag in html_consensus.SILENT:
            self.silent -= 1
        self.link &= tag != "a"
        if tag in html_consensus.CONTAINERS:
            self.open.pop()
        if tag in html_consensus.BREAKS:
            self.handle_text("\n", 0)

    def handle_text(self, text, solid):
        if not self.silent:
            self.open[-1][1] += -solid if self.link else solid
            for x in self.open:
                x[2].append(text)

    def handle_data(self, text):
        self.handle_text(text.replace("\n", " "), len(text) - text.count(" "))

    def handle_entityref(self, name):
        self.handle_text(f"&{name};", len(name) + 2)


def test_containers_equal_another_parser():
    rng = random.Random(6)

    def block(depth):
        tag = rng.choice(["div", "section", "p", "ul", "span", "table"])
        inside = "".join(rng.choice([block(depth - 1) if depth else "x", prose(rng.randint(1, 9), rng.randint(0, 99)), "<a href='u'>go there</a>", "a &amp; b", "<!-- <div> -->", "<br/>", "<img alt='>'>", "<script>if (a < b) '<div>'</script>", "\n"]) for _ in range(rng.randint(1, 5)))
        return f'<{tag} class="c{rng.randint(1, 99)} b" id=x>{inside}</{tag}>'

    for _ in range(60):
        page = f"<html><body>{block(4)}{block(3)}</body></html>"
        tree = Tree()
        tree.feed(page)
        tree.close()
        want = [(path, score, "\n".join(x for line in html.unescape("".join(parts)).split("\n") if (x := " ".join(line.split())))) for path, score, parts in tree.found]
        assert [tuple(c) for c in html_consensus.containers(page)] == want


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "deep", "<a '" * 250_000, '<a "' * 250_000, "<!-" * 300_000, "<!-- " * 200_000, "<svg>" * 200_000, "<" * 1_000_000, "<div>" * 60_000 + "</section>" * 60_000, "<div class='" + "x1 " * 300_000 + "'>t", "</svg" + " " * 1_000_000, "<?" * 400_000, "<div><p>text" * 60_000 + ">"])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    html_consensus.best_path(page)
    assert time.process_time() - began < 2.5


def test_path_hashes_tell_paths():
    parsed = html_consensus.Page(site(1, 2))
    for node, *_ in parsed.containers:
        assert html_consensus.path_hash(parsed.path(node)) == parsed.hash_of(node)


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (2, "not a url", ""), (None, "http://a.org", "<div>x</div>"), (3, "http://a.org", "<div " * 2000), (4, "http://a.org", "<script>never closed"), (5, "http://b.org", "plain &amp; text"), (6, "http://b.org", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS path", "'y' AS host", "'z' AS text")
    found = html_consensus.extract_pages(pages).collect()
    assert len(found) == 8 and [r.text for r in found if r.page_id == 5] == ["plain & text"]
    assert all((r.text, r.path) == ("", None) for r in found if r.page_id in (1, 2, 4))
    assert html_consensus.extract_pages(pages.limit(0)).count() == 0
