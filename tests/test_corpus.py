"""Corpus preparation and sources."""

from __future__ import annotations

import hashlib
import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from polyglint.operators import corpus as C
from polyglint.sources import labelled, pages


def test_clean_lines(spark):
    text = "<P>\nA line (with a remark) that is long enough.\nshort\nThe president of the house has spoken: thank you\n"
    found = C.clean_lines(spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string")).collect()
    assert [(r.line_no, r.line) for r in found] == [(2, "A line  that is long enough."), (4, "The president of the house has spoken")]


def test_labelled_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("en\tsome\ttext\nno tab\n")
    assert [tuple(r) for r in labelled.read_tsv(spark, f"{tmp_path}/a.tsv").collect()] == [("en", "some\ttext", True), (None, "no tab", False)]
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "part_de.txt").write_text("eins\n\nzwei\n")
    (tmp_path / "x" / "other.txt").write_text("skipped\n")
    assert {(r.lang, r.text) for r in labelled.read_folder(spark, f"{tmp_path}/x").collect()} == {("de", "eins"), ("de", "zwei")}
    assert [r.file for r in labelled.skipped_files(spark, f"{tmp_path}/x").collect()] == ["other.txt"]


def test_parliament_folders(spark, tmp_path):
    for lang in ("en", "de", "long"):
        (tmp_path / lang).mkdir()
        (tmp_path / lang / "a.txt").write_text("".join(f"This is line number {k} of the session.\n" for k in range(30)) + "<TAG>\n")
    found = labelled.extract_parliament(spark, str(tmp_path), lines_per_file=7)
    assert {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()} == {"en": 7, "de": 7}
    with pytest.raises(ValueError):
        labelled.extract_parliament(spark, str(tmp_path), 1, 0.5)


def test_code_lists(spark, tmp_path):
    (tmp_path / "codes").write_text("1\tEnglish\ten\teng\n2\tChinese\tzh\tzho\t#two scripts\n3\tNone\tqq\txxx\n")
    codes = labelled.read_code_map(spark, f"{tmp_path}/codes")
    assert {(r.wiki, r.iso) for r in labelled.iso_of_wiki(codes).collect()} == {("en", "eng"), ("zh", "zho-Hant"), ("zh", "zho-Hans")}
    (tmp_path / "topics").write_text("# list\nQ1\nQ22 # two\n\n")
    assert [r.topic for r in labelled.read_topics(spark, f"{tmp_path}/topics").collect()] == ["Q1", "Q22"]
    assert [r.topic for r in labelled.read_topics(spark, f"{tmp_path}/topics", most=1).collect()] == ["Q1"]


def test_page_content():
    html = "<div id='mw-content-text'><p>One <b>two</b></p><div id='toc'>no</div><table><tr><td>no</td></tr></table><p>three<br>four</p><ol class='references'><li>x</li></ol><p>late</p></div>"
    assert pages.content_of(html) == "One two\nthreefour\n"
    assert pages.content_of("<article><p>a</p></article>") == "a\n" and pages.content_of(None) == ""


def test_links_and_xpath(spark):
    rows = spark.createDataFrame([(1, "http://A.org/x/y", '<a href="z">z</a> <a class="c" href="/q">q</a>'), (2, None, None)], "page_id long, url string, html string")
    assert {r.link for r in pages.links(rows).collect()} == {"http://A.org/x/z", "http://A.org/q"}
    assert [r.h for r in rows.select(pages.host(F.col("url")).alias("h")).collect()] == ["a.org", None]
    assert rows.select(pages.xpath_texts(F.lit("<a><b>x</b><b>y</b></a>"), "a/b/text()").alias("x")).first().x == ["x", "y"]


def test_budget(spark):
    rows = spark.createDataFrame([(k, "en", 40) for k in range(10)], "doc_id long, lang string, n_chars long")
    assert [r.doc_id for r in C.char_budget(rows, 100, per_text=30).orderBy("doc_id").collect()] == [0, 1, 2, 3]
    assert C.char_budget(rows, 100, most_texts=2).count() == 2
    assert C.completed(C.char_budget(rows, 100), 100).first().complete


def test_samples_take_the_same_lines_as_one_sort(spark):
    rows = spark.createDataFrame([(k, k % 7, ["en", "de", None][k % 3]) for k in range(3000)], "doc_id long, line_no int, lang string")
    place = lambda r: (hashlib.md5(f"{r.doc_id}/{r.line_no}".encode()).hexdigest(), r.doc_id, r.line_no)
    every = {}
    for r in rows.collect():
        every.setdefault(r.lang, []).append(r)
    for options, wanted in (({"lines_per_group": 37}, 37), ({"percent": 0.1}, 100), ({}, 1), ({"lines_per_group": 5000}, 1000), ({"lines_per_group": 0}, 0)):
        found = {(r.doc_id, r.line_no) for r in C.sample_lines(rows, ["lang"], **options).collect()}
        assert found == {(r.doc_id, r.line_no) for g in every.values() for r in sorted(g, key=place)[:wanted]}


def test_budgets_of_many_texts(spark):
    rng = random.Random(2)
    data = [(k // 2, rng.choice(["en", "de", None]), rng.randint(0, 90)) for k in range(2000)]
    rows = spark.createDataFrame(data, "doc_id long, lang string, n_chars long").dropDuplicates(["doc_id"]).cache()
    for target, most in ((5000, None), (10**9, None), (10**9, 17), (3000, 5), (0, None)):
        want = set()
        for lang in ("en", "de", None):
            before, taken = 0, 0
            for r in sorted((r for r in rows.collect() if r.lang == lang), key=lambda r: r.doc_id):
                if before >= target or (most is not None and taken >= most):
                    break
                want.add((r.doc_id, before))
                before, taken = before + min(r.n_chars, 60), taken + 1
        assert {(r.doc_id, r.chars_before) for r in C.char_budget(rows, target, 60, most).collect()} == want


def test_pages_are_written_once(spark, tmp_path):
    pages_of = lambda t: spark.createDataFrame([(1, t * 150), (2, "short")], "page_id long, text string")
    for text, overwrite, want in (("a", False, "a"), ("b", False, "a"), ("c", True, "c")):
        C.write_pages(pages_of(text), f"{tmp_path}/p", overwrite)
        assert [r.text[0] for r in spark.read.parquet(f"{tmp_path}/p").collect()] == [want]


def test_topics_declarations_and_codes(spark, tmp_path):
    rows = spark.createDataFrame([("Cat", "x"), ("", "Chat - wiki"), (None, "Katze — wiki"), (None, ""), (None, None)], "e string, t string")
    assert [r.n for r in rows.select(C.topic_name(F.col("e"), F.col("t")).alias("n")).collect()] == ["Cat", "Chat", "Katze", "unknown", "unknown"]
    lines = spark.createDataFrame([("en", "a"), ("en", " "), ("#", "b"), ("en", "# c"), ("???", "d"), ("   ", "e")], "lang string, text string")
    assert [r.text for r in C.declaration_lines(lines).collect()] == ["a"]
    (tmp_path / "codes").write_text("2\tOld English\tang\teng\n1\tEnglish\ten\teng\n3\tChinese\tzh\tzho\n4\tNone\tqq\txxx\n")
    codes = labelled.read_code_map(spark, f"{tmp_path}/codes")
    assert {(r.iso, r.wiki) for r in labelled.wiki_of_iso(codes).collect()} == {("eng", "en"), ("zho-Hant", "zh"), ("zho-Hans", "zh")}
    tags = spark.createDataFrame([("zho-Hant",), ("zho-Hans",), ("deu",)], "t string")
    assert [r.a for r in tags.select(labelled.accept_language(F.col("t")).alias("a")).collect()] == ["zh-Hant", "zh-Hans", "deu"]


def test_lines_beyond_latin(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "éa"), (3, " Жx"), (4, ""), (5, None), (6, "漢"), (7, "Ā")], "k int, line string")
    assert {r.k for r in C.beyond_latin(rows).collect()} == {3, 6, 7}


def test_links_equal_the_standard_library(spark):
    rng = random.Random(4)
    parts = ["a", "../b", "/c?d=1", "#e", "http://O.org/f", "//g.org/h", "mailto:x@y", "", "i j", "?k"]
    data = [(k, f"http://h{k}.org/p/q{k}.html", "".join(f'<a id="x" href="{rng.choice(parts)}">t</a>' for _ in range(5)) + ('<base href="http://base.org/z/">' if k % 4 == 0 else "")) for k in range(40)]
    found = {(r.page_id, r.link) for r in pages.links(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    want = set()
    for k, url, html in data:
        base = "http://base.org/z/" if "<base" in html else url
        want |= {(k, urljoin(base, h)) for h in re.findall(r'href="([^"]*)">t', html)}
    assert found == want
