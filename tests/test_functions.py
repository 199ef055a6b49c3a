"""Normalisation, ngrams, hashes and language identities: exact values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from polyglint.functions import locale as L
from polyglint.functions import text as T
from polyglint.functions.sql import register_ngrams
from polyglint.plans import catalog


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def grams(spark, text, n):
    rows = T.ngrams(spark.createDataFrame([(1, text)], "k int, t string"), "t", ["k"], n)
    return [r.ngram for r in rows.collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [("abc", " abc "), ("A ,!", " a "), ("\r\t\n", " "), ("", " "), ("ΑΣ İ", " ασ i "), ("カタカナ", " アアアア "), ("ひらがな", " ああああ "), ("한국", " 가가 "), ("«a»…b c", " a b c "), ("a b", " a b "), (None, None)],
)
def test_normalize(spark, text, want):
    assert one(spark, text, T.normalize) == want


def test_unfinished_text_keeps_no_last_blank(spark):
    assert one(spark, "ab c ", lambda t: T.normalize(t, complete=False)) == " ab c"


def test_ngrams(spark):
    assert len(set(grams(spark, "abc", 3))) == 11
    assert set(grams(spark, "A ,!", 3)) == {" ", " a", " a ", "a", "a "}
    assert grams(spark, "\r\t\n", 1) == [" "]
    assert len(grams(spark, "ab" * 1000, 3)) == 3 * (2002 - 1)
    assert grams(spark, None, 3) == []


def test_ngrams_in_reading_order(spark):
    rows = T.positioned(spark.createDataFrame([(1, "ab")], "k int, t string"), "t", ["k"], 3).orderBy("pos", "len").collect()
    assert [r.ngram for r in rows] == [" ", " a", " ab", "a", "ab", "ab ", "b", "b ", " "]


def test_clipped_ngrams(spark):
    rows = T.clipped(spark.createDataFrame([(1, "abcdef")], "k int, t string"), "t", ["k"], 4).collect()
    assert len(rows) == 4 * 7 - 9 and "def" in {r.ngram for r in rows}


def test_chunks_are_joined_in_order(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "k int, o int, t string")
    assert T.chunks_in_order(rows, ["k"], "o", "t").first().t == "ab"


@pytest.mark.parametrize(("text", "want"), [(" ", 1239258034), (" a", 995283569), ("abc", -317513893)])
def test_joaat(spark, text, want):
    assert one(spark, text, T.joaat) == want


@pytest.mark.parametrize(
    ("tag", "want"),
    [("cy", "cym"), ("wel", "cym"), ("sv", "swe"), ("ger", "deu"), ("zh-TW", "zho-Hant"), ("zh-Hant", "zho-Hant"), ("zho-CN", "zho-Hans"), ("az-Latn", "aze"), ("sr-Cyrl", "srp"), ("sr-latn", "srp-Latn"), ("EN-us", "eng"), ("", None), ("?", None)],
)
def test_locale(spark, tag, want):
    assert one(spark, tag, lambda t: L.name(L.parse(t))) == want


@pytest.mark.parametrize(
    ("result", "target", "weak", "strict"),
    [("nob", "nor", True, False), ("nor", "nob", False, False), ("zho-Hant", "zho", True, False), ("zho", "zho-Hant", False, False), ("de", "ger", True, True)],
)
def test_equalities(spark, result, target, weak, strict):
    rows = spark.createDataFrame([(result, target)], "a string, b string")
    a, b = L.parse(F.col("a")), L.parse(F.col("b"))
    assert tuple(rows.select(L.weakly_equal(a, b), L.strictly_equal(a, b)).first()) == (weak, strict)


def test_ngram_counts_in_sql(spark):
    """Counted where the texts lie: the same as a row per occurrence, without such rows."""
    register_ngrams(spark)
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 3000))) * 2
    docs = spark.createDataFrame([(t,) for t in ("abc abc", None, "", "A ,!", "\U0001f600 x\U0001f600", wide, "abc ü")], "text string").repartition(3)
    for n in (1, 3, 6):
        found = spark.sql(f"SELECT len, ngram, sum(n) AS n FROM ngram_counts(TABLE(SELECT text FROM {{d}}), {n}) GROUP BY ALL", d=docs)
        want = spark.sql(f"SELECT g.len, g.ngram, count(*) AS n FROM {{d}} d, LATERAL ngrams(d.text, {n}) g GROUP BY ALL", d=docs)
        assert found.schema.simpleString() == want.schema.simpleString() and sorted(found.collect()) == sorted(want.collect())


def test_the_sql_query_has_no_row_per_occurrence(spark, tmp_path):
    rows = [(k, "en", text) for k, text in enumerate(["a b", "b"])]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["sql_ngrams"](spark, str(tmp_path))
    assert {r.ngram: r.n for r in found.where("len = 1").collect()} == {" ": 5, "a": 1, "b": 2}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
