"""Corpus preparation: clean lines, deterministic samples, page text, character budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyglint.functions import locale as L
from polyglint.operators import detect as D
from polyglint.session import discard, saved, shuffle_partitions, small


def lines(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """(keys..., line_no, line): the lines of each text, from 1."""
    return docs.select(*keys, F.posexplode(F.split(F.col(text), "\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def clean_line(line: Column) -> Column:
    """Without parenthesised parts and a short tail after a colon."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), r"\(.+\)", ""), r":.{1,20}$", ""))


def clean_lines(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id", "lang"), least: int = 20) -> DataFrame:
    """(keys..., line_no, line): cleaned lines of at least `least` characters, without tag lines."""
    rows = lines(docs, text, keys).where(~F.trim("line").startswith("<"))
    return rows.withColumn("line", clean_line(F.col("line"))).where(F.length("line") >= least)


def _place(*parts: Column) -> Column:
    return F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))


def sample_lines(rows: DataFrame, by: list[str], lines_per_group: int | None = None, percent: float | None = None) -> DataFrame:
    """Of each group so many lines, or so large a share, in an order that looks random but is always the same.

    Exactly one of lines_per_group and percent (a share) may be given; without either the
    share is a thousandth.  Counts per group and slice of the order tell which slices are
    in, which are out and which one is cut; so no task sorts a whole group.
    """
    if lines_per_group is not None and percent is not None:
        raise ValueError("either lines_per_group or percent")
    place = _place(F.col("doc_id"), F.col("line_no"))
    rows = rows.withColumn("__place", place).withColumn("__slice", F.substring("__place", 1, 3))
    counts = rows.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*by).orderBy("__slice")
    size = F.sum("__n").over(Window.partitionBy(*by))
    share = 0.001 if percent is None else percent
    wanted = F.lit(lines_per_group) if lines_per_group is not None else F.floor(size * F.lit(share) + 0.5)
    counts = counts.select(*by, "__slice", (F.sum("__n").over(over) - F.col("__n")).alias("__before"), wanted.alias("__wanted"))
    counts = counts.where(F.col("__before") < F.col("__wanted"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*by, "__slice")]
    rows = rows.alias("r").join(small(saved(counts, "slices")).alias("c"), same).select("r.*", "__before", "__wanted")
    rank = F.row_number().over(Window.partitionBy(*by, "__slice").orderBy("__place", "doc_id", "line_no"))
    return rows.withColumn("__rank", rank + F.col("__before")).where(F.col("__rank") <= F.col("__wanted")).drop("__rank", "__before", "__wanted", "__slice", "__place")


def strip_footnotes(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[ ]*\d+[ ]*\]", " ")


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t]+", " "))


def merged_lines(pages: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, line): non-empty lines without footnotes, blanks collapsed: a training corpus."""
    rows = pages.select(F.col(lang).alias("lang"), F.explode(F.split(F.col(text), "\r?\n")).alias("line"))
    return rows.select("lang", collapse_blanks(strip_footnotes(F.col("line"))).alias("line")).where(F.length("line") > 0)


def page_text(html: Column) -> Column:
    """Visible text by regular expressions alone: no scripts, styles, comments or tags; common entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head|nav|footer)[^>]*>.*?</(script|style|head|nav|footer)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def declared_language(html: Column) -> Column:
    """The lang attribute of the html element; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang=\"([^\"]*)\"", 1)), F.lit(""))


def kept_pages(pages: DataFrame, text: str = "text", least: int = 100) -> DataFrame:
    """Pages with enough content to be saved."""
    return pages.where(F.length(text) >= least)


def write_pages(pages: DataFrame, path: str, overwrite: bool = False, text: str = "text", least: int = 100) -> None:
    """Pages with enough content as a Parquet table; what is there already stays unless `overwrite`."""
    kept_pages(pages, text, least).write.mode("overwrite" if overwrite else "ignore").parquet(path)


def topic_name(english_title: Column, title: Column) -> Column:
    """The English title, else the page's own up to a dash, else 'unknown'."""
    own = F.nullif(F.trim(F.regexp_extract(title, r"^(.*?)(?: - | — |$)", 1)), F.lit(""))
    return F.coalesce(F.nullif(english_title, F.lit("")), own, F.lit("unknown"))


def char_budget(docs: DataFrame, target: int, per_text: int = 10 * 1024, most_texts: int | None = None, lang: str = "lang", key: str = "doc_id", chars: str = "n_chars") -> DataFrame:
    """docs up to a budget of characters per language, with `chars_before`.

    Texts come in the order of key; each counts with at most per_text characters, and is
    taken while the texts before it haven't reached the target, and while there are fewer
    than most_texts of them.  Sums per range of keys show where a language reaches the
    budget: texts beyond that range are left out before any language is put in order.
    """
    parts = shuffle_partitions(docs.sparkSession)
    slim = docs.select(F.col(lang).alias("g"), F.col(key).alias("k"), F.least(F.col(chars), F.lit(per_text)).alias("n"))
    slim = saved(slim.repartitionByRange(4 * parts, "g", "k").withColumn("part", F.spark_partition_id()), "ranges")
    sums = slim.groupBy("g", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.max("k").alias("last"))
    upto = Window.partitionBy("g").orderBy("part")
    full = F.sum("n").over(upto) >= target
    if most_texts is not None:
        full = full | (F.sum("texts").over(upto) >= most_texts)
    ends = saved(sums.withColumn("full", full).where("full").groupBy("g").agg(F.min("last").alias("last")), "ends")
    discard(slim)
    docs = docs.join(small(ends.select(F.col("g").alias("__g"), F.col("last").alias("__last"))), F.col(lang).eqNullSafe(F.col("__g")), "left")
    docs = docs.where(F.col("__last").isNull() | (F.col(key) <= F.col("__last"))).drop("__g", "__last")
    before = Window.partitionBy(lang).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.withColumn("chars_before", F.coalesce(F.sum(F.least(F.col(chars), F.lit(per_text))).over(before), F.lit(0)).cast("long"))
    rows = rows.withColumn("__texts", F.row_number().over(Window.partitionBy(lang).orderBy(key)))
    if most_texts is not None:
        rows = rows.where(F.col("__texts") <= most_texts)
    return rows.where(F.col("chars_before") < target).drop("__texts")


def completed(taken: DataFrame, target: int, per_text: int = 10 * 1024, lang: str = "lang", chars: str = "n_chars") -> DataFrame:
    """(lang, chars, complete) of a budgeted corpus."""
    total = F.sum(F.least(F.col(chars), F.lit(per_text)))
    return taken.groupBy(lang).agg(total.alias("chars"), (total >= target).alias("complete"))


def beyond_latin(rows: DataFrame, line: str = "line") -> DataFrame:
    """Rows whose first character is neither Basic Latin nor Latin-1."""
    return rows.where((F.length(F.trim(line)) > 0) & (F.ascii(F.trim(line).substr(1, 1)) > 255))


def declaration_lines(rows: DataFrame, code: str = "lang", text: str = "text") -> DataFrame:
    """Lines of a declaration corpus: not empty, no comments, with a known code."""
    return rows.where((F.length(F.trim(text)) > 0) & ~F.col(text).startswith("#") & ~F.col(code).isin("   ", "???") & ~F.col(code).startswith("#"))


def beyond_latin_report(rows: DataFrame, models: DataFrame, keys: tuple[str, ...] = ("doc_id", "line_no"), line: str = "line", without: str = "en", **options) -> DataFrame:
    """(keys..., line, lang, posterior, second_lang, second_posterior) of lines beyond Latin, but for those in the language `without`.

    lang is null where no language can be told, second_lang where there is no runner-up.
    """
    lines_here = saved(beyond_latin(rows, line).select(*keys, F.col(line).alias("line")).withColumn("__line", F.concat_ws("/", *[F.col(k).cast("string") for k in keys])), "lines")
    found = D.margins(D.detect(lines_here, models, "__line", "line", **options), "__line")
    target, best = L.parse(F.lit(without)), L.parse(F.col("lang"))
    report = lines_here.join(found, "__line", "left").where(~F.coalesce(L.weakly_equal(best, target), F.lit(False)))
    return report.select(*keys, "line", "lang", "posterior", "second_lang", "second_posterior")
