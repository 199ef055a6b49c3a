"""Labelled training texts: tab-separated files, folders of texts per language, parliament folders, code lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.operators import corpus

_PATH = "_metadata.file_path"


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(lang, text, valid) of lines `lang<TAB>text`; a line without a tab is kept as text, lang null, not valid."""
    rows = spark.read.text(path)
    tab = F.instr("value", "\t")
    lang = F.when(tab > 0, F.expr("substr(value, 1, instr(value, '\t') - 1)"))
    text = F.when(tab > 0, F.expr("substr(value, instr(value, '\t') + 1)")).otherwise(F.col("value"))
    return rows.select(lang.alias("lang"), text.alias("text"), (tab > 0).alias("valid"))


def write_tsv(corpus_rows: DataFrame, path: str, lang: str = "lang", text: str = "text") -> None:
    """Lines `lang<TAB>text`; line breaks within a text become blanks, as a line is a text. Null texts are left out."""
    line = F.concat(F.col(lang), F.lit("\t"), F.regexp_replace(F.col(text), r"[\r\n]+", " "))
    corpus_rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(line.alias("value")).write.mode("overwrite").text(path)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(lang, text, file) of all non-blank lines of files named `..._<lang>.txt` below a folder; other names are skipped."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    name = F.element_at(F.split(_PATH, "/"), -1)
    lang = F.regexp_extract(name, r"^.+_(.+)\.txt$", 1)
    rows = rows.select(lang.alias("lang"), F.col("value").alias("text"), name.alias("file"))
    return rows.where((F.col("lang") != "") & (F.trim("text") != ""))


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of text files below a folder whose name tells no language."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file")).where(~F.col("file").rlike(r"^.+_.+\.txt$"))


def extract_parliament(spark: SparkSession, path: str, lines_per_file: int | None = None, percent: float | None = None) -> DataFrame:
    """(lang, line) from files in two-letter subfolders: cleaned lines, of each file a sample."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path)
    folder = F.element_at(F.split(_PATH, "/"), -2)
    rows = rows.select(folder.alias("lang"), F.col(_PATH).alias("file"), F.col("value").alias("line")).where(F.length("lang") == 2)
    rows = rows.where(~F.trim("line").startswith("<")).withColumn("line", corpus.clean_line(F.col("line"))).where(F.length("line") >= 20)
    # the order within a file is that of the lines' hashes; equal lines are alike
    rows = rows.select("lang", F.col("file").alias("doc_id"), F.xxhash64("line").alias("line_no"), "line")
    return corpus.sample_lines(rows, ["doc_id"], lines_per_file, percent).select("lang", "line")


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """(rank, name, wiki, iso, comment) of a tab-separated code map; iso 'xxx' marks codes that are left out."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    columns = [F.trim(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(("rank", "name", "wiki", "iso", "comment"))]
    return rows.select(*columns).withColumn("rank", F.expr("try_cast(rank AS int)")).where("iso <> 'xxx'")


def _isos() -> Column:
    return F.when(F.col("wiki") == "zh", F.array(F.lit("zho-Hant"), F.lit("zho-Hans"))).otherwise(F.array("iso"))


def iso_of_wiki(codes: DataFrame) -> DataFrame:
    """(wiki, iso): Chinese stands for both of its scripts."""
    return codes.select("wiki", F.explode(_isos()).alias("iso"))


def read_topics(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(topic) of a list with one code per line and # comments; the first `most` of them, if given."""
    code = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = spark.read.text(path).select(code.alias("topic")).where("topic <> ''")
    return rows if most is None else rows.limit(most)


def wiki_of_iso(codes: DataFrame) -> DataFrame:
    """(iso, wiki): the reverse of iso_of_wiki(); of several codes for a language the one of highest rank."""
    each = codes.select(F.explode(_isos()).alias("iso"), "wiki", "rank")
    return each.groupBy("iso").agg(F.min(F.struct(F.coalesce("rank", F.lit(1 << 30)), "wiki")).alias("first")).select("iso", "first.wiki")


def accept_language(lang: Column) -> Column:
    """What a request for a page in this language accepts: the script of Chinese, other codes as they are."""
    return F.when(lang == "zho-Hant", "zh-Hant").when(lang == "zho-Hans", "zh-Hans").otherwise(lang)
