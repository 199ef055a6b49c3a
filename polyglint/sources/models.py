"""Model sets on disk: Parquet by tier and language, and the two interchange formats.

A binary model is a version, the language, the longest ngram length, the number of ngrams and
for each its 32-bit hash and its count in a variable number of bytes.  A text model has four
header lines and a line per ngram.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from polyglint.functions import locale as L
from polyglint.session import write_file

VERSION = 1


def encode_vint(value: int) -> bytes:
    """-112..127 in one byte; else a byte for sign and size, then the big-endian magnitude."""
    if -112 <= value <= 127:
        return struct.pack("b", value)
    magnitude, base = (value, -112) if value >= 0 else (~value, -120)
    body = magnitude.to_bytes((magnitude.bit_length() + 7) // 8, "big")
    return struct.pack("b", base - len(body)) + body


def vint_size(first: int) -> int:
    """Bytes of the whole number, from its first byte (signed)."""
    return 1 if first >= -112 else -first - (119 if first < -120 else 111)


def vint_is_negative(first: int) -> bool:
    return first < -120 or -112 <= first < 0


def decode_vint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    first = struct.unpack_from("b", data, at)[0]
    size = vint_size(first)
    if size == 1:
        return first, at + 1
    if at + size > len(data):
        raise ValueError("number cut short")
    magnitude = int.from_bytes(data[at + 1 : at + size], "big")
    return (~magnitude if vint_is_negative(first) else magnitude), at + size


def encode_binary(lang: str, max_n: int, rows: list[tuple[int, int]]) -> bytes:
    if not rows:
        raise ValueError(f"model of {lang} has no ngrams")
    name = lang.encode()
    out = [struct.pack(">iH", VERSION, len(name)), name, struct.pack(">ii", max_n, len(rows))]
    for ngram, count in rows:
        if count <= 0:
            raise ValueError(f"count {count} of ngram {ngram}")
        out.append(struct.pack(">i", ngram) + encode_vint(count))
    return b"".join(out)


def decode_binary(data: bytes) -> tuple[str, int, dict[int, int]]:
    """(lang, max_n, counts); counts of equal hashes add up."""
    version, size = struct.unpack_from(">iH", data)
    if version != VERSION:
        raise ValueError(f"model version {version} instead of {VERSION}")
    lang = data[6 : 6 + size].decode()
    max_n, n = struct.unpack_from(">ii", data, 6 + size)
    at = 14 + size
    if n <= 0:
        raise ValueError(f"model of {lang} has no ngrams")
    counts: dict[int, int] = {}
    for _ in range(n):
        (ngram,) = struct.unpack_from(">i", data, at)
        count, at = decode_vint(data, at + 4)
        if count <= 0:
            raise ValueError(f"count {count} of ngram {ngram}")
        counts[ngram] = counts.get(ngram, 0) + count
    return lang, max_n, counts


def to_binary(models: DataFrame, max_n: int) -> DataFrame:
    """(lang, content) of a hashed model set: one row per language."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ngram")
        lang = part["lang"].iloc[0]
        return pd.DataFrame({"lang": [lang], "content": [encode_binary(lang, max_n, list(zip(part["ngram"].tolist(), part["norm_count"].tolist())))]})

    return models.select("lang", F.col("ngram").cast("int").alias("ngram"), "norm_count").groupBy("lang").applyInPandas(pack, "lang string, content binary")


def from_binary(files: DataFrame, name: str = "path", content: str = "content", checked: bool = True) -> DataFrame:
    """(lang, max_n, ngram, norm_count); if checked, `..._<lang>.bin` must name the language of the header."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["name"], batch["content"]):
                lang, max_n, counts = decode_binary(bytes(data))
                if checked and not path.endswith(f"_{lang}.bin"):
                    raise ValueError(f"{path} holds the model of {lang}")
                yield pd.DataFrame({"lang": lang, "max_n": max_n, "ngram": list(counts), "norm_count": list(counts.values())})

    rows = files.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content"))
    return rows.mapInPandas(unpack, "lang string, max_n int, ngram int, norm_count long")


def write_binary(models: DataFrame, folder: str, max_n: int = 4, prefix: str = "model") -> None:
    """A file `<prefix>_<lang>.bin` per language; languages are fetched one at a time."""
    spark = models.sparkSession
    for row in to_binary(models, max_n).toLocalIterator():
        write_file(spark, f"{folder}/{prefix}_{row.lang}.bin", bytes(row.content))


def read_binary(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_*.bin").option("recursiveFileLookup", "true").load(folder)
    return from_binary(files)


def to_text(models: DataFrame, max_n: int) -> DataFrame:
    """(lang, content) of a text model set."""
    lines = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("\t"), "ngram", F.lit(": "), F.col("norm_count").cast("string")))), "\n")
    head = F.format_string(f"version: {VERSION}\nlanguage: %s\nmax ngram length: {max_n}\nngrams: %d\n", "lang", "n")
    rows = models.groupBy("lang").agg(lines.alias("lines"), F.count(F.lit(1)).alias("n"))
    return rows.select("lang", F.concat(head, "lines", F.lit("\n")).alias("content"))


def from_text(files: DataFrame, content: str = "value", path: str | None = None) -> DataFrame:
    """(lang, max_n, ngram, norm_count); a malformed model raises an error that says what is wrong.

    With path, a column of file names, `..._<lang>.txt` must name the language of the header.
    """
    lines = F.split(F.regexp_replace(content, r"\n+$", ""), "\n")

    def header(place: int, name: str):
        line = F.get(lines, F.lit(place))
        fits = F.coalesce(line.startswith(f"{name}: "), F.lit(False))
        return F.when(fits, F.substring(line, len(name) + 3, 1 << 20)).otherwise(F.raise_error(F.lit(f"line {place + 1} of a model isn't '{name}: ...'")))

    named = F.lit(True) if path is None else F.endswith(F.col(path), F.concat(F.lit("_"), F.substring(F.get(lines, F.lit(1)), 11, 1 << 20), F.lit(".txt")))
    lines = F.when(named, lines).otherwise(F.raise_error(F.concat(F.lit(path and "another language than it holds is named by " or ""), F.col(path) if path else F.lit(""))))
    rows = files.select(F.when(F.size(lines) >= 5, lines).otherwise(F.raise_error(F.lit("a model has fewer than 5 lines"))).alias("lines"))
    lines = F.col("lines")
    rows = rows.select("lines", header(0, "version").alias("version"), header(1, "language").alias("lang"), header(2, "max ngram length").cast("int").alias("max_n"), header(3, "ngrams").cast("int").alias("n"))
    rows = rows.select("lang", "max_n", F.when(F.col("version") == str(VERSION), F.col("n")).otherwise(F.raise_error(F.lit("unknown version of a model"))).alias("n"), F.slice("lines", 5, 1 << 30).alias("lines"))
    rows = rows.select("lang", "max_n", F.explode(F.when(F.size("lines") == F.col("n"), F.col("lines")).otherwise(F.raise_error(F.lit("a model has another number of ngrams than it says")))).alias("line"))
    ngram, count = F.regexp_extract("line", r"^\t(.+?): (.+)$", 1), F.regexp_extract("line", r"^\t(.+?): (.+)$", 2)
    ngram = F.when(ngram != "", ngram).otherwise(F.raise_error(F.concat(F.lit("malformed ngram line: "), "line")))
    return rows.select("lang", "max_n", ngram.alias("ngram"), count.cast("long").alias("norm_count"))


def write_text(models: DataFrame, folder: str, max_n: int = 4, prefix: str = "model") -> None:
    spark = models.sparkSession
    for row in to_text(models, max_n).toLocalIterator():
        write_file(spark, f"{folder}/{prefix}_{row.lang}.txt", row.content.encode())


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*_*.txt", recursiveFileLookup=True)
    return from_text(files.select("value", F.col("_metadata.file_path").alias("path")), path="path")


def save(models: DataFrame, path: str) -> None:
    """Parquet by tier (core or extras) and language; replaces what is there."""
    tier = F.when(L.parse(F.col("lang"))["lang"].isin(*L.CORE), "core").otherwise("extras")
    models.withColumn("tier", tier).repartition("tier", "lang").write.mode("overwrite").partitionBy("tier", "lang").parquet(path)


def load(spark: SparkSession, path: str, tier: str | None = None, langs: list[str] | None = None) -> DataFrame:
    """A saved model set; tier and languages prune folders."""
    rows = spark.read.parquet(path)
    if tier:
        rows = rows.where(F.col("tier") == tier)
    if langs:
        rows = rows.where(F.col("lang").isin(*langs))
    return rows.select("lang", "ngram", "norm_count")


def load_core(spark: SparkSession, path: str) -> DataFrame:
    """The models of the core tier; languages without one are left out, and the folders of others aren't read."""
    return load(spark, path, tier="core")


def load_or_keep(spark: SparkSession, path: str, kept: DataFrame | None, suffix: str = ".txt") -> DataFrame | None:
    """Models of a folder of text (.txt) or binary (.bin) files; `kept`, the set loaded before, where there are none."""
    try:
        found = (read_binary if suffix == ".bin" else read_text)(spark, path)
        return kept if found.isEmpty() else found.select("lang", "ngram", "norm_count")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return kept
