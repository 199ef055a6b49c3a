"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from labelled texts.  A text is
compressed once per language and gets the language whose dictionary makes it smallest;
where the runner-up is nearly as small the text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PIECE = 8192
_NOT_LETTERS = re.compile(r"[\W\d_]+")
RESULT = T.StructType([T.StructField("language", T.StringType()), T.StructField("size", T.LongType()), T.StructField("runner_up", T.LongType()), T.StructField("margin", T.DoubleType())])


def letters(text: str) -> bytes:
    """What is compressed: lower-case words with single blanks around, without digits and symbols."""
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")


#: Texts fall into so many parts by their hash; a text is judged by dictionaries from the other parts only.
FOLDS = 2


def fold_of(text: Column) -> Column:
    """The part of a text; equal texts are in the same one."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", texts_per_language: int = 200, dictionary_bytes: int = 112 << 10, bytes_per_text: int = 2048, folds: int = 1) -> list[dict[str, bytes]]:
    """Raw dictionary content per language, for each of `folds` parts of the texts, from a bounded sample of labelled rows.

    The sample: the texts_per_language rows of each part and language with the smallest
    text hash.  Of each it takes about bytes_per_text bytes from a place that the hash
    chooses, joined up to dictionary_bytes.  Rows with null text or language are left out;
    equal texts count once.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and length(text) > 0")
    order = F.xxhash64(F.lit("sample"), "text")
    start = F.pmod(F.xxhash64(F.lit("place"), "text"), F.greatest(F.length("text") - bytes_per_text + 1, F.lit(1))).cast("int")
    part = F.lit(0) if folds == 1 else fold_of(F.col("text"))
    rows = rows.select("lang", part.alias("part"), order.alias("h"), F.expr("text").substr(start + 1, F.lit(bytes_per_text)).alias("piece"))
    # the group limit runs before the shuffle: only texts_per_language pieces leave a partition
    rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "piece"))
    sample = rows.withColumn("rank", rank).where(F.col("rank") <= texts_per_language).orderBy("part", "lang", "rank").toPandas()
    out: list[dict[str, bytes]] = [{} for _ in range(folds)]
    for (number, language), group in sample.groupby(["part", "lang"], sort=True):
        joined, seen = b"", set()
        for raw in group["piece"]:
            piece = letters(raw.encode("utf-8", "surrogatepass")[:bytes_per_text].decode("utf-8", "ignore"))
            room = dictionary_bytes - len(joined)
            if piece not in seen and room > 1:
                seen.add(piece)
                joined += piece[:room]
        out[number][language] = joined
    return out


class Compressors:
    """One compressor per language, made once per worker."""

    def __init__(self, content: dict[str, bytes], level: int) -> None:
        self.names = sorted(content)
        self.each = []
        for name in self.names:
            data = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content[name]) >= 8 else None
            if data is not None:
                data.precompute_compress(level)
            options = {"dict_data": data} if data is not None else {}
            self.each.append(zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False, **options).compress)

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes per language; none for a text without letters.

        The whole text counts, in pieces of PIECE bytes that each see the dictionary, so
        that the dictionary matters as much at the end of a long text as at its start.
        """
        data = letters(text)
        if not data.strip():
            return np.zeros(0, dtype=np.int64)
        total = np.zeros(len(self.each), dtype=np.int64)
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            total += [len(f(piece)) for f in self.each]
        return total


def judge(sizes: np.ndarray, names: list[str], least_bytes: int, least_share: float) -> tuple[str | None, int | None, int | None, float | None]:
    """(language or None, smallest size, runner-up, margin as a share of the smallest)."""
    if not len(sizes):
        return None, None, None, None
    order = np.argsort(sizes, kind="stable")
    best = int(sizes[order[0]])
    if len(order) == 1:
        return names[order[0]], best, None, None
    second = int(sizes[order[1]])
    wide = second - best >= max(least_bytes, least_share * best)
    return (names[order[0]] if wide else None), best, second, (second - best) / best if best else 0.0


def classifier(content: list[dict[str, bytes]], level: int = 5, least_bytes: int = 1, least_share: float = 0.01):
    """A column function text -> struct(language, size, runner_up, margin), by one set of dictionaries, or by that of the other part.

    language is null for a rejected text: null and empty ones, those without letters, and those whose
    second-smallest size is within least_bytes or least_share of the smallest (ties
    always).  With one language every text with content gets it; with none every text
    is rejected.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        each = [Compressors(c, level) for c in content]
        nothing = np.zeros(0, dtype=np.int64)
        for texts, parts in batches:
            used = [each[(p + 1) % len(each)] for p in parts]
            rows = [judge(c.sizes(x) if isinstance(x, str) else nothing, c.names, least_bytes, least_share) for x, c in zip(texts, used)]
            language, size, second, margin = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"language": pd.Series(language, dtype=object), "size": pd.Series(size, dtype="Int64"), "runner_up": pd.Series(second, dtype="Int64"), "margin": pd.Series(margin, dtype="Float64")})

    # the planner would run it twice, in a filter and in a projection, if it took it for cheap
    udf = F.pandas_udf(run, RESULT).asNondeterministic()

    def column(text: Column) -> Column:
        text = text.cast("string")
        return udf(text, F.coalesce(fold_of(text), F.lit(0)) if len(content) > 1 else F.lit(0))

    return column


def identify(docs: DataFrame, labelled: DataFrame | None = None, **options) -> DataFrame:
    """docs with a struct column `identified`; extra columns stay, an own `identified` is replaced.

    Options of dictionaries() and classifier() by name.  labelled are texts with known
    languages.  Without them the labels of docs serve, and then no text is judged by a
    dictionary that holds a piece of it or of a copy of it: texts fall into two parts by
    their hash, and each is judged by the dictionaries of the other.  Null and empty texts
    and those without letters are rejected, and so are ties; very long texts are judged
    whole; repeated rows are judged each, and alike; an empty table gives no rows.
    """
    sample = {k: options.pop(k) for k in ("texts_per_language", "dictionary_bytes", "bytes_per_text") if k in options}
    content = dictionaries(docs, folds=FOLDS, **sample) if labelled is None else dictionaries(labelled, **sample)
    return docs.withColumn("identified", classifier(content, **options)(F.col("text")))


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """docs without the rejected ones, with their own columns; see identify()."""
    columns = docs.columns
    return identify(docs, **options).where("identified.language is not null").select(*[F.col(f"`{c}`") for c in columns])
