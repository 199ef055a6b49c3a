"""Language models: ngram counts, normalisation, pruning, comparison.

A model set is one table (lang, ngram, norm_count); counts are scaled to a million per
language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyglint.functions import locale as L
from polyglint.functions import text as T
from polyglint.functions import vector as V
from polyglint.session import spread

SCALE = 1_000_000
#: A language with fewer ngram occurrences gets no model: 4000 for each ngram length.
LEAST_NGRAMS = 4000 * 4
#: Windows are counted in pieces of about so many bytes of text: the larger, the fewer rows; a task holds some 60 times as much.
TRAIN_BYTES = 1 << 19


def counts(labelled: DataFrame, lang: str = "lang", text: str = "text", n: int = T.MAX_N) -> DataFrame:
    """(lang, ngram, n); null texts have no ngrams, a null language is one of its own.

    Windows are counted first, one per character and where the texts lie, and split into
    their prefixes only once they are distinct.
    """
    return _counted(labelled, lang, text, n, False)


def hashed_counts(labelled: DataFrame, lang: str = "lang", text: str = "text", n: int = T.MAX_N) -> DataFrame:
    """(lang, ngram, n) of the hashed mode: ngram is a 32-bit hash, and texts are clipped at the tail."""
    seen = _counted(labelled, lang, text, n, True)
    return seen.select("lang", T.joaat(F.col("ngram")).alias("ngram"), "n").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


def _counted(labelled: DataFrame, lang: str, text: str, n: int, clipped: bool) -> DataFrame:
    rows = spread(labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")))
    seen = rows.where("text is not null").mapInArrow(_window_rows(n, clipped), "lang string, w string, n long")
    return T.prefixes(seen.groupBy("lang", "w").agg(F.sum("n").alias("n")), n).groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


def _window_rows(n: int, clipped: bool):
    """Partial counts of windows per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = V.Tally(["lang", "w"])
        for batch in batches:
            for part in V.pieces(batch, "text", TRAIN_BYTES):
                names = part.column("lang").dictionary_encode()
                place = pc.fill_null(names.indices, len(names.dictionary)).to_numpy(zero_copy_only=False)
                for k in np.unique(place).tolist():
                    windows, counts = V.window_counts(part.column("text").filter(pa.array(place == k)), n, clipped)
                    lang = names.dictionary[k].as_py() if k < len(names.dictionary) else None
                    yield from tally.add(pa.table({"lang": pa.array([lang] * len(windows), pa.string()), "w": pa.array(windows, pa.string()), "n": pa.array(counts, pa.int64())}))
        yield from tally.rest()

    return run


def totals(counted: DataFrame) -> DataFrame:
    """(lang, total, distinct_ngrams)."""
    return counted.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_ngrams"))


def scaled(n: Column, total: Column) -> Column:
    """A count per million, rounded half up."""
    return F.floor(n * (F.lit(float(SCALE)) / total) + F.lit(0.5)).cast("long")


def normalized(counted: DataFrame, least_ngrams: int = LEAST_NGRAMS, min_count: int = 1) -> DataFrame:
    """(lang, ngram, norm_count) of the languages with enough ngrams; rounded counts below min_count are dropped.

    Zero counts are always dropped: they would make an ngram known that no language has.
    """
    total = F.sum("n").over(Window.partitionBy("lang"))
    rows = counted.withColumn("total", total).where(F.col("total") >= least_ngrams)
    return rows.select("lang", "ngram", scaled(F.col("n"), F.col("total")).alias("norm_count")).where(F.col("norm_count") >= max(1, min_count))


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", max_n: int = T.MAX_N, min_frequency: float = 0.0, least_ngrams: int = LEAST_NGRAMS, binary: bool = False) -> DataFrame:
    """A model set from labelled texts; min_frequency is a share of a language's ngrams."""
    counted = (hashed_counts if binary else counts)(labelled, lang, text, max_n)
    return normalized(counted, least_ngrams, int(min_frequency * SCALE + 0.5))


def prune(models: DataFrame, min_count: int) -> DataFrame:
    """Models without the ngrams below min_count."""
    return models.where(F.col("norm_count") >= min_count)


def prune_report(models: DataFrame, min_count: int) -> DataFrame:
    """(lang, kept, dropped)."""
    keep = F.col("norm_count") >= min_count
    return models.groupBy("lang").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def size(models: DataFrame) -> DataFrame:
    return models.groupBy("lang").agg(F.count(F.lit(1)).alias("ngrams"))


def max_length(models: DataFrame) -> DataFrame:
    """The longest ngram over all models."""
    return models.agg(F.max(F.length("ngram")).alias("max_n"))


def describe(models: DataFrame) -> DataFrame:
    """(lang, description) as in "'deu': 812 ngrams"."""
    return size(models).select("lang", F.format_string("'%s': %d ngrams", "lang", "ngrams").alias("description"))


def lookup(models: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lang, ngram, norm_count) of each wanted (lang, ngram); 0 where the model hasn't it."""
    return wanted.join(models, ["lang", "ngram"], "left").select("lang", "ngram", F.coalesce("norm_count", F.lit(0)).cast("long").alias("norm_count"))


def singletons(models: DataFrame) -> DataFrame:
    """(ngram, lang) of ngrams that a single language has."""
    return models.groupBy("ngram").agg(F.min("lang").alias("lang"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def shared(models: DataFrame) -> DataFrame:
    """(ngram, langs) of ngrams that several languages have."""
    return models.groupBy("ngram").agg(F.count(F.lit(1)).alias("langs")).where("langs > 1")


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two model sets have the same languages, ngrams and counts."""
    columns = ["lang", "ngram", "norm_count"]
    a, b = a.select(*columns), b.select(*columns)
    differing = a.exceptAll(b).unionByName(b.exceptAll(a))
    return differing.agg((F.count(F.lit(1)) == 0).alias("equal"))


def get_model(models: DataFrame, lang: str) -> DataFrame:
    """The model of one language, strictly; an error if there is none."""
    found = models.where(F.col("lang") == lang)
    if found.isEmpty():
        raise ValueError(f"no model for {lang}")
    return found


def has_model(models: DataFrame, wanted: DataFrame, tag: str = "lang") -> DataFrame:
    """(tag, has_model) for each wanted tag: whether some model's language satisfies it."""
    tags = wanted.select(F.col(tag).alias(tag)).distinct()
    there = L.supported(tags, languages(models), tag).select(F.col(tag).alias("__tag")).distinct()
    return tags.join(there, F.col(tag) == F.col("__tag"), "left").select(tag, F.col("__tag").isNotNull().alias("has_model"))


def dump(models: DataFrame, lang: str | None = None) -> DataFrame:
    """(lang, line): the ngrams of each model as lines `ngram<TAB>count`, most frequent first within a language."""
    rows = models if lang is None else get_model(models, lang)
    line = F.concat_ws("\t", F.col("ngram").cast("string"), F.col("norm_count").cast("string")).alias("line")
    return rows.orderBy("lang", F.desc("norm_count"), "ngram").select("lang", line)


def subset(models: DataFrame, langs: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """Models of some languages, or of all but some; an empty list of langs means all."""
    if langs:
        models = models.where(F.col("lang").isin(*langs))
    if without:
        models = models.where(~F.col("lang").isin(*without))
    return models


def union(*sets: DataFrame) -> DataFrame:
    """Model sets or corpora loaded one after the other."""
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out


def languages(corpus: DataFrame, lang: str = "lang") -> DataFrame:
    return corpus.select(F.col(lang).alias("lang")).distinct()


def overlap(models: DataFrame) -> DataFrame:
    """(lang_a, lang_b, shared, either, percent) for each pair of languages: ngrams in both, in either."""
    sizes = size(models)
    a, b = models.select(F.col("lang").alias("lang_a"), "ngram"), models.select(F.col("lang").alias("lang_b"), "ngram")
    both = a.join(b, "ngram").where("lang_a < lang_b").groupBy("lang_a", "lang_b").agg(F.count(F.lit(1)).alias("shared"))
    pairs = sizes.select(F.col("lang").alias("lang_a"), F.col("ngrams").alias("size_a")).crossJoin(sizes.select(F.col("lang").alias("lang_b"), F.col("ngrams").alias("size_b"))).where("lang_a < lang_b")
    rows = pairs.join(both, ["lang_a", "lang_b"], "left").fillna(0, ["shared"])
    either = F.col("size_a") + F.col("size_b") - F.col("shared")
    return rows.select("lang_a", "lang_b", "shared", either.alias("either"), F.round(100.0 * F.col("shared") / either, 6).alias("percent"))


def separability(models: DataFrame, alpha: float) -> DataFrame:
    """(lang_a, lang_b, log_odds): how clearly lang_a's own ngrams tell it from lang_b.

    Each ngram of lang_a speaks as often as a thousandth of the two counts, rounded, with
    the logarithm of the ratio of its shares; the languages start even.
    """
    a = models.select(F.col("lang").alias("lang_a"), "ngram", F.col("norm_count").alias("count_a"))
    b = models.select(F.col("lang").alias("lang_b"), "ngram", F.col("norm_count").alias("count_b"))
    # a row per ngram and other language: languages are few, and a list of them needs no join
    langs = [r.lang for r in models.select("lang").distinct().orderBy("lang").collect()]
    rows = a.withColumn("lang_b", F.explode(F.array(*map(F.lit, langs)) if langs else F.array().cast("array<string>"))).where("lang_a <> lang_b")
    rows = rows.join(b, ["lang_b", "ngram"], "left").fillna(0, ["count_b"])
    total = F.col("count_a") + F.col("count_b")
    times = F.floor(total / F.lit(1000.0) + F.lit(0.5))
    other = F.when(F.col("count_b") == 0, F.lit(alpha)).otherwise(F.col("count_b") / total)
    return rows.groupBy("lang_a", "lang_b").agg(F.round(F.sum(times * (F.log(F.col("count_a") / total) - F.log(other))), 6).alias("log_odds"))
