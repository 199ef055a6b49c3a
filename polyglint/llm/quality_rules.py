"""Quality rules with adaptive thresholds.

Every document gets a few whole-number features.  A mergeable quantile sketch per
language and source gives the quartiles and tails of each feature; fences around them
replace fixed cutoffs.  Sketches of small groups are merged, first over the sources of a
language, then over all languages.  Documents are joined with the fences of their group
and filtered.

The sketch is a histogram on a grid of 32 steps per power of two: values below 64 are
exact, a larger quantile is at most 1/32 too small, its rank is that of its grid cell,
and 896 cells are enough for any value below 2**31.  Sketches merge by adding counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .shared import small, written

#: Features of a text, each a whole number.
FEATURES = ("symbols", "digits", "capitals", "word_length", "repeated_lines")


#: Added to the size of a text in shares, so that a few characters don't make an extreme.
EASE = 30
_KIND = np.full(256, 1, dtype=np.uint8)  # 0 blank, 1 symbol, 2 digit, 3 letter, 4 capital, 5 inside a character
_KIND[[9, 10, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[97:123] = 3
_KIND[192:] = 3
_KIND[65:91] = 4
_KIND[128:192] = 5


def features(texts) -> list[np.ndarray]:
    """The features of each text of an Arrow string array, in the order of FEATURES.

    symbols, digits, capitals (A to Z): thousandths of the non-blank characters plus EASE;
    letters are A to Z in both cases and all characters beyond ASCII.  word_length:
    hundredths of a character per blank-separated word.  repeated_lines: thousandths of
    the non-empty lines that equal an earlier one.  All are 0 for null and empty texts.
    """
    data, offsets = tokens.utf8(texts)
    kind = _KIND[data]

    def counts(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    symbols, digits, capitals = counts(kind == 1), counts(kind == 2), counts(kind == 4)
    solid = counts((kind != 0) & (kind != 5))
    first = kind != 0
    if len(first):
        following = first[:-1].copy()
        following[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(first))] - 1] = False
        first[1:] &= ~following
    words = counts(first)
    distinct, line_bounds = tokens.lines(texts)
    lines = np.diff(line_bounds)
    _, kept = tokens.distinct_per_text(distinct, line_bounds)
    repeated = 1000 * (lines - np.diff(kept)) // np.maximum(lines, 1)
    share = lambda n: (1000 * n // (solid + EASE)).astype(np.int32)
    return [share(symbols), share(digits), share(capitals), (100 * solid // np.maximum(words, 1)).astype(np.int32), repeated.astype(np.int32)]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.slices(batch, "text"):
            found = [pa.array(x, pa.int32()) for x in features(part.column("text"))]
            kept = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in kept], *found], [*kept, *FEATURES])


def cell(value: str) -> str:
    """SQL for the grid cell of a value: its six leading binary digits."""
    shift = f"greatest(0, length(bin({value})) - 6)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def sketches(slim: DataFrame) -> DataFrame:
    """(lang, source, feature, value, n): the sketch of every group as counts per grid cell."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.expr(cell(f)).alias("value")) for f in FEATURES]))
    return slim.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", F.col("p.feature").alias("feature"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups: counts of equal grid cells add up."""
    return sketch.groupBy(*by, "feature", "value").agg(F.sum("n").alias("n"))


#: Quantiles that the fences are made of, in hundredths.
QUANTILES = (25, 75, 95, 99, 100)


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """total and p25, p75, p95, p99, p100 of each group and feature: the smallest cell at or above the rank."""
    by = (*by, "feature")
    running = F.sum("n").over(Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*by))
    ranked = sketch.withColumn("running", running).withColumn("total", total)
    at = [F.min(F.when(F.col("running") * 100 >= F.col("total") * q, F.col("value"))).alias(f"p{q}") for q in QUANTILES]
    return ranked.groupBy(*by).agg(F.max("total").alias("total"), *at)


def fences(sketch: DataFrame, times: int, least: int) -> DataFrame:
    """(lang, source, feature, low, high) of every group, from the finest sketch of at least `least` documents.

    Where the interquartile range is above 0 the fences lie `times` that range from the
    quartiles, the upper one at twice the upper quartile at least.  Where it is 0 there is
    no lower fence, and the upper one lies `times` as far as p95, and as far as p99, at
    least.  Where all of these are 0, so that a value above 0 is one of a few, it lies at
    half the largest value; a group of zeros alone has none, and null says so.
    """
    names = ("total", *[f"p{q}" for q in QUANTILES])
    own = quantiles(sketch, "lang", "source").select("lang", "source", "feature", *[F.col(c).alias(f"own_{c}") for c in names])
    tongue = quantiles(merged(sketch, "lang"), "lang").select("lang", "feature", *[F.col(c).alias(f"lang_{c}") for c in names])
    every = quantiles(merged(sketch)).select("feature", *[F.col(c).alias(f"all_{c}") for c in names])
    joined = own.join(tongue, ["lang", "feature"]).join(every, "feature")
    pick = lambda c: F.when(F.col("own_total") >= least, F.col(f"own_{c}")).when(F.col("lang_total") >= least, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))
    rows = joined.select("lang", "source", "feature", *[pick(c).alias(c) for c in names[1:]])
    spread = F.col("p75") - F.col("p25")
    tail = F.greatest("p75", times * (F.col("p95") - F.col("p75")), F.col("p99") - F.col("p75"))
    up = F.when(spread > 0, F.greatest(times * spread, F.col("p75"))).when(tail > 0, tail).when(F.col("p100") > 0, F.shiftright("p100", 1))
    return rows.select("lang", "source", "feature", F.when(spread > 0, F.col("p25") - times * spread).alias("low"), (F.col("p75") + up).alias("high"))


def judged(docs: DataFrame, times: int = 3, least: int = 50) -> DataFrame:
    """doc_id, lang, source, the features, and `failed`: the features beyond their fences, in order.

    docs needs doc_id, text, lang and source; further columns are ignored, whatever their
    names.  Null language or source form groups of their own, a null doc_id stays null.  A
    null or empty text has all features 0 and is judged like any other; a very long text
    is measured whole.  A value on its fence passes, and equal values are judged alike.
    Repeated rows are judged and counted each; an empty table gives no rows.  A group of
    fewer than `least` documents is judged by the sketch of its language, a language of
    fewer by that of all.
    """
    name = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name("lang").alias("lang"), name("source").alias("source"), F.col("text").cast("string").alias("text"))
    slim = written(slim.mapInArrow(_feature_rows, "doc_id long, lang string, source string, " + ", ".join(f"{f} int" for f in FEATURES)), "features")
    bounds = fences(sketches(slim), times, least)
    wide = bounds.groupBy("lang", "source").agg(*[f(F.when(F.col("feature") == n, F.col(c))).alias(f"{c}_{n}") for n in FEATURES for f, c in ((F.max, "low"), (F.max, "high"))])
    rows = slim.join(small(written(wide, "fences")), ["lang", "source"])
    beyond = [F.when((F.col(n) < F.col(f"low_{n}")) | (F.col(n) > F.col(f"high_{n}")), F.lit(n)) for n in FEATURES]
    raw = lambda c: F.when(F.col(c) != "", F.substring(c, 2, 1 << 30)).alias(c)
    return rows.select("doc_id", raw("lang"), raw("source"), *FEATURES, F.concat_ws(",", *beyond).alias("failed"))


def keep_good(docs: DataFrame, times: int = 3, least: int = 50) -> DataFrame:
    """Ids, groups and features of the documents that stay within all fences; see judged()."""
    return judged(docs, times, least).where("failed = ''").drop("failed")
