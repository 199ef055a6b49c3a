"""Character normalisation and ngrams as column expressions.

Everything here stays inside the engine's generated code: translate, lower and a few
regular expressions, each linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_N = 4
#: What counts as a blank: ASCII other than letters, some punctuation beyond ASCII, Unicode blanks.
BLANK = (
    r"[\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}\x{BB}\x{AB}\x{BA}\x{B0}\x{2013}\x{2015}\x{2014}\x{201D}\x{201C}\x{2019}\x{2018}"
    r"\x{201A}\x{201B}\x{201E}\x{201F}\x{BD}\x{2026}\x{A0}\x{AD}\x{2022}"
    r"\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
)
#: Scripts of many letters that are told apart by script alone: a class, and the letter that stands for it.
MERGED = (
    (r"[\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}]", "ア"),
    (r"[\x{3040}-\x{309F}]", "あ"),
    (r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}]", "가"),
)

#: No window starts within a character beyond the basic plane, which is two units for the JVM.
WHOLE = r"(?![\x{DC00}-\x{DFFF}])"


def fold(text: Column) -> Column:
    """Lower case per character (no final sigma, no two-character dotted i), with merged scripts."""
    out = F.lower(F.translate(text, "Σİ", "σi"))
    for pattern, letter in MERGED:
        out = F.regexp_replace(out, pattern, letter)
    return out


def normalize(text: Column, complete: bool = True) -> Column:
    """Folded text with single blanks: always one in front, one behind if complete.

    An unfinished text keeps its last blank only where a letter has followed, as a
    further chunk may bring more of them.
    """
    padded = F.concat(F.lit(" "), fold(text), F.lit(" ")) if complete else F.concat(F.lit(" "), fold(text))
    out = F.regexp_replace(padded, BLANK + "+", " ")
    return out if complete else F.when(F.length(out) > 1, F.rtrim(out)).otherwise(out)


def windows(normalized: Column, n: int = MAX_N) -> Column:
    """At each position the next n characters, fewer at the end: its prefixes are all ngrams that start there."""
    return F.regexp_extract_all(normalized, F.lit(f"(?s){WHOLE}(?=(.{{1,{n}}}))"), F.lit(1))


def explode_windows(df: DataFrame, text: str, keys: list[str], n: int = MAX_N) -> DataFrame:
    """(keys..., w): one row per position.  A null text has none."""
    return df.select(*keys, F.explode(windows(normalize(F.col(text)), n)).alias("w"))


def prefixes(df: DataFrame, n: int = MAX_N, w: str = "w") -> DataFrame:
    """df with a row for each prefix of its window: the column `ngram`."""
    lengths = F.sequence(F.lit(1), F.least(F.lit(n), F.length(w)))
    return df.withColumn("ngram", F.explode(F.transform(lengths, lambda k: F.col(w).substr(F.lit(1), k))))


def ngrams(df: DataFrame, text: str, keys: list[str], n: int = MAX_N) -> DataFrame:
    """(keys..., ngram): every ngram occurrence of 1 to n characters."""
    return prefixes(explode_windows(df, text, keys, n), n).drop("w")


def positioned(df: DataFrame, text: str, keys: list[str], n: int = MAX_N) -> DataFrame:
    """(keys..., pos, len, ngram): occurrences with place (from 0) and length; ordered by both as they are read."""
    at = df.select(*keys, F.posexplode(windows(normalize(F.col(text)), n)).alias("pos", "w"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(n), F.length("w")))
    return at.select(*keys, "pos", "w", F.explode(lengths).alias("len")).select(*keys, "pos", "len", F.expr("substr(w, 1, len)").alias("ngram"))


def clipped(df: DataFrame, text: str, keys: list[str], n: int = MAX_N) -> DataFrame:
    """Occurrences as the hashed mode has them: no blank behind, and no short ngrams at the tail.

    Of N characters, those that start at p (from 0) with p <= max(0, N - n + 1).
    """
    normal = df.select(*keys, normalize(F.col(text), complete=False).alias("norm"))
    at = normal.select(*keys, F.length("norm").alias("size"), F.posexplode(windows(F.col("norm"), n)).alias("pos", "w"))
    at = at.where(F.col("pos") <= F.greatest(F.lit(0), F.col("size") - F.lit(n - 1)))
    lengths = F.sequence(F.lit(1), F.least(F.lit(n), F.length("w")))
    return at.select(*keys, "pos", "w", F.explode(lengths).alias("len")).select(*keys, "pos", "len", F.expr("substr(w, 1, len)").alias("ngram"))


def joaat(text: Column) -> Column:
    """One-at-a-time hash of the characters, as a signed 32-bit integer.

    Meant for short strings such as distinct ngrams: it folds over their characters.
    """
    low = F.lit(0xFFFFFFFF)

    def add(h: Column, c: Column) -> Column:
        h = (h + F.ascii(c)).bitwiseAND(low)
        h = (h + F.shiftleft(h, 10)).bitwiseAND(low)
        return h.bitwiseXOR(F.shiftright(h, 6))

    h = F.aggregate(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), F.lit(0).cast("long"), add)
    h = (h + F.shiftleft(h, 3)).bitwiseAND(low)
    h = h.bitwiseXOR(F.shiftright(h, 11))
    h = (h + F.shiftleft(h, 15)).bitwiseAND(low)
    return F.when(h > 0x7FFFFFFF, h - F.lit(0x100000000)).otherwise(h).cast("int")


def chunks_in_order(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys..., text): the chunks of each key joined in order, as if added one by one to one tokenizer.

    Null chunks add nothing.
    """
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias(text))
