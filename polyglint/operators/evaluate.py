"""Evaluation: error rates, confusion, hold-out splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyglint.functions import locale as L


def held_out(key: Column, share: float = 0.2, seed: str = "") -> Column:
    """Whether a row belongs to the held-out part: the same rows on every run."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return place < int(share * 2**32)


def judged(labels: DataFrame, best: DataFrame, key: str = "doc_id", label: str = "label", weak: bool = True) -> DataFrame:
    """labels (key, label) with `predicted` and `miss`; a text without a result is a miss."""
    rows = labels.join(best.select(key, F.col("lang").alias("predicted")), key, "left")
    same = (L.weakly_equal if weak else L.strictly_equal)(L.parse(F.col("predicted")), L.parse(F.col(label)))
    return rows.withColumn("miss", (~F.coalesce(same, F.lit(False))).cast("int"))


def error_rates(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, texts, errors, rate) per language, and over all with a null label."""
    return rows.rollup(label).agg(F.count(F.lit(1)).alias("texts"), F.sum("miss").cast("long").alias("errors"), F.round(F.avg("miss"), 6).alias("rate"))


def error_rate(rows: DataFrame) -> DataFrame:
    """One row: the share of misses."""
    return rows.agg(F.round(F.avg("miss"), 6).alias("rate"))


def confusion(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, predicted, n, share_of_misses), most frequent first; the share is null for hits."""
    counted = rows.groupBy(label, "predicted", "miss").agg(F.count(F.lit(1)).alias("n"))
    misses = F.sum("n").over(Window.partitionBy(label, "miss"))
    share = F.when(F.col("miss") == 1, F.round(F.col("n") / misses, 6))
    return counted.select(label, "predicted", "n", share.alias("share_of_misses")).orderBy(F.desc("n"), label, "predicted")


def spread(rates: DataFrame, rate: str = "rate") -> DataFrame:
    """(least, most, mean, deviation) of a column of rates."""
    return rates.agg(F.min(rate).alias("least"), F.max(rate).alias("most"), F.round(F.avg(rate), 6).alias("mean"), F.round(F.stddev_samp(rate), 6).alias("deviation"))
