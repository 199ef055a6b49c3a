"""Mixing sources to target weights by weighted fair queueing.

Within its source every document, in shuffled order, gets a virtual finish time: the
tokens of its source so far, itself included, divided by the weight of the source.
Documents of all sources are taken in order of finish time until the budget is spent.

Texts are read once, for their size; all else happens on slim rows (where the document
lies, source, shuffle key, tokens), which the documents meet again at the end.  No task
holds a whole source: running sums are taken within slices of the shuffle key and
shifted by the sums of the slices before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import tokens
from .shared import discard, shuffle_partitions, small, written

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 13, 32]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """Blank-separated words of each text; 0 for null."""
    data, offsets = tokens.utf8(texts)
    first = ~_BLANK[data]
    if len(first):
        following = first[:-1].copy()
        cuts = offsets[1:-1]
        following[cuts[(cuts > 0) & (cuts < len(first))] - 1] = False  # a word ends with its text
        first[1:] &= ~following
    total = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


@F.arrow_udf(T.LongType())
def token_count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """word_counts() as a column function."""
    for batch in texts:
        parts = [word_counts(p.column("text")) for p in tokens.slices(pa.RecordBatch.from_arrays([batch], ["text"]), "text")]
        yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))


def shuffle_key(doc_id: Column, seed: str = "", otherwise: Column | None = None) -> Column:
    """Pseudo-random order of documents: the first 15 hex digits of an MD5 of doc_id, or of another string where it is null, as a long."""
    name = F.coalesce(doc_id.cast("string"), F.lit("") if otherwise is None else otherwise)
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), name)), 1, 15), 16, 10).cast("long")


SPAN = 16**15


def _name(source: Column) -> Column:
    """A source as a string that is never null, so that joins and windows share one partitioning."""
    source = source.cast("string")
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def weight_of(name: Column, weights: dict[str | None, float], default: float) -> Column:
    out = F.lit(float(default))
    for source, weight in weights.items():
        if weight <= 0:
            raise ValueError("weights are above 0")
        out = F.when(name == F.lit("" if source is None else f"={source}"), F.lit(float(weight))).otherwise(out)
    return out


def _is_scan(df: DataFrame) -> bool:
    """Whether df's rows are rows of Parquet files, each once: a scan with nothing but columns and filters over it."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.simpleString(50).endswith("parquet")


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with __file and __row, which tell its rows apart and stay the same on every read, and the copy made for it, if any."""
    copy = None if _is_scan(docs) else written(docs, "documents")
    rows = docs if copy is None else copy
    return rows.withColumns({"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")}), copy


def _running(df: DataFrame, slices: int) -> DataFrame:
    """df (source, key, tie, tokens, ...) with `served`: tokens of the source up to the row, itself included."""
    df = df.withColumn("slice", F.floor(F.col("key") / F.lit(SPAN // slices + 1)).cast("int"))
    sums = df.groupBy("source", "slice").agg(F.sum("tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source", "slice", before.alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "slice").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("inside", inside).join(sums, ["source", "slice"])
    return df.withColumn("served", (F.col("before") + F.col("inside")).cast("long")).drop("before", "inside", "slice")


ORDER = ("finish", "key", "tie")


def _place(finish: float, key: int, tie: str) -> Column:
    """A place in the order, to be compared with struct(finish, key, tie)."""
    return F.struct(F.lit(finish).cast("double"), F.lit(key).cast("long"), F.lit(tie))


def _cut(timed: DataFrame, budget: int, bins: int = 1000, few: int = 100_000) -> tuple[float, int, str] | None:
    """Finish time, key and tie of the last document within the budget; None if there is none.

    Sums per bin, of time and then, where many documents have one time, of the key, narrow
    the place of the cut until `few` documents are left; only those are sorted in one
    task, rows of equal time, key and tie being added up before.
    """
    near, before = timed, 0
    for c in ("finish", "key"):
        while True:
            ends = near.agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count(F.lit(1)).alias("n")).first()
            if ends.n <= few or ends.low == ends.high:
                break
            place = F.least(F.floor((F.col(c) - F.lit(ends.low)) / F.lit((ends.high - ends.low) / bins)).cast("long"), F.lit(bins - 1))
            rows = near.groupBy(place.alias("p")).agg(F.sum("tokens").alias("sum"), F.min(c).alias("low"), F.max(c).alias("high"), F.count(F.lit(1)).alias("n")).orderBy("p").collect()
            for row in rows:
                if before + row["sum"] > budget or row is rows[-1]:
                    break
                before += row["sum"]
            near = near.where((F.col(c) >= row.low) & (F.col(c) <= row.high))
        if ends.n <= few:
            break
    order = F.struct(*ORDER)
    apart = near.groupBy(*ORDER).agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    last = apart.withColumn("sum", running).where(F.col("sum") + F.lit(before) <= budget).agg(F.max(order).alias("m")).first().m
    if last is None:
        start = near.agg(F.min(order).alias("m")).first().m
        last = None if start is None else timed.where(order < _place(*start)).agg(F.max(order).alias("m")).first().m
    return None if last is None else tuple(last)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, default_weight: float = 1.0, budget: int | None = None, budget_share: float = 0.9, seed: str = "", slices: int | None = None, ordered: bool = True) -> DataFrame:
    """docs within the budget, with tokens and virtual_finish, in global order of finish time if `ordered`.

    docs needs doc_id, text and source; its other columns stay (own ones named tokens or
    virtual_finish are replaced).  A null source is a source of its own.  A null or blank
    text has no tokens: it costs nothing and takes the finish time of its predecessor; a
    very long text is counted whole.  A null doc_id is shuffled by its text.  Documents of
    equal time follow the shuffle key, then text; the budget, by default budget_share of all tokens, is kept strictly: the first
    document beyond it ends the mix.  Repeated rows are documents of their own.  An empty
    table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    slices = slices or max(16, 4 * shuffle_partitions(spark))
    columns = [c for c in docs.columns if c not in ("tokens", "virtual_finish")]
    placed, _ = _placed(docs)
    text = F.col("text").cast("string")
    tie = F.md5(F.coalesce(text, F.lit("")))
    # documents without an id are shuffled by their texts, so that many of them don't share a place
    own = [_name(F.col("source")).alias("source"), shuffle_key(F.col("doc_id"), seed, tie).alias("key"), tie.alias("tie"), token_count(text).alias("tokens")]
    slim = written(placed.select("__file", "__row", *own), "sizes")
    weight = weight_of(F.col("source"), weights or {}, default_weight)
    timed = written(_running(slim, slices).select("__file", "__row", "key", "tie", "tokens", (F.col("served") / weight).alias("finish")), "mix")
    discard(slim)
    within = F.lit(True)
    if budget is not None or budget_share < 1:
        if budget is None:
            budget = int((timed.agg(F.sum("tokens").alias("t")).first().t or 0) * budget_share)
        cut = _cut(timed, budget)
        within = F.lit(False) if cut is None else F.struct(*ORDER) <= _place(*cut)
    kept = timed.where(within).withColumnsRenamed({c: f"__{c}" for c in (*ORDER, "tokens")})
    rows = placed.select(*[f"`{c}`" for c in columns], "__file", "__row").join(small(kept), ["__file", "__row"])
    if ordered:
        rows = rows.orderBy("__finish", "__key", "__tie")
    return rows.select(*[f"`{c}`" for c in columns], F.col("__tokens").alias("tokens"), F.col("__finish").alias("virtual_finish"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix with the columns of docs only; see mix()."""
    columns = docs.columns
    return mix(docs, **options).select(*[F.col(f"`{c}`") for c in columns])


def in_fair_order(docs: DataFrame, **options) -> DataFrame:
    """All of docs by finish time.

    Of documents that are a mix, the finish times are those that they had in it, as each
    source kept its first ones: so a stored mix, whose order a reader of files may lose,
    is put in order again.
    """
    return mixed_documents(docs, budget_share=1.0, **options)
