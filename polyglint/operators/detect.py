"""Language detection: naive Bayes over ngrams in log space.

p(lang | ngram) is the share of a language in the counts of an ngram.  A text's score for a
language is the sum of log p over its known ngrams, where p is dampened towards 1 and
languages without the ngram get alpha; the posterior is the softmax over languages.

Every known ngram adds log f to all languages, with f the dampened alpha; a language that
has the ngram gains log p - log f on top.  Sums, softmax and order of a text's languages
are columns of one row per text, so that detection has one small shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyglint.functions import text as T
from polyglint.functions import vector as V
from polyglint.operators.lookup import DENSE_COLUMNS, Lookup, Reader, Sparse
from polyglint.session import discard, fits, saved, spread

ALPHA = 2e-6
DAMPENING = 1e-3
#: Results below this posterior are left out.
LEAST_POSTERIOR = 0.1
#: A posterior above this is good enough to stop for.
GOOD_POSTERIOR = 0.99
#: Known ngrams between two looks at the leading language.
CHECK_EVERY = 110
#: A table of ngrams of more bytes than this isn't brought to the workers.
MODEL_BYTES = 256 << 20


def probabilities(models: DataFrame) -> DataFrame:
    """(ngram, lang, prob): the share of each loaded language in an ngram's counts."""
    total = F.sum("norm_count").over(Window.partitionBy("ngram"))
    return models.select("ngram", "lang", (F.col("norm_count") / total).alias("prob"))


def dampened(prob: Column, dampening: float) -> Column:
    return prob + (F.lit(1.0) - prob) * F.lit(dampening)


def floor_of(alpha: float, dampening: float) -> float:
    """log of the dampened alpha."""
    return math.log(alpha + (1.0 - alpha) * dampening)


def gains(probs: DataFrame, alpha: float = ALPHA, dampening: float = DAMPENING) -> DataFrame:
    """(ngram, lang, gain): log p - log f of each matching row."""
    return probs.select("ngram", "lang", (F.log(dampened(F.col("prob"), dampening)) - F.lit(floor_of(alpha, dampening))).alias("gain"))


def wide(gained: DataFrame, langs: list[str]) -> DataFrame:
    """(ngram, known, g0, g1, ...): one row per ngram with the gain of each language, 0 where it hasn't the ngram."""
    each = [F.coalesce(F.sum(F.when(F.col("lang") == l, F.col("gain"))), F.lit(0.0)).alias(f"g{i}") for i, l in enumerate(langs)]
    return gained.groupBy("ngram").agg(F.lit(1.0).alias("known"), *each)


def held(table: DataFrame, columns: list[str], n: int = T.MAX_N, limit: int = MODEL_BYTES) -> Lookup | None:
    """table (ngram, columns...) as workers hold it; None where it has more than `limit` bytes.

    It is stored first, so that its size is known before any of it comes to the driver.
    """
    stored = saved(table.select("ngram", *columns), "ngrams")
    try:
        if not fits(stored, limit):
            return None
        rows = stored.toArrow()
    finally:
        discard(stored)
    values = np.stack([rows.column(c).to_numpy() for c in columns], axis=1) if columns else np.zeros((rows.num_rows, 0))
    return Lookup(rows.column("ngram").to_pylist(), values, n)


def held_gains(models: DataFrame, langs: list[str], alpha: float, dampening: float, n: int = T.MAX_N, limit: int = MODEL_BYTES, known: bool = True) -> Lookup | None:
    """The gains of a model set as workers hold them: a column that is 1 for every ngram, if `known`, and one per language.

    None where the rows of gains, one per ngram and language that has it, take more than
    `limit` bytes; they are stored first, so that this is known before any of them comes to
    the driver.
    """
    stored = saved(gains(probabilities(models), alpha, dampening).where(F.col("lang").isin(*langs) if langs else F.lit(False)), "gains")
    try:
        if not fits(stored, limit):
            return None
        table = stored.toArrow().combine_chunks()
    finally:
        discard(stored)
    names = table.column("ngram").combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    row = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = {l: k for k, l in enumerate(langs)}
    column = np.array([place[l] for l in table.column("lang").to_pylist()], dtype=np.int64) + int(known)
    value, rows, columns = table.column("gain").to_numpy(), len(names.dictionary), len(langs) + int(known)
    if known:
        row, column, value = np.concatenate([np.arange(rows), row]), np.concatenate([np.zeros(rows, np.int64), column]), np.concatenate([np.ones(rows), value])
    if columns > DENSE_COLUMNS:
        return Lookup(names.dictionary.to_pylist(), Sparse(row, column, value, rows, columns), n)
    matrix = np.zeros((rows, columns))
    matrix[row, column] = value
    return Lookup(names.dictionary.to_pylist(), matrix, n)


def summed(docs: DataFrame, table: Lookup, columns: list[str], key: str, text: str) -> DataFrame:
    """(key, ngrams, columns...): sums over each text's ngrams of a table that workers hold, given with sums along prefixes."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.pieces(batch, "__text"):
                count, sums = shared.value.sums(part.column("__text"))
                yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(count, pa.int64()), *[pa.array(sums[:, k]) for k in range(len(columns))]], ["__key", "ngrams", *columns])

    kind = dict(docs.dtypes)[key]
    rows = spread(docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")))
    rows = rows.mapInArrow(run, f"__key {kind}, ngrams long" + "".join(f", `{c}` double" for c in columns))
    return rows.groupBy(F.col("__key").alias(key)).agg(F.coalesce(F.sum("ngrams"), F.lit(0)).alias("ngrams"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns])


def text_sums(docs: DataFrame, table: DataFrame, columns: list[str], key: str, text: str, n: int = T.MAX_N, limit: int = MODEL_BYTES) -> DataFrame:
    """(key, ngrams, columns...): sums of table's columns over all ngram occurrences of each text.

    Up to `limit` bytes the table is broadcast with its sums along prefixes: a position of
    a text looks up the longest known ngram that starts there, so that text rows are
    neither multiplied nor shuffled, and only one sum per text leaves a task.  A larger
    table meets the distinct windows of each text in a shuffled join.  Null texts have no
    ngrams and sums of 0; a key that occurs in several rows gets the sum of its rows.
    """
    small = held(table, columns, n, limit)
    if small is not None:
        return summed(docs, small.along_prefixes(), columns, key, text)
    return joined_sums(docs, table, columns, key, text, n)


def joined_sums(docs: DataFrame, table: DataFrame, columns: list[str], key: str, text: str, n: int = T.MAX_N) -> DataFrame:
    """text_sums() for a table of any size: the distinct windows of each text meet it in a shuffled join."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    windows = spread(docs.select(key, text)).select(key, F.explode_outer(T.windows(T.normalize(F.col(text)), n)).alias("w"))
    terms = windows.groupBy(key, "w").agg(F.count("w").alias("tf"))
    met = T.prefixes(terms.select("w").distinct(), n).join(table, "ngram").groupBy("w").agg(*[F.sum(c).alias(c) for c in columns])
    rows = terms.join(met, "w", "left")
    return rows.groupBy(key).agg(F.coalesce(F.sum(F.col("tf") * F.length("w")), F.lit(0)).alias("ngrams"), *[total(F.col("tf") * F.col(c)).alias(c) for c in columns])


def language_list(models: DataFrame) -> list[str]:
    """The languages of a model set, in order; they are few."""
    return [r.lang for r in models.select("lang").distinct().orderBy("lang").collect()]


def softmax(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """rows with `posterior` over each key."""
    by = Window.partitionBy(*keys)
    top = F.max(score).over(by)
    weight = F.exp(F.col(score) - F.col("__top"))
    rows = rows.withColumn("__top", top).withColumn("__weight", weight)
    return rows.withColumn("posterior", F.col("__weight") / F.sum("__weight").over(by)).drop("__top", "__weight")


def judged_texts(docs: DataFrame, models: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, dampening: float = DAMPENING, n: int = T.MAX_N, priors: dict[str, float] | None = None, limit: int = MODEL_BYTES) -> DataFrame:
    """(key, ngrams, known, results): one row per text, results an array of (lang, score, posterior).

    A text without known ngrams, null ones included, has equal posteriors.  priors replace
    the uniform ones; a language without a prior above 0 is left out.  Rows of equal key
    count as one text.
    """
    every = language_list(models)
    langs = [l for l in every if priors is None or priors.get(l, 0) > 0]
    columns = ["known", *[f"g{i}" for i in range(len(langs))]]
    # priors leave languages out of the results, not out of the ngrams that are known
    small = held_gains(models, every, alpha, dampening, n, limit)
    if small is not None:
        rows = summed(docs, small.along_prefixes(), ["known", *[f"g{langs.index(l)}" if l in langs else f"x{k}" for k, l in enumerate(every)]], key, text).select(key, "ngrams", *columns)
    else:
        rows = joined_sums(docs, wide(gains(probabilities(models), alpha, dampening), langs), columns, key, text, n)
    base = floor_of(alpha, dampening)
    prior = [0.0 if priors is None else math.log(priors[l]) for l in langs]
    rows = rows.select(key, "ngrams", F.col("known").cast("long").alias("known"), *[(F.col("known") * base + F.col(f"g{i}") + F.lit(p)).alias(f"g{i}") for i, p in enumerate(prior)])
    if not langs:
        return rows.select(key, "ngrams", "known", F.array().cast("array<struct<lang:string,score:double,posterior:double>>").alias("results"))
    scores = F.array(*[F.col(f"g{i}") for i in range(len(langs))])
    return rows.select(key, "ngrams", "known", _results(scores, langs).alias("results"))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: in a column of columns of sums, copies of it would multiply."""
    return F.transform(F.array(value), body)[0]


def _results(scores: Column, langs: list[str]) -> Column:
    """An array of (lang, score, posterior): the softmax of an array of scores in the order of langs."""
    names = F.array(*map(F.lit, langs))

    def softmax_of(s: Column) -> Column:
        weights = _let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
        shares = _let(weights, lambda w: _let(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda whole: F.transform(w, lambda x: x / whole)))
        return F.transform(F.arrays_zip(s.alias("score"), shares.alias("posterior")), lambda r, i: F.struct(F.get(names, i).alias("lang"), r["score"].alias("score"), r["posterior"].alias("posterior")))

    return _let(scores, softmax_of)


def posteriors(docs: DataFrame, models: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, lang, known, score, posterior) for every text and every language."""
    rows = judged_texts(docs, models, key, text, **options)
    return rows.select(key, "known", F.explode("results").alias("r")).select(key, "r.lang", "known", "r.score", "r.posterior")


def ranked(found: DataFrame, key: str = "doc_id", least: float = LEAST_POSTERIOR) -> DataFrame:
    """(key, rank, lang, posterior): results from `least` on, best first; equal ones by language."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("posterior", 9)), "lang"))
    return found.where(F.col("posterior") >= least).select(key, rank.alias("rank"), "lang", "posterior")


def detect(docs: DataFrame, models: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST_POSTERIOR, **options) -> DataFrame:
    """(key, rank, lang, posterior): the flagship operator.

    Best first, equal ones by language; the languages of a text are sorted within its row.
    """
    order = lambda r: F.struct((-F.round(r["posterior"], 9)).alias("o"), r["lang"].alias("lang"), r["posterior"].alias("posterior"))
    rows = judged_texts(docs, models, key, text, **options)
    sure = F.sort_array(F.transform(F.filter("results", lambda r: r["posterior"] >= least), order))
    return rows.select(key, F.posexplode(sure).alias("pos", "r")).select(key, (F.col("pos") + 1).alias("rank"), "r.lang", "r.posterior")


def best(results: DataFrame) -> DataFrame:
    return results.where("rank = 1").drop("rank")


def margins(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang, posterior, second_lang, second_posterior): the best with its runner-up, if there is one."""
    by = Window.partitionBy(key).orderBy("rank")
    rows = results.where("rank <= 2").withColumn("second_lang", F.lead("lang").over(by)).withColumn("second_posterior", F.lead("posterior").over(by))
    return rows.where("rank = 1").drop("rank")


def good(results: DataFrame) -> DataFrame:
    return results.where(F.col("posterior") > GOOD_POSTERIOR)


def confidence(posterior: Column) -> Column:
    """HIGH above 0.9, MEDIUM above 0.7, LOW above 0, else NONE."""
    return F.when(posterior > 0.9, "HIGH").when(posterior > 0.7, "MEDIUM").when(posterior > 0, "LOW").otherwise("NONE")


def described(lang: Column, posterior: Column, sure: Column) -> Column:
    """One result as a sentence."""
    return F.format_string("Language '%s' with score %f and confidence %f", lang, posterior, sure)


def coverage(docs: DataFrame, models: DataFrame, key: str = "doc_id", text: str = "text", n: int = T.MAX_N) -> DataFrame:
    """(key, known, unknown): ngram occurrences that some model has, and that none has."""
    table = models.select("ngram").distinct().withColumn("known", F.lit(1.0))
    sums = text_sums(docs, table, ["known"], key, text, n)
    return sums.select(key, F.col("known").cast("long").alias("known"), (F.col("ngrams") - F.col("known")).cast("long").alias("unknown"))


def known_in_order(docs: DataFrame, models: DataFrame, key: str, text: str, n: int = T.MAX_N) -> DataFrame:
    """(key, k, ngram): the known ngrams of each text as they are read, numbered from 1."""
    vocabulary = models.select("ngram").distinct()
    rows = T.positioned(docs, text, [key], n).join(vocabulary, "ngram")
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("pos", "len")).alias("k"), "ngram")


def reader(models: DataFrame, langs: list[str], every: int = CHECK_EVERY, alpha: float = ALPHA, dampening: float = DAMPENING, n: int = T.MAX_N, limit: int = MODEL_BYTES) -> Reader | None:
    """What reads texts until their language is sure; None for a model set of more than `limit` bytes."""
    small = held_gains(models, langs, alpha, dampening, n, limit, known=False)
    return None if small is None else Reader(small, floor_of(alpha, dampening), every, GOOD_POSTERIOR)


def stops(batches: Iterator[pa.RecordBatch], small: Reader) -> Iterator[pa.RecordBatch]:
    """(key, stopped_at, scores) of batches (key, t), in pieces: of a batch only one is at hand as strings."""
    for batch in batches:
        for part in V.pieces(batch, "t"):
            found = [small.read(x) for x in part.column("t").to_pylist()]
            scores = [small.scores(f).tolist() for f in found]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([f[0] for f in found], pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=["key", "stopped_at", "scores"])


def early_stop(docs: DataFrame, models: DataFrame, key: str = "doc_id", text: str = "text", every: int = CHECK_EVERY, alpha: float = ALPHA, dampening: float = DAMPENING, n: int = T.MAX_N, limit: int = MODEL_BYTES) -> DataFrame:
    """(key, rank, lang, posterior, stopped_at): detection that stops once it is sure.

    After each `every` known ngrams the language above GOOD_POSTERIOR is noted; when two
    looks in a row agree the rest of the text is not read.  stopped_at counts the known
    ngrams that were read, all of them where it never stops.  A text is read in order and
    block by block, so this is one vectorised pass without a shuffle over a model set of
    up to `limit` bytes, whose size is checked; a larger one is joined.
    """
    langs = language_list(models)
    small = reader(models, langs, every, alpha, dampening, n, limit) if langs else None
    if small is None:
        return early_stop_joined(docs, models, key, text, every, alpha, dampening, n)
    shared = docs.sparkSession.sparkContext.broadcast(small)

    kind = dict(docs.dtypes)[key]
    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")))
    rows = rows.mapInArrow(lambda batches: stops(batches, shared.value), f"key {kind}, stopped_at long, scores array<double>")
    each = F.transform(_results(F.col("scores"), langs), lambda r: F.struct((-F.round(r["posterior"], 9)).alias("o"), r["lang"].alias("lang"), r["posterior"].alias("posterior")))
    sure = F.array_sort(F.filter(each, lambda r: r["posterior"] >= LEAST_POSTERIOR))
    return rows.select("key", "stopped_at", F.posexplode(sure).alias("pos", "r")).select(F.col("key").alias(key), (F.col("pos") + 1).alias("rank"), "r.lang", "r.posterior", "stopped_at")


def early_stop_joined(docs: DataFrame, models: DataFrame, key: str = "doc_id", text: str = "text", every: int = CHECK_EVERY, alpha: float = ALPHA, dampening: float = DAMPENING, n: int = T.MAX_N) -> DataFrame:
    """early_stop for a model set of any size: joins, and sums over the steps of each text."""
    base = floor_of(alpha, dampening)
    ordered = known_in_order(docs, models, key, text, n).select(key, "ngram", F.ceil(F.col("k") / every).cast("int").alias("step"))
    terms = ordered.groupBy(key, "step", "ngram").agg(F.count(F.lit(1)).alias("tf"))
    gained = gains(probabilities(models), alpha, dampening)
    langs = models.select("lang").distinct()
    per_step = terms.groupBy(key, "step").agg(F.sum("tf").alias("seen"))
    sums = terms.join(gained, "ngram").groupBy(key, "step", "lang").agg(F.sum(F.col("tf") * F.col("gain")).alias("gain"))
    rows = per_step.crossJoin(F.broadcast(langs)).join(sums, [key, "step", "lang"], "left")
    so_far = Window.partitionBy(key, "lang").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("read", F.sum("seen").over(so_far)).withColumn("gain", F.sum(F.coalesce("gain", F.lit(0.0))).over(so_far))
    rows = softmax(rows.withColumn("score", F.col("read") * F.lit(base) + F.col("gain")), [key, "step"])
    # looks happen after full steps only
    sure = F.max(F.when((F.col("posterior") > GOOD_POSTERIOR) & (F.col("read") == F.col("step") * every), F.col("lang")))
    looks = rows.groupBy(key, "step").agg(sure.alias("leader"))
    before = F.lag("leader").over(Window.partitionBy(key).orderBy("step"))
    stops = looks.withColumn("before", before).groupBy(key).agg(F.min(F.when(F.col("leader") == F.col("before"), F.col("step"))).alias("stop"), F.max("step").alias("last"))
    ends = stops.select(key, F.coalesce("stop", "last").alias("step"))
    final = rows.join(ends, [key, "step"])
    silent = docs.select(key).distinct().join(stops.select(key), key, "left_anti").crossJoin(F.broadcast(langs))
    silent = softmax(silent.withColumn("score", F.lit(0.0)), [key]).withColumn("read", F.lit(0).cast("long"))
    both = final.select(key, "lang", "posterior", "read").unionByName(silent.select(key, "lang", "posterior", "read"))
    result = ranked(both, key)
    return result.join(both.select(key, F.col("read").alias("stopped_at")).distinct(), key)


def trace(docs: DataFrame, models: DataFrame, key: str = "doc_id", text: str = "text", langs: list[str] | None = None, alpha: float = ALPHA, dampening: float = DAMPENING, least: float = 5e-7, n: int = T.MAX_N) -> DataFrame:
    """(key, k, ngram, lang, prob, posterior): after each known ngram, its probability and the running posterior.

    prob is null where the language hasn't the ngram.  Rows with a posterior below `least`
    are left out; langs keeps some languages in the report, after the posterior over all.
    """
    ordered = known_in_order(docs, models, key, text, n)
    every = models.select("lang").distinct()
    rows = ordered.crossJoin(F.broadcast(every)).join(probabilities(models), ["ngram", "lang"], "left")
    one = F.log(dampened(F.coalesce("prob", F.lit(alpha)), dampening))
    so_far = Window.partitionBy(key, "lang").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = softmax(rows.withColumn("score", F.sum(one).over(so_far)), [key, "k"])
    if langs:
        rows = rows.where(F.col("lang").isin(*langs))
    return rows.where(F.col("posterior") >= least).select(key, "k", "ngram", "lang", "prob", "posterior")


def tune(docs: DataFrame, models: DataFrame, grid: list[tuple[float, float]], key: str = "doc_id", text: str = "text", label: str = "lang", n: int = T.MAX_N) -> DataFrame:
    """(alpha, dampening, texts, errors) for each (alpha, dampening) of the grid.

    Texts are read once: the grid only adds columns to the table of ngrams.
    """
    langs = language_list(models)
    probs = probabilities(models)
    tables, columns = [], []
    for k, (alpha, dampening) in enumerate(grid):
        table = wide(gains(probs, alpha, dampening), langs).drop("known")
        names = [f"g{k}_{i}" for i in range(len(langs))]
        tables.append(table.toDF("ngram", *names))
        columns += names
    table = tables[0]
    for more in tables[1:]:
        table = table.join(more, "ngram")
    labels = docs.select(key, F.col(label).alias("label"))
    sums = text_sums(docs, table, columns, key, text, n)
    # the number of known ngrams is the same for all languages, so it can't change the best one
    tops = []
    for k, (alpha, dampening) in enumerate(grid):
        each = F.array(*[F.struct((-F.round(f"g{k}_{i}", 6)).alias("o"), F.lit(l).alias("lang")) for i, l in enumerate(langs)])
        tops.append(F.struct(F.lit(float(alpha)).alias("alpha"), F.lit(float(dampening)).alias("dampening"), F.array_min(each)["lang"].alias("lang")))
    rows = sums.select(key, F.explode(F.array(*tops)).alias("t")).join(labels, key)
    miss = (~F.coalesce(F.col("t.lang") == F.col("label"), F.lit(False))).cast("int")
    return rows.groupBy("t.alpha", "t.dampening").agg(F.count(F.lit(1)).alias("texts"), F.sum(miss).alias("errors"))
