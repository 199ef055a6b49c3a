"""Registered queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.functions import locale as L
from polyglint.functions import text as T
from polyglint.functions.sql import register_detection, register_ngrams
from polyglint.operators import corpus as C
from polyglint.operators import detect as D
from polyglint.operators import evaluate as E
from polyglint.operators import model as M
from polyglint.plans import oracle
from polyglint.session import fresh_path, saved, spread
from polyglint.sources import labelled, pages
from polyglint.sources import models as S
from polyglint.streaming import detect as stream

FLAGSHIP = "detect_full"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = oracle.SQL

GRID = [(a, d) for a in (2e-6, 1e-4) for d in (1e-3, 2e-2)]
PRIORS = {"en": 0.5, "de": 0.3, "fr": 0.1, "es": 0.1}
BUDGET = 100_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model set of all documents, stored: it is read more than once."""
    return saved(M.train(docs(spark, sf_dir)), "models")


def six(posterior: str = "posterior") -> Column:
    return F.round(posterior, 6).alias(posterior)


def detected(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return D.detect(docs(spark, sf_dir), trained(spark, sf_dir), **options)


def top(rows: DataFrame, key: str) -> DataFrame:
    return D.best(rows).select(key, "lang", six())


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("label"))
    return E.judged(labels, D.best(detected(spark, sf_dir)))


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged results of a fifth of the documents by a model of the rest."""
    every = docs(spark, sf_dir)
    apart = E.held_out(F.col("doc_id"))
    models, rest = saved(M.train(every.where(~apart)), "models"), every.where(apart)
    return E.judged(rest.select("doc_id", F.col("lang").alias("label")), D.best(D.detect(rest, models)))


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.counts(docs(spark, sf_dir))


@query
def ngram_total_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.totals(M.counts(docs(spark, sf_dir)))


@query
def model_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.train(docs(spark, sf_dir))


@query
def model_min_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.train(docs(spark, sf_dir), min_frequency=2e-5)


@query
def model_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = trained(spark, sf_dir)
    return M.size(models).join(M.describe(models), "lang")


@query
def model_max_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.max_length(M.train(docs(spark, sf_dir)))


@query
def model_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prune_report(M.train(docs(spark, sf_dir)), 20)


@query
def model_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model set differs from its pruned self."""
    models = trained(spark, sf_dir)
    return M.equal(models, M.prune(models, 20))


@query
def ngram_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = trained(spark, sf_dir)
    wanted = T.ngrams(table(spark, sf_dir, "benchmark"), "text", ["item_id"]).select("ngram").distinct()
    return M.lookup(models, F.broadcast(M.languages(models)).crossJoin(wanted))


@query
def ngram_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.singletons(M.train(docs(spark, sf_dir)))


@query
def ngram_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.shared(M.train(docs(spark, sf_dir)))


@query
def ngram_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = trained(spark, sf_dir)
    a, b = (M.subset(models, [x]).select("ngram") for x in ("en", "fr"))
    rows = [(name, df) for name, df in (("union", a.union(b).distinct()), ("intersection", a.intersect(b)), ("difference", a.subtract(b)))]
    return M.union(*[df.agg(F.count(F.lit(1)).alias("ngrams")).select(F.lit(name).alias("operation"), "ngrams") for name, df in rows])


@query
def lang_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overlap(trained(spark, sf_dir))


@query
def lang_separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.separability(trained(spark, sf_dir), D.ALPHA)


@query
def ngram_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.probabilities(M.train(docs(spark, sf_dir))).withColumn("prob", F.round("prob", 9))


@query
def ngram_probability_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.probabilities(M.subset(M.train(docs(spark, sf_dir)), ["en", "fr"])).withColumn("prob", F.round("prob", 9))


@query
def detect_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).withColumn("posterior", six())


@query
def detect_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(detected(spark, sf_dir), "doc_id")


@query
def detect_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(D.detect(table(spark, sf_dir, "benchmark"), trained(spark, sf_dir), "item_id"), "item_id")


@query
def detect_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.margins(detected(spark, sf_dir)).withColumns({c: six(c) for c in ("posterior", "second_posterior")})


@query
def detect_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.round("posterior", 6)
    return D.best(detected(spark, sf_dir)).select("doc_id", "lang", D.confidence(F.col("posterior")).alias("confidence"), D.described(F.col("lang"), p, p).alias("described"))


@query
def detect_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.good(detected(spark, sf_dir)).select("doc_id", "lang")


@query
def detect_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(detected(spark, sf_dir, priors=PRIORS), "doc_id")


@query
def detect_unknown_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.coverage(docs(spark, sf_dir), trained(spark, sf_dir))


@query
def detect_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.early_stop(docs(spark, sf_dir), trained(spark, sf_dir))
    return found.select("doc_id", "rank", "lang", six(), "stopped_at")


@query
def detect_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the detection of the benchmark items."""
    found = D.trace(table(spark, sf_dir, "benchmark"), trained(spark, sf_dir), "item_id")
    return found.select("item_id", "k", "ngram", "lang", six("prob"), six())


@query
def eval_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.error_rates(judged(spark, sf_dir))


@query
def eval_single_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.error_rate(judged(spark, sf_dir))


@query
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(judged(spark, sf_dir))


@query
def eval_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.error_rates(held_out(spark, sf_dir))


@query
def eval_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spread(E.error_rates(held_out(spark, sf_dir)).where("label is not null"))


@query
def tune_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tune(docs(spark, sf_dir), trained(spark, sf_dir), GRID)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag): those of the documents, and some of every kind that the rules know."""
    known = spark.createDataFrame([(t,) for t, *_ in oracle.TAGS], "tag string")
    return docs(spark, sf_dir).select(F.col("lang").alias("tag")).union(known).distinct()


@query
def locale_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tags(spark, sf_dir).withColumn("l", L.parse(F.col("tag")))
    return rows.where("l.lang is not null").select("tag", "l.lang", "l.script", L.name(F.col("l")).alias("name"), L.display(F.col("l")).alias("display"))


@query
def locale_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rejected(tags(spark, sf_dir), "tag")


@query
def locale_weak_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of the known tags."""
    known = spark.createDataFrame([(t, [x[0] for x in oracle.TAGS]) for t, *_ in oracle.TAGS], "result string, target array<string>")
    pairs = known.select("result", F.explode("target").alias("target"))
    a, b = L.parse(F.col("result")), L.parse(F.col("target"))
    pairs = pairs.where(a["lang"].isNotNull() & b["lang"].isNotNull())
    return pairs.select("result", "target", L.weakly_equal(a, b).alias("weakly"), L.strictly_equal(a, b).alias("strictly"))


@query
def model_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some languages the trained set has a model for."""
    wanted = spark.createDataFrame([(t,) for t in oracle.WANTED], "tag string")
    return M.has_model(trained(spark, sf_dir), wanted, "tag")


@query
def model_core_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models saved by tier, and those of the core tier loaded."""
    folder = fresh_path(spark, "tiers")
    S.save(M.train(docs(spark, sf_dir)), folder)
    return S.load_core(spark, folder)


@query
def model_kept_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder without models leaves those at hand as they are."""
    models = trained(spark, sf_dir)
    return S.load_or_keep(spark, fresh_path(spark, "no-models"), models)


@query
def model_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dump(trained(spark, sf_dir))


@query
def sql_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function, called from SQL."""
    register_ngrams(spark)
    return spark.sql("SELECT len, ngram, sum(n) AS n FROM ngram_counts(TABLE(SELECT text FROM {docs}), 3) GROUP BY ALL", docs=spread(docs(spark, sf_dir).select("text")))


@query
def sql_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection function, called from SQL."""
    register_detection(spark, trained(spark, sf_dir))
    return spark.sql("SELECT doc_id, r.lang, round(r.posterior, 6) AS posterior FROM (SELECT doc_id, detect_language(text) AS r FROM {docs})", docs=docs(spark, sf_dir))


@query
def supported_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.supported(docs(spark, sf_dir).select("doc_id", "lang"), M.languages(trained(spark, sf_dir)))


@query
def chunked_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are added one by one: no ngram crosses them."""
    return top(D.detect(table(spark, sf_dir, "conversations"), trained(spark, sf_dir), "conv_id"), "conv_id")


@query
def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunked_detect over the table as a stream."""
    chunks = stream.read_table(spark, f"{sf_dir}/conversations.parquet")
    rows = stream.run_to_end(stream.detect_stream(chunks, trained(spark, sf_dir), "conv_id"), "conv_id")
    best = F.array_min(F.transform("results", lambda r: F.struct((-F.round(r["posterior"], 9)).alias("o"), r["lang"].alias("lang"), r["posterior"].alias("posterior"))))
    return rows.select("conv_id", best.alias("b")).select("conv_id", "b.lang", F.round("b.posterior", 6).alias("posterior"))


@query
def stream_until_sure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream, each read until its language is sure."""
    chunks = stream.read_table(spark, f"{sf_dir}/conversations.parquet")
    rows = stream.run_to_end(stream.detect_until_sure(chunks, trained(spark, sf_dir), "conv_id"), "conv_id", "sure")
    return rows.withColumn("posterior", six())


@query
def conversation_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns joined in order, as one text."""
    joined = T.chunks_in_order(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return top(D.detect(joined, trained(spark, sf_dir), "conv_id"), "conv_id")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", C.declared_language(F.col("html")).alias("declared"), C.page_text(F.col("html")).alias("text"))


@query
def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kept_pages(page_texts(spark, sf_dir))


@query
def pages_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_content(table(spark, sf_dir, "pages")).select("page_id", "content")


@query
def pages_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(table(spark, sf_dir, "pages"))


@query
def pages_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.host(F.col("url")).alias("host"))


@query
def pages_detect_vs_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = page_texts(spark, sf_dir)
    best = D.best(D.detect(texts, trained(spark, sf_dir), "page_id"))
    return texts.select("page_id", "declared").join(best, "page_id").groupBy("declared", F.col("lang").alias("detected")).agg(F.count(F.lit(1)).alias("pages"))


@query
def corpus_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.languages(docs(spark, sf_dir))


@query
def corpus_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_lines(docs(spark, sf_dir))


@query
def corpus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the clean lines of each language."""
    return C.sample_lines(C.clean_lines(docs(spark, sf_dir)), ["lang"], percent=0.1)


@query
def corpus_merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merged_lines(docs(spark, sf_dir))


@query
def lang_char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.char_budget(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), BUDGET)


@query
def lang_budget_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.completed(lang_char_budget(spark, sf_dir), BUDGET)


def two_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each document with a second half in Cyrillic letters, as the tables hold Latin ones only."""
    text = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.concat(text, F.lit("\n"), F.translate(text, *oracle.CYRILLIC)).alias("text"))


@query
def non_latin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.beyond_latin(C.lines(two_scripts(spark, sf_dir), keys=("doc_id",)))


@query
def non_latin_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines beyond Latin with their best and second language, but for English ones."""
    found = C.beyond_latin_report(C.lines(two_scripts(spark, sf_dir), keys=("doc_id",)), trained(spark, sf_dir))
    return found.withColumns({c: six(c) for c in ("posterior", "second_posterior")})


@query
def joaat_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.counts(docs(spark, sf_dir)).select("ngram").distinct().select("ngram", T.joaat(F.col("ngram")).alias("hash"))


@query
def hashed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hashed_counts(docs(spark, sf_dir))


@query
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed models written to binary files and read back."""
    folder = fresh_path(spark, "binary-models")
    S.write_binary(M.train(docs(spark, sf_dir), binary=True), folder)
    return S.read_binary(spark, folder)


@query
def model_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "text-models")
    S.write_text(M.train(docs(spark, sf_dir)), folder)
    return S.read_text(spark, folder)


@query
def model_tier_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models saved by tier and language, and loaded."""
    folder = fresh_path(spark, "tiers")
    S.save(M.train(docs(spark, sf_dir)), folder)
    return S.load(spark, folder)


@query
def labelled_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of a tab-separated file, read back."""
    folder = fresh_path(spark, "labelled")
    labelled.write_tsv(docs(spark, sf_dir), folder)
    return labelled.read_tsv(spark, folder)
