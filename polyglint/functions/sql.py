"""Functions that SQL can call: register() adds them to a session.

    SELECT normalize_text(t)
    SELECT d.doc_id, g.* FROM docs d, LATERAL ngrams(d.text, 3) g
    SELECT len, ngram, sum(n) FROM ngram_counts(TABLE(SELECT text FROM docs), 3) GROUP BY ALL
    SELECT doc_id, detect_language(text).lang FROM docs
    SELECT doc_id, detect_languages(text) FROM docs
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.functions import vector as V
from polyglint.functions.text import BLANK, MAX_N, MERGED, WHOLE
from polyglint.operators import detect as D

_RESULT = "struct<lang: string, posterior: double>"


def _folded(text: str) -> str:
    out = f"lower(translate({text}, 'Σİ', 'σi'))"
    for pattern, letter in MERGED:
        out = f"regexp_replace({out}, r'{pattern}', '{letter}')"
    return out


class NgramCounts:
    """Counts the windows of a partition's texts, and splits into ngrams those that differ."""

    def __init__(self) -> None:
        self.windows = V.Tally(["w"])

    def eval(self, texts: pa.RecordBatch, n: pa.Array) -> Iterator[pa.RecordBatch]:
        self.n = n[0].as_py()
        for part in V.pieces(pa.RecordBatch.from_arrays([texts.column(0).cast(pa.string())], ["t"]), "t"):
            windows, counts = V.window_counts(part.column("t"), self.n)
            for batch in self.windows.add(pa.table({"w": pa.array(windows, pa.string()), "n": pa.array(counts, pa.int64())})):
                yield from self.split(batch)

    def terminate(self) -> Iterator[pa.RecordBatch]:
        for batch in self.windows.rest():
            yield from self.split(batch)

    def split(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = pc.utf8_length(batch.column("w"))
        for k in range(1, self.n + 1):
            part = batch.filter(pc.greater_equal(size, k))
            sums = V.Tally(["ngram"], part.num_rows)
            for found in (*sums.add(pa.table({"ngram": pc.utf8_slice_codeunits(part.column("w"), 0, k), "n": part.column("n")})), *sums.rest()):
                yield pa.RecordBatch.from_arrays([pa.array([k] * found.num_rows, pa.int32()), found.column("ngram"), found.column("n")], ["len", "ngram", "n"])


def register_ngrams(spark: SparkSession) -> None:
    """normalize_text(t), and the table functions ngrams(t, n): pos from 0, len and ngram of every occurrence, and ngram_counts(TABLE(...), n): len, ngram and n.

    The first two are SQL themselves and run in generated code.  A row for every occurrence
    is many times the text, so what only counts ngrams should call ngram_counts: it takes a
    table of one column of texts, counts them batch by batch where they lie, and gives
    partial counts, which are to be summed.  A null text has no ngrams.
    """
    spark.udtf.register("ngram_counts", F.arrow_udtf(NgramCounts, returnType="len int, ngram string, n long"))
    normal = f"regexp_replace(concat(' ', {_folded('t')}, ' '), r'{BLANK}+', ' ')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(t STRING) RETURNS STRING RETURN {normal}")
    # one generator over nested arrays: with two the engine would join each text with itself
    each = "transform(sequence(1, length(w)), l -> struct(i, l, substr(w, 1, l)))"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION ngrams(t STRING, n INT) RETURNS TABLE (pos INT, len INT, ngram STRING)
        RETURN SELECT g.pos, g.len, g.ngram FROM
            (SELECT inline(flatten(transform(regexp_extract_all({normal}, concat(r'(?s){WHOLE}(?=(.{{1,', n, '}}))'), 1), (w, i) -> {each}))) AS (pos, len, ngram)) g""")


def register_detection(spark: SparkSession, models: DataFrame, alpha: float = D.ALPHA, dampening: float = D.DAMPENING, n: int = MAX_N, limit: int = D.MODEL_BYTES) -> None:
    """detect_language(t), the best language, and detect_languages(t), all of at least LEAST_POSTERIOR, best first.

    Both give results for every text; one that is null, or without known ngrams, has equal
    posteriors for all languages.  The model set must fit workers; more than `limit` bytes
    is an error, and D.detect the way for such a set.
    """
    langs = D.language_list(models)
    table = D.held_gains(models, langs, alpha, dampening, n, limit)
    if table is None:
        raise ValueError(f"the model set has more than {limit} bytes")
    shared, base, names = spark.sparkContext.broadcast(table.along_prefixes()), D.floor_of(alpha, dampening), np.array(langs, dtype=object)

    def results(texts: pa.Array, least: float) -> list[list[dict]]:
        out = []
        for part in V.pieces(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            _, sums = shared.value.sums(part.column("t"))
            if not len(names):
                out += [[]] * len(sums)
                continue
            scores = sums[:, :1] * base + sums[:, 1:]
            weights = np.exp(scores - scores.max(axis=1, keepdims=True))
            weights /= weights.sum(axis=1, keepdims=True)
            # languages are in order, so a stable sort leaves equal ones in it
            order = np.argsort(-np.round(weights, 9), axis=1, kind="stable")
            out += [[{"lang": names[i], "posterior": float(w[i])} for i in o if w[i] >= least] for o, w in zip(order, weights)]
        return out

    least, kind, kinds = D.LEAST_POSTERIOR, pa.struct([("lang", pa.string()), ("posterior", pa.float64())]), _RESULT

    @F.arrow_udf(kinds)
    def detect_language(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([r[0] if r else None for r in results(batch, 0.0)], kind)

    @F.arrow_udf(f"array<{kinds}>")
    def detect_languages(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(results(batch, least), pa.list_(kind))

    spark.udf.register("detect_language", detect_language)
    spark.udf.register("detect_languages", detect_languages)


def register(spark: SparkSession, models: DataFrame, **options) -> None:
    """All functions of this module; see register_ngrams() and register_detection()."""
    register_ngrams(spark)
    register_detection(spark, models, **options)
