"""Detection of texts that arrive in pieces."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from polyglint.operators import detect as D
from polyglint.session import discard, fits, fresh_path, saved


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream."""
    static = spark.read.parquet(path)
    folders = {os.path.dirname(f) for f in static.inputFiles()}
    name = os.path.basename(path)
    stream = spark.readStream.schema(static.schema)
    if all(os.path.basename(f) == name for f in folders):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", name).parquet(os.path.dirname(path))


def run_to_end(results: DataFrame, key: str, what: str = "stream") -> DataFrame:
    """All that a stream of updates comes to: the last row of each key, once the input at hand is read.

    Updates are written batch by batch, a repeated batch over itself, so a restart loses
    and doubles nothing.
    """
    spark = results.sparkSession
    path, checkpoint = fresh_path(spark, what), fresh_path(spark, f"{what}-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = results.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    names = results.columns
    try:
        updates = spark.read.schema(StructType([*results.schema.fields, StructField("batch", IntegerType())])).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], results.schema)
    last = updates.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("r"))
    return last.select(*[F.col(f"r.{n}").alias(n) for n in names])


def detect_stream(chunks: DataFrame, models: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ngrams, known, results) of a stream of chunks, updated as they come; no ngram crosses chunks."""
    return D.judged_texts(chunks, models, key, text)


class Detector:
    """One text at a time, in pieces, with early stop; the sequential twin of the batch operators."""

    def __init__(self, gains: dict[str, dict[str, float]], langs: list[str], max_n: int = 4, base: float = D.floor_of(D.ALPHA, D.DAMPENING), every: int = D.CHECK_EVERY) -> None:
        self.gains, self.langs, self.max_n, self.base, self.every = gains, langs, max_n, base, every
        self.reset()

    def reset(self) -> None:
        self.known, self.sums, self.leader, self.enough = 0, dict.fromkeys(self.langs, 0.0), None, False

    def posteriors(self) -> dict[str, float]:
        top = max(self.sums.values(), default=0.0)
        weights = {l: math.exp(s - top) for l, s in self.sums.items()}
        whole = sum(weights.values())
        return {l: w / whole for l, w in weights.items()}

    def has_enough_text(self) -> bool:
        return self.enough

    def add_normalized(self, norm: str) -> None:
        """A chunk whose characters are normalised already."""
        for at in range(len(norm)):
            for n in range(1, min(self.max_n, len(norm) - at) + 1):
                if self.enough:
                    return
                found = self.gains.get(norm[at : at + n])
                if found is None:
                    continue
                self.known += 1
                for lang, gain in found.items():
                    self.sums[lang] += gain
                if self.known % self.every == 0:
                    lang, best = max(self.posteriors().items(), key=lambda x: x[1])
                    leader = lang if best > D.GOOD_POSTERIOR else None
                    self.enough = leader is not None and leader == self.leader
                    self.leader = leader

    def detect(self, least: float = D.LEAST_POSTERIOR) -> list[tuple[str, float]]:
        found = [(l, p) for l, p in self.posteriors().items() if p >= least]
        return sorted(found, key=lambda x: (-round(x[1], 9), x[0]))


def model_dict(models: DataFrame, alpha: float = D.ALPHA, dampening: float = D.DAMPENING, limit: int = D.MODEL_BYTES) -> tuple[dict[str, dict[str, float]], list[str]]:
    """Gains by ngram and language for Detector; the size of the model set is checked first."""
    rows = saved(D.gains(D.probabilities(models), alpha, dampening), "gains")
    if not fits(rows, limit):
        raise ValueError(f"the model set has more than {limit} bytes")
    out: dict[str, dict[str, float]] = {}
    table = rows.toArrow()
    for ngram, lang, gain in zip(*(table.column(c).to_pylist() for c in ("ngram", "lang", "gain"))):
        out.setdefault(ngram, {})[lang] = gain
    discard(rows)
    return out, D.language_list(models)


STATE = "known long, sums array<double>, leader int, enough boolean"


def detect_until_sure(chunks: DataFrame, models: DataFrame, key: str, text: str = "text", order: str = "turn", limit: int = D.MODEL_BYTES) -> DataFrame:
    """(key, stopped_at, enough, lang, posterior) of a stream of chunks; a key that is sure reads no further chunk.

    Within a batch chunks are read in their order; null chunks add nothing.  A key's state
    is a few numbers, whatever it has read.  The model set's size is checked; one beyond
    `limit` bytes is an error, as a stream can't be joined with it chunk by chunk.
    """
    langs = D.language_list(models)
    reader = D.reader(models, langs, limit=limit)
    if reader is None:
        raise ValueError(f"the model set has more than {limit} bytes")
    shared = chunks.sparkSession.sparkContext.broadcast(reader)
    kind = dict(chunks.dtypes)[key]

    def run(name, parts: Iterator[pd.DataFrame], state):
        now = shared.value.start()
        if state.exists:
            known, sums, leader, enough = state.get
            now = (known, np.array(sums, dtype=float), leader, enough)
        for _, chunk in sorted((row for part in parts for row in zip(part["o"], part["text"])), key=lambda r: r[0]):
            now = shared.value.read(chunk if isinstance(chunk, str) else None, now)
        known, sums, leader, enough = now
        state.update((int(known), [float(x) for x in sums], int(leader), bool(enough)))
        weights = np.exp(sums - sums.max()) if len(sums) else sums
        best = min(range(len(langs)), key=lambda i: (-round(weights[i] / weights.sum(), 9), langs[i])) if len(langs) else None
        found = best is not None and weights[best] / weights.sum() >= D.LEAST_POSTERIOR
        yield pd.DataFrame({key: [name[0]], "stopped_at": [known], "enough": [enough], "lang": [langs[best] if found else None], "posterior": [weights[best] / weights.sum() if found else None]})

    rows = chunks.select(key, F.col(order).alias("o"), F.col(text).cast("string").alias("text"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, stopped_at long, enough boolean, lang string, posterior double", STATE, "update", GroupStateTimeout.NoTimeout)
