"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature, shared by all grades, and ordered thresholds t_1 < t_2 < ...:
P(grade >= k) = sigmoid(score - t_k).  A text gets its expected grade and the tail
probability of a grade that is good enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

BITS = 18


def hashed(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text: places, values and the len+1 offsets.

    Features are the words and what stands between them (its first four bytes), each with
    the logarithm of its frequency; the values of a text are scaled by its size to the
    power of a quarter, between none and full normalisation.
    """
    lowered = pc.utf8_lower(texts)
    data, _ = tokens.utf8(lowered)
    words, starts, stops, bounds = tokens.words(lowered, lower=False)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    gaps = np.zeros(len(words), dtype=np.uint64)
    if len(words):
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        following = np.append(starts[1:], stops[-1])
        for k in range(4):
            inside = stops + k < following
            gaps = gaps << np.uint64(8) | np.where(inside, padded[stops + k], 0).astype(np.uint64)
    with np.errstate(over="ignore"):
        places = np.concatenate([words, tokens.mix(gaps + np.uint64(0x5851F42D4C957F2D))]) >> np.uint64(64 - BITS)
    keys = np.concatenate([owner, owner]) << np.uint64(BITS) | places
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    frequency = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    row = (keys >> np.uint64(BITS)).astype(np.int64)
    values = np.log1p(frequency) / np.sqrt(np.sqrt(np.maximum(counts[row], 1)))
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), values.astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))]).astype(np.int64)


class Ordinal:
    """The fitted model: weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def scores(self, places: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        return np.bincount(row, weights=self.weights[places] * values, minlength=len(bounds) - 1)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one column per threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit(places: np.ndarray, values: np.ndarray, bounds: np.ndarray, grades: np.ndarray, levels: int, ridge: float = 5e-5, rounds: int = 200, rate: float = 0.05) -> Ordinal:
    """Maximum likelihood with a ridge on the weights, by full-batch Adam.

    Thresholds are a first one and the logarithms of the steps to the next, so they stay
    in order.  Without rows every grade is equally likely.
    """
    n = len(grades)
    if n == 0:
        return Ordinal(np.zeros(1 << BITS), np.array([np.log(k / (levels - k)) for k in range(1, levels)]))
    share = np.clip([(grades < k).mean() for k in range(1, levels)], 0.01, 0.99)
    cut = np.log(share / (1 - share))
    free = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 0.05))])
    row = np.repeat(np.arange(n), np.diff(bounds))
    used, local = np.unique(places, return_inverse=True)
    size = len(used)
    state = np.concatenate([np.zeros(size), free])
    m, v = np.zeros_like(state), np.zeros_like(state)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, rounds + 1):
        weights = state[:size]
        thresholds = np.concatenate([state[size : size + 1], state[size] + np.cumsum(np.exp(state[size + 1 :]))])
        score = np.bincount(row, weights=weights[local] * values, minlength=n)
        # P(grade = g) is the difference of two neighbouring tails
        high = np.where(grades > 0, sigmoid(score - thresholds[np.maximum(grades - 1, 0)]), 1.0)
        low = np.where(grades < levels - 1, sigmoid(score - thresholds[np.minimum(grades, levels - 2)]), 0.0)
        chance = np.maximum(high - low, 1e-9)
        slope_high, slope_low = high * (1 - high) / chance, low * (1 - low) / chance
        by_score = (slope_high - slope_low) / n
        by_cut = np.zeros(levels - 1)
        np.add.at(by_cut, np.maximum(grades - 1, 0), -np.where(grades > 0, slope_high, 0) / n)
        np.add.at(by_cut, np.minimum(grades, levels - 2), np.where(grades < levels - 1, slope_low, 0) / n)
        by_free = np.concatenate([[by_cut.sum()], [np.exp(state[size + k]) * by_cut[k:].sum() for k in range(1, levels - 1)]])
        up = np.concatenate([np.bincount(local, weights=values * by_score[row], minlength=size) - ridge * weights, by_free])
        m = 0.9 * m + 0.1 * up
        v = 0.999 * v + 0.001 * up * up
        state = state + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = state[:size]
    return Ordinal(weights, np.concatenate([state[size : size + 1], state[size] + np.cumsum(np.exp(state[size + 1 :]))]))


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels: 0 toxic, 1 poor, 2 good; of repeated labels the worst counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


_SPARSE = pa.schema([("doc_id", pa.int64()), ("places", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.slices(batch, "text"):
            places, values, bounds = hashed(part.column("text"))
            offsets = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(places)), pa.ListArray.from_arrays(offsets, pa.array(values))], schema=_SPARSE)


def train(docs: DataFrame, rated: DataFrame, levels: int = 3, most_rows: int = 16000, **options) -> Ordinal:
    """Fit on a bounded sample: the most_rows rated documents with the smallest hash of their id.

    Rated documents without text, or that docs doesn't have, are left out.  A doc_id of
    several rows counts once, by the text of smallest hash.
    """
    sample = rated.select("doc_id", "grade").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    rows = rows.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    least = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    table = least.mapInArrow(_sparse, "doc_id long, places array<int>, values array<float>").join(F.broadcast(sample), "doc_id").toArrow().combine_chunks()
    table = table.take(pc.sort_indices(table, [("doc_id", "ascending")]))
    if not table.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0, np.int64), levels)
    places, values = table.column("places").combine_chunks(), table.column("values").combine_chunks()
    lengths = pc.list_value_length(places).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return fit(places.flatten().to_numpy(), values.flatten().to_numpy(), bounds, table.column("grade").to_numpy().astype(np.int64), levels, **options)


def grade(docs: DataFrame, model: Ordinal, good: int = 2) -> DataFrame:
    """(doc_id, expected_grade, tail): the expected grade, and the probability of `good` or better.

    Null and empty texts have nothing to be judged by: both are null.  Very long texts are
    graded whole.  Repeated rows are graded each, and alike; a null doc_id stays null; extra
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Ordinal(*shared.value)
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                tails = fitted.tails(fitted.scores(*hashed(part.column("text"))))
                blank = pc.fill_null(pc.equal(pc.binary_length(part.column("text")), 0), True).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tails.sum(axis=1), mask=blank), pa.array(tails[:, good - 1], mask=blank)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tail double")


def select(docs: DataFrame, labels: DataFrame, least_tail: float = 0.6, good: int = 2, **options) -> DataFrame:
    """Ids, expected grades and tail probabilities of documents that are `good` with probability least_tail, at least.

    Texts that can't be graded are left out; see grade() and train().
    """
    return grade(docs, train(docs, ratings(labels), **options), good).where(F.col("tail") >= least_tail)
