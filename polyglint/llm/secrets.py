"""Secret scans by two character Markov models.

One model is of random strings, one of ordinary identifiers; both count character pairs
of labelled samples.  A token is a secret where the log-likelihood ratio of the two is
high enough, in total and per character.  A token that isn't, such as a path or an
assignment, is searched for stretches of its parts that are.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of characters that secrets are made of.
LEAST_LENGTH = 16
TOKEN = re.compile(rf"[A-Za-z0-9_+/=\-]{{{LEAST_LENGTH},}}")
PART = re.compile(r"[A-Za-z0-9]+")
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "_+/=-"
_PLACE = np.full(256, len(ALPHABET), dtype=np.int64)
_PLACE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
STATES = len(ALPHABET) + 1  # the last state: the edge of a token

FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def pair_counts(samples: Iterable[str]) -> np.ndarray:
    """Counts of character pairs, edges included."""
    joined = np.frombuffer(("\n" + "\n".join(samples) + "\n").encode("ascii", "replace"), np.uint8)
    places = _PLACE[joined]
    return np.bincount(places[:-1] * STATES + places[1:], minlength=STATES * STATES).reshape(STATES, STATES)


def log_probabilities(counts: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """log P(next | character), smoothed."""
    padded = counts + smoothing
    return np.log(padded / padded.sum(axis=1, keepdims=True))


def random_samples(n: int = 4000, seed: int = 11) -> list[str]:
    """Labelled random strings: hexadecimal, base-32, base-36, base-62 and base-64, 16 to 64 characters."""
    rng = random.Random(seed)
    kinds = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_"]
    return ["".join(rng.choices(kinds[k % len(kinds)], k=rng.randint(16, 64))) for k in range(n)]


def identifier_samples(words: list[str], n: int = 20000, seed: int = 12) -> list[str]:
    """Labelled identifiers: words of a corpus alone, and joined as code and paths join them."""
    rng = random.Random(seed)
    words = sorted({w for w in words if w.isascii() and w.isalpha()}) or ["value"]
    out = list(words[:n])
    joins = ["_", "-", "/", "camel", "", "_", "upper"]
    for k in range(n):
        parts = [rng.choice(words).lower() for _ in range(rng.randint(2, 5))]
        how = joins[k % len(joins)]
        if how == "camel":
            name = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif how == "upper":
            name = "_".join(parts).upper()
        else:
            name = how.join(parts)
        if rng.random() < 0.2:
            name += rng.choice(["_", "", "-"]) + str(rng.randint(0, 2030))
        out.append(name)
    # numbers, dates and rulers are ordinary too
    out += ["".join(rng.choices(string.digits, k=rng.randint(16, 20))) for _ in range(n // 20)]
    out += [f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" for _ in range(n // 20)]
    out += [c * rng.randint(16, 80) for c in "-=_+/" for _ in range(n // 400)]
    return out


def training_words(docs: DataFrame, documents: int = 2000, most: int = 20000) -> list[str]:
    """ASCII words of a bounded sample: of the `documents` texts with the smallest hash, the `most` commonest.

    Only hashes are sorted for the sample, and words are counted where the texts lie, so
    that no text comes to the driver.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where("length(text) > 0").select("text", F.xxhash64("text").alias("h"))
    last = texts.select("h").distinct().orderBy("h").limit(documents).agg(F.max("h").alias("h")).first().h
    if last is None:
        return []
    words = texts.where(F.col("h") <= last).dropDuplicates(["h"]).select(F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{3,}\b"), F.lit(0))).alias("word"))
    return [r.word for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).collect()]


class Models:
    """The pair of Markov models."""

    def __init__(self, secrets: Iterable[str], ordinary: Iterable[str]) -> None:
        self.ratio = log_probabilities(pair_counts(secrets)) - log_probabilities(pair_counts(ordinary))

    def score(self, token: str) -> float:
        """Log-likelihood ratio of the token; above 0 it is more like a random string."""
        places = _PLACE[np.frombuffer(f"\n{token}\n".encode("ascii", "replace"), np.uint8)]
        return float(self.ratio[places[:-1], places[1:]].sum())


def _best_stretch(starts: list[int], ends: list[int], left: list[float], right: list[float], least_total: float, least_mean: float) -> tuple[int, int] | None:
    """First and last part of the stretch of highest score that reaches both thresholds; its score is right[last] - left[first]."""
    # score >= least_mean * length says that the start's tilted value is at most the end's
    tilted = [x - least_mean * a for x, a in zip(left, starts)]
    ranked = sorted(tilted)
    least: list[tuple[float, int]] = [(float("inf"), -1)] * (len(ranked) + 1)  # a Fenwick tree of the smallest left by rank
    best, found, entered = least_total, None, 0
    for last, end in enumerate(ends):
        while entered <= last and starts[entered] <= end - LEAST_LENGTH:
            at = bisect_left(ranked, tilted[entered]) + 1
            while at < len(least):
                least[at] = min(least[at], (left[entered], entered))
                at += at & -at
            entered += 1
        at, low = bisect_right(ranked, right[last] - least_mean * end), least[0]
        while at:
            low = min(low, least[at])
            at -= at & -at
        if low[1] >= 0 and (right[last] - low[0] > best or found is None and right[last] - low[0] >= best):
            best, found = right[last] - low[0], (low[1], last)
    return found


def stretches(token: str, models: Models, least_total: float, least_mean: float) -> list[tuple[int, int, float]]:
    """(start, end, score) of the secrets within a token: stretches from part to part, scored like tokens of their own.

    The best stretch that reaches the thresholds is taken, then those on either side of it.
    """
    spans = [m.span() for m in PART.finditer(token)]
    if not spans:
        return []
    places = _PLACE[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]
    starts, ends = (np.array(x) for x in zip(*spans))
    inner = np.concatenate([[0.0], np.cumsum(models.ratio[places[:-1], places[1:]])])
    left = inner[starts] - models.ratio[STATES - 1, places[starts]]
    right = inner[ends - 1] + models.ratio[places[ends - 1], STATES - 1]
    out, waiting = [], [(0, len(spans))]
    while waiting:
        lo, hi = waiting.pop()
        # most are ordinary throughout: no stretch reaches the total, whatever its length
        if lo >= hi or (right[lo:hi] - np.minimum.accumulate(left[lo:hi])).max() < least_total:
            continue
        found = _best_stretch(starts[lo:hi].tolist(), ends[lo:hi].tolist(), left[lo:hi].tolist(), right[lo:hi].tolist(), least_total, least_mean)
        if found:
            first, last = lo + found[0], lo + found[1]
            out.append((int(starts[first]), int(ends[last]), float(right[last] - left[first])))
            waiting += [(lo, first), (last + 1, hi)]
    return sorted(out)


def find(text: str, models: Models, least_total: float, least_mean: float) -> list[tuple[int, int, float]]:
    """(start, end, score) of every secret in a text, by character position."""
    out = []
    for m in TOKEN.finditer(text):
        token = m.group()
        score = models.score(token)
        if score >= least_total and score >= least_mean * len(token):
            out.append((m.start(), m.end(), round(score, 6)))
        else:
            out += [(m.start() + a, m.start() + b, round(x, 6)) for a, b, x in stretches(token, models, least_total, least_mean)]
    return out


def scan(docs: DataFrame, secrets: list[str] | None = None, ordinary: list[str] | None = None, least_total: float = 12.0, least_mean: float = 0.35, sample_documents: int = 2000, sample_words: int = 20000) -> DataFrame:
    """(doc_id, start, end, score, secret): one row per secret found in the whole text.

    The models are trained from the two lists of labelled samples; by default random
    strings of common alphabets, and identifiers made of the sample_words commonest words
    of sample_documents texts.  Strings below LEAST_LENGTH (16) characters aren't scored:
    two models can't tell so few characters apart, so shorter secrets aren't found.

    Null and empty texts hold no secrets; very long ones are scanned whole.  A secret that
    occurs twice is found twice; of stretches of equal score within a run the first counts.
    Repeated rows are scanned each, a null doc_id stays null; extra columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    secrets = random_samples() if secrets is None else secrets
    ordinary = identifier_samples(training_words(docs, sample_documents, sample_words)) if ordinary is None else ordinary
    ratio = Models(secrets, ordinary).ratio

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        models = Models.__new__(Models)
        models.ratio = ratio
        for texts in batches:
            yield pd.Series([find(x, models, least_total, least_mean) if isinstance(x, str) else [] for x in texts], dtype=object)

    text = F.col("text").cast("string")
    # the planner would run it twice, in a filter and in a projection, if it took it for cheap
    scanned = F.pandas_udf(run, FOUND).asNondeterministic()
    found = docs.select("doc_id", text.alias("text")).withColumn("found", scanned(F.col("text"))).where(F.size("found") > 0)
    rows = found.select("doc_id", "text", F.explode("found").alias("f"))
    return rows.select("doc_id", "f.start", "f.end", "f.score", F.expr("substring(text, f.start + 1, f.end - f.start)").alias("secret"))
