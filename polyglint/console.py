"""Training, storing and trying models from the command line.

    python -m polyglint --inputfile corpus.tsv --inputdir folder --maxngram 4 --minngramfreq 2e-5 --command build --command "save models"

Commands are given with --command, in order, or else read from the console:

    mode                  text or binary models, in turn
    data PATH             labelled lines of a file, or files of a folder, added to those loaded
    build                 train from the loaded texts
    load FOLDER           models of a folder of files; those at hand stay if it has none
    save FOLDER           models as files, and as Parquet by tier
    prune COUNT           drop ngrams of a lower count
    detect TEXT           the languages of a text (with --trace, ngram by ngram)
    test PATH             error rates on labelled lines
    damp VALUE, alpha VALUE, lang TAG...   for detect: dampening, alpha, languages to trace
    size, dump TAG        what is in the models
    quit
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.operators import detect as D
from polyglint.operators import evaluate as E
from polyglint.operators import model as M
from polyglint.session import saved
from polyglint.sources import labelled
from polyglint.sources import models as S


class Console:
    """The state between commands: loaded texts, models and settings.  Results go to `say`."""

    def __init__(self, spark: SparkSession, max_n: int = 4, min_frequency: float = 0.0, trace: bool = False, say: Callable[[str], None] = print) -> None:
        self.spark, self.max_n, self.min_frequency, self.traced, self.say = spark, max_n, min_frequency, trace, say
        self.binary, self.texts, self.models = False, None, None
        self.alpha, self.dampening, self.langs = D.ALPHA, D.DAMPENING, None

    def run(self, line: str) -> bool:
        """One command; False to stop."""
        name, _, rest = line.strip().partition(" ")
        name = name.lower()
        if name == "quit":
            return False
        command = getattr(self, f"do_{name}", None)
        if not name:
            return True
        if command is None:
            self.say(f"unknown command: {name}")
            return True
        try:
            command(rest.strip())
        except ValueError as e:
            self.say(str(e))
        return True

    def _need(self, what: str) -> DataFrame:
        found = getattr(self, what)
        if found is None:
            raise ValueError(f"there are no {what} yet")
        return found

    def _read(self, path: str) -> DataFrame:
        if os.path.isdir(path.removeprefix("file://")):
            return labelled.read_folder(self.spark, path).select("lang", "text")
        return labelled.read_tsv(self.spark, path).where("valid").select("lang", "text")

    def do_mode(self, rest: str) -> None:
        self.binary = not self.binary
        self.models = None  # those of the other mode have other ngrams
        self.say(f"mode: {'binary' if self.binary else 'text'}")

    def do_data(self, rest: str) -> None:
        more = self._read(rest)
        self.texts = more if self.texts is None else M.union(self.texts, more)
        self.say(f"{self.texts.count()} texts")

    def do_build(self, rest: str) -> None:
        self.models = saved(M.train(self._need("texts"), max_n=self.max_n, min_frequency=self.min_frequency, binary=self.binary), "models")
        self.do_size("")

    def do_load(self, rest: str) -> None:
        self.models = S.load_or_keep(self.spark, rest, self.models, ".bin" if self.binary else ".txt")
        self.do_size("")

    def do_save(self, rest: str) -> None:
        models = self._need("models")
        (S.write_binary if self.binary else S.write_text)(models, rest, self.max_n)
        S.save(models, f"{rest.rstrip('/')}/parquet")
        self.say(f"saved to {rest}")

    def do_prune(self, rest: str) -> None:
        count = int(rest)
        for r in M.prune_report(self._need("models"), count).orderBy("lang").collect():
            self.say(f"{r.lang}: {r.kept} kept, {r.dropped} dropped")
        self.models = saved(M.prune(self.models, count), "models")

    def do_size(self, rest: str) -> None:
        for r in M.describe(self._need("models")).orderBy("lang").collect():
            self.say(r.description)

    def do_dump(self, rest: str) -> None:
        for r in M.dump(self._need("models"), rest or None).toLocalIterator():
            self.say(f"{r.lang}\t{r.line}")

    def do_damp(self, rest: str) -> None:
        self.dampening = float(rest)

    def do_alpha(self, rest: str) -> None:
        self.alpha = float(rest)

    def do_lang(self, rest: str) -> None:
        self.langs = rest.split() or None

    def _text_models(self) -> DataFrame:
        models = self._need("models")
        if self.binary:
            raise ValueError("hashed models hold no ngrams to detect with: change the mode")
        return models

    def do_detect(self, rest: str) -> None:
        models = self._text_models()
        docs = self.spark.createDataFrame([(1, rest)], "doc_id long, text string")
        options = {"alpha": self.alpha, "dampening": self.dampening}
        if self.traced:
            for r in D.trace(docs, models, langs=self.langs, **options).orderBy("k", "lang").collect():
                self.say(f"{r.k} '{r.ngram}' {r.lang} {r.prob} {r.posterior:.6f}")
        found = D.detect(docs, models, **options).orderBy("rank").select(D.described(F.col("lang"), F.col("posterior"), F.col("posterior")).alias("d")).collect()
        for r in found:
            self.say(r.d)

    def do_test(self, rest: str) -> None:
        docs = saved(self._read(rest).select(F.monotonically_increasing_id().alias("doc_id"), F.col("lang").alias("label"), "text"), "test")
        best = D.best(D.detect(docs, self._text_models(), alpha=self.alpha, dampening=self.dampening))
        for r in E.error_rates(E.judged(docs.select("doc_id", "label"), best)).orderBy(F.col("label").asc_nulls_last()).collect():
            self.say(f"{r.label or 'all'}: {r.errors} of {r.texts} ({100 * r.rate:.2f} %)")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, say: Callable[[str], None] = print) -> int:
    parser = argparse.ArgumentParser(prog="polyglint", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--inputdir", help="folder of labelled texts, loaded first")
    parser.add_argument("--inputfile", help="file of labelled lines, loaded first")
    parser.add_argument("--maxngram", type=int, default=4)
    parser.add_argument("--minngramfreq", type=float, default=0.0, help="least share of a language's ngrams")
    parser.add_argument("--debug", action="store_true", help="show Spark's messages")
    parser.add_argument("--trace", action="store_true", help="detect ngram by ngram")
    parser.add_argument("--command", action="append", default=[])
    options = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("polyglint").getOrCreate()
    if not options.debug:
        spark.sparkContext.setLogLevel("ERROR")
    console = Console(spark, options.maxngram, options.minngramfreq, options.trace, say)
    for path in filter(None, (options.inputfile, options.inputdir)):
        console.run(f"data {path}")
    for line in options.command or iter(lambda: sys.stdin.readline() or "quit", "quit\n"):
        if not console.run(line):
            break
    return 0
