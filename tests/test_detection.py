"""Models and detection against a plain transcription of the sequential loop."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from polyglint import console
from polyglint.functions import sql
from polyglint.functions import text as T
from polyglint.operators import corpus as C
from polyglint.operators import detect as D
from polyglint.operators import evaluate as E
from polyglint.operators import model as M
from polyglint.operators.lookup import Sparse
from polyglint.sources import models as S
from polyglint.streaming import detect as stream

TEXTS = {"en": "the quick brown fox and the lazy dog of this town ", "de": "der schnelle braune fuchs und der faule hund dieser stadt ", "fr": "le renard brun rapide et le chien paresseux de cette ville "}


def corpus(spark, n=60):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        lang = list(TEXTS)[k % 3]
        words = TEXTS[lang].split()
        rows.append((k, lang, " ".join(rng.choice(words) for _ in range(120))))
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


@pytest.fixture(scope="module")
def models(spark):
    return M.train(corpus(spark)).cache()


def plain(rows, norm, every=110, stop=False):
    """Posteriors by the product form, renormalised as it goes; long mixed texts would underflow in it."""
    probs = {}
    for r in rows:
        probs.setdefault(r.ngram, {})[r.lang] = r.norm_count
    langs = sorted({r.lang for r in rows})
    state, known, leader = dict.fromkeys(langs, 1 / len(langs)), 0, None
    for p in range(len(norm)):
        for n in range(1, 5):
            g = norm[p : p + n]
            if p + n > len(norm) or g not in probs:
                continue
            known += 1
            total = sum(probs[g].values())
            for lang in langs:
                x = probs[g][lang] / total if lang in probs[g] else D.ALPHA
                state[lang] *= x + (1 - x) * D.DAMPENING
            whole = sum(state.values())
            state = {k: v / whole for k, v in state.items()}
            if stop and known % every == 0:
                best = max(state, key=state.get)
                now = best if state[best] > 0.99 else None
                if now and now == leader:
                    return state, known
                leader = now
    return state, known


def test_detection_equals_the_plain_loop(spark, models):
    rows = models.collect()
    texts = [(k, t) for k, t in enumerate(["the fox", "hund und", "ville", "", "qqq", "the fox of this ville und", "le " * 3, TEXTS["de"] * 20, "the fox hund"])] + [(99, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    norms = {r.doc_id: r.norm or "" for r in docs.select("doc_id", T.normalize(F.col("text")).alias("norm")).collect()}
    paths = (D.posteriors(docs, models).collect(), D.early_stop(docs, models).collect(), D.early_stop_joined(docs, models).collect())
    for r in paths[0]:
        state, known = plain(rows, norms[r.doc_id])
        assert abs(r.posterior - state[r.lang]) < 1e-9 and r.known == known
    for found in paths[1:]:
        assert {r.doc_id for r in found} == set(norms)
        for r in found:
            state, known = plain(rows, norms[r.doc_id], stop=True)
            assert abs(r.posterior - state[r.lang]) < 1e-9 and r.stopped_at == known
    gains, langs = stream.model_dict(models)
    for k, norm in norms.items():
        one = stream.Detector(gains, langs)
        one.add_normalized(norm)
        state, known = plain(rows, norm, stop=True)
        assert one.known == known and all(abs(one.posteriors()[lang] - state[lang]) < 1e-9 for lang in langs)


def test_broadcast_and_shuffled_sums_agree(spark, models):
    table = D.wide(D.gains(D.probabilities(models)), ["de", "en", "fr"])
    docs, columns = corpus(spark, 9), ["known", "g0", "g1", "g2"]
    a, b = ({r.doc_id: r for r in D.text_sums(docs, table, columns, "doc_id", "text", limit=limit).collect()} for limit in (10**9, 0))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].ngrams == b[k].ngrams and all(abs(a[k][c] - b[k][c]) < 1e-6 for c in columns)


def test_pruned_models_sum_along_prefixes(spark, models):
    """A known ngram may have an unknown prefix."""
    sparse = models.where("length(ngram) IN (2, 4)")
    docs = spark.createDataFrame([(1, "the brown fox")], "doc_id long, text string")
    state, known = plain(sparse.collect(), " the brown fox ")
    assert all(abs(r.posterior - state[r.lang]) < 1e-9 and r.known == known for r in D.posteriors(docs, sparse).collect())


def test_evaluation_and_tuning(spark, models):
    docs = corpus(spark, 30)
    judged = E.judged(docs.select("doc_id", F.col("lang").alias("label")), D.best(D.detect(docs, models)))
    assert {r.label: r.errors for r in E.error_rates(judged).collect()} == {"en": 0, "de": 0, "fr": 0, None: 0}
    assert [r.errors for r in D.tune(docs, models, [(2e-6, 1e-3), (1e-3, 0.1)]).collect()] == [0, 0]


def test_small_languages_get_no_model(spark):
    assert {r.lang for r in M.languages(M.train(corpus(spark, 4))).collect()} == set()
    assert M.train(corpus(spark).limit(0)).count() == 0


@pytest.mark.parametrize("value", [0, 1, -112, -113, 127, 128, 255, 256, 65535, 1_000_000, 2**31 - 1, -1, -129, -(2**31)])
def test_numbers_of_variable_size(value):
    data = S.encode_vint(value)
    assert S.decode_vint(data + b"x", 0) == (value, len(data)) and S.vint_size(int.from_bytes(data[:1], "big", signed=True)) == len(data)


def test_model_files(spark, models, tmp_path):
    hashed = M.train(corpus(spark), binary=True)
    S.write_binary(hashed, f"{tmp_path}/b")
    assert M.equal(S.read_binary(spark, f"{tmp_path}/b"), hashed.withColumn("ngram", F.col("ngram").cast("int"))).first().equal
    S.write_text(models, f"{tmp_path}/t")
    assert M.equal(S.read_text(spark, f"{tmp_path}/t"), models).first().equal
    S.save(models, f"{tmp_path}/p")
    assert M.equal(S.load_core(spark, f"{tmp_path}/p"), models).first().equal and S.load(spark, f"{tmp_path}/p", tier="extras").isEmpty()
    with pytest.raises(ValueError):
        S.decode_binary(b"\0\0\0\2\0\0")
    with pytest.raises(ValueError):
        S.encode_binary("en", 4, [(1, 0)])


def test_hashed_models_are_trained_without_a_row_per_occurrence(spark):
    docs = corpus(spark)
    plans = [M.train(docs, binary=binary)._jdf.queryExecution().executedPlan().toString() for binary in (False, True)]
    assert all("MapInArrow" in p and "regexp_extract_all" not in p for p in plans)


def test_stream_of_chunks(spark, models, tmp_path):
    rows = [(k, t, TEXTS[list(TEXTS)[k % 3]]) for k in range(6) for t in range(4)]
    spark.createDataFrame(rows, "conv long, turn long, text string").repartition(3).write.parquet(f"{tmp_path}/c.parquet")
    chunks = stream.read_table(spark, f"{tmp_path}/c.parquet")
    found = stream.run_to_end(stream.detect_stream(chunks, models, "conv"), "conv").collect()
    batch = {r.conv: r.results for r in D.judged_texts(spark.read.parquet(f"{tmp_path}/c.parquet"), models, "conv").collect()}
    assert len(found) == 6
    for r in found:
        assert all(a.lang == b.lang and abs(a.posterior - b.posterior) < 1e-9 for a, b in zip(r.results, batch[r.conv]))
    sure = stream.run_to_end(stream.detect_until_sure(stream.read_table(spark, f"{tmp_path}/c.parquet"), models, "conv"), "conv").collect()
    assert {r.conv: r.lang for r in sure} == {k: list(TEXTS)[k % 3] for k in range(6)} and all(r.enough for r in sure)


def test_models_by_name(spark, models, tmp_path):
    assert {r.lang for r in M.get_model(models, "de").collect()} == {"de"}
    with pytest.raises(ValueError):
        M.get_model(models, "deu")
    assert {r.lang for r in M.languages(M.subset(models, without=["de"])).collect()} == {"en", "fr"}
    assert {r.lang for r in M.languages(M.subset(models, ["de", "fr"], ["fr"])).collect()} == {"de"}
    wanted = spark.createDataFrame([("deu",), ("en",), ("jpn",), (None,)], "tag string")
    assert {r.tag: r.has_model for r in M.has_model(models, wanted, "tag").collect()} == {"deu": True, "en": True, "jpn": False, None: False}
    assert M.equal(models, models).first().equal
    S.write_text(models, f"{tmp_path}/t")
    assert M.equal(S.load_or_keep(spark, f"{tmp_path}/t", None), models).first().equal
    (tmp_path / "empty").mkdir()
    for none in ("empty", "nowhere"):
        assert S.load_or_keep(spark, f"{tmp_path}/{none}", models) is models and S.load_or_keep(spark, f"{tmp_path}/{none}", None, ".bin") is None
    (tmp_path / "t" / "model_en.txt").rename(tmp_path / "t" / "model_sv.txt")
    with pytest.raises(Exception, match="another language"):
        S.read_text(spark, f"{tmp_path}/t").collect()
    lines = M.dump(models, "de").collect()
    assert lines[0].line.split("\t")[0] == " " and len(lines) == M.get_model(models, "de").count()


def test_functions_in_sql(spark, models):
    sql.register(spark, models)
    docs = spark.createDataFrame([(1, "the fox " * 9), (2, None), (3, ""), (4, TEXTS["de"])], "doc_id long, text string")
    found = {r.doc_id: r for r in spark.sql("SELECT doc_id, detect_language(text) AS best, detect_languages(text) AS every FROM {d}", d=docs).collect()}
    for r in D.detect(docs, models).where("rank = 1").collect():
        assert found[r.doc_id].best.lang == r.lang and abs(found[r.doc_id].best.posterior - r.posterior) < 1e-9
    assert [len(found[k].every) for k in (1, 2, 3, 4)] == [1, 3, 3, 1]
    grams = [(r.doc_id, r.pos, r.len, r.ngram) for r in spark.sql("SELECT d.doc_id, g.* FROM {d} d, LATERAL ngrams(d.text, 3) g", d=docs).collect()]
    want = [(r.doc_id, r.pos, r.len, r.ngram) for r in T.positioned(docs, "text", ["doc_id"], 3).collect()]
    assert sorted(grams) == sorted(want)


def test_lines_beyond_latin_with_their_languages(spark, models):
    rows = spark.createDataFrame([(1, 1, "\u0416the fox"), (1, 2, "\u0416 der hund und"), (1, 3, "the"), (2, 1, "\u0416 le chien rapide")], "doc_id long, line_no int, line string")
    found = {(r.doc_id, r.line_no): r for r in C.beyond_latin_report(rows, models).collect()}
    assert found.keys() == {(1, 2), (2, 1)} and found[1, 2].lang == "de" and found[2, 1].lang == "fr" and found[2, 1].second_lang is None


def test_console(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("".join(f"{lang}\t{TEXTS[lang] * 30}\n" for lang in TEXTS for _ in range(4)))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part_sv.txt").write_text("och det var en gång\n" * 400)
    said = []
    commands = ["wrong", "build", f"data {tmp_path}/d", "build", f"save {tmp_path}/m", "prune 50", f"load {tmp_path}/nothing", f"load {tmp_path}/m", "damp 0.001", "alpha 2e-6", "lang sv", "detect det var en gång", f"test {tmp_path}/c.tsv", "dump sv", "mode", "build", f"save {tmp_path}/b", f"load {tmp_path}/b", "detect x", "quit", "size"]
    console.main(["--inputfile", f"{tmp_path}/c.tsv", "--maxngram", "3", "--minngramfreq", "1e-6", "--trace", *[x for c in commands for x in ("--command", c)]], spark, said.append)
    text = "\n".join(said)
    assert "unknown command: wrong" in text and "Language 'sv'" in text and "all: 0 of 12 (0.00 %)" in text and "mode: binary" in text and "hashed models" in said[-1]
    assert {p.name for p in (tmp_path / "m").iterdir()} >= {"model_sv.txt", "model_en.txt", "parquet"} and (tmp_path / "b" / "model_de.bin").exists()


def test_many_languages_are_kept_sparse(spark):
    """Forty languages of two letters each: the sparse table, the dense one and the join agree."""
    rng = random.Random(8)
    rows = [(f"{chr(97 + a)}{chr(97 + b)}x", " ".join("".join(rng.choices([chr(97 + a), chr(97 + b), "z"], k=5)) for _ in range(60))) for a in range(5) for b in range(8)]
    models = M.train(spark.createDataFrame(rows, "lang string, text string"), least_ngrams=0).cache()
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)] + [(99, None), (98, "")], "doc_id long, text string")
    table = D.held_gains(models, D.language_list(models), D.ALPHA, D.DAMPENING)
    assert isinstance(table.values, Sparse) and table.values.columns == 41
    assert D.held_gains(models, D.language_list(models), D.ALPHA, D.DAMPENING, limit=100) is None
    found, joined = ({(r.doc_id, r.lang): (r.posterior, r.known) for r in D.posteriors(docs, models, limit=limit).collect()} for limit in (D.MODEL_BYTES, 100))
    assert len(found) == 42 * 40 and found.keys() == joined.keys() and all(abs(found[k][0] - joined[k][0]) < 1e-9 and found[k][1] == joined[k][1] for k in found)
    early, slow = ({(r.doc_id, r.lang): (round(r.posterior, 9), r.stopped_at) for r in D.early_stop(docs, models, limit=limit).collect()} for limit in (D.MODEL_BYTES, 100))
    assert early == slow
    priors = {rows[0][0]: 0.5, rows[9][0]: 0.5}
    some, others = ({(r.doc_id, r.lang): (round(r.posterior, 9), r.known) for r in D.posteriors(docs, models, priors=priors, limit=limit).collect()} for limit in (D.MODEL_BYTES, 100))
    assert some == others and {lang for _, lang in some} == priors.keys()
