"""The corpus pipeline against the same stages by brute force."""

from __future__ import annotations

import xxhash

import corpus_pipeline
from polyglint.llm import language_id, registry, wavelet
from tests.llm.test_archives import mixed_by_force
from tests.llm.test_text_operators import best_passage, judged_by_force, odd, prose, similar_by_force, table


def test_stages_of_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, prose(30, 2))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd(spark), odd(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
            stage(spark, docs, str(tmp_path)).collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).isEmpty() == docs.isEmpty()


def test_run_equals_brute_force(spark, tmp_path):
    rows = []
    for k in range(60):
        rows.append((len(rows), prose(60 + k, k), ["en", "fr"][k % 2], ["src0", "src1", "other"][k % 3]))
    rows += [(100 + k, rows[k][1] + " tail", "en", "src0") for k in range(10)]
    item = prose(25, 999)
    rows += [(200, f"{prose(40, 1001)} {item} {prose(40, 1002)}", "en", "src0"), (201, "", "en", "src0"), (202, "12 ##", "en", "src1")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    content = language_id.dictionaries(table(spark, rows), folds=2)
    left = [r for r in rows if judged_by_force(r[1], content[1 - (xxhash.xxh64_intdigest(r[1].encode(), 42) & 1)]) is not None]
    dropped = {b for a, b in similar_by_force([(r[0], r[1]) for r in left])}
    left = [r for r in left if r[0] not in dropped]
    left = [r for r in left if best_passage(item.split(), r[1].split()) > 5]
    kept = [i for i, _ in mixed_by_force(left, registry.WEIGHTS, registry.BUDGET_SHARE)]
    coder = wavelet.tokenizer(registry.VOCABULARY)
    found, order = {}, []
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.shard):
        ids = wavelet.decode(bytes(r.content)).tokens()
        found |= {i: coder.decode(ids[a:b]) for i, a, b in zip(r.doc_ids, r.starts, r.starts[1:])}
        order += r.doc_ids
    texts = {r[0]: r[1] for r in rows}
    assert len(kept) > 3 and found == {i: texts[i] for i in kept}
    assert order == kept  # the fair order, within shards and over shards by name


def test_fair_order_reaches_the_shards_from_many_files(spark, tmp_path):
    rows = [(k, prose(20 + k % 40, k), "en", ["src0", "src1", "other"][k % 3]) for k in range(400)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table(spark, rows).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).repartition(5).write.parquet(f"{tmp_path}/mixed")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = sorted(corpus_pipeline.write_tokens(spark, spark.read.parquet(f"{tmp_path}/mixed"), str(tmp_path)).collect(), key=lambda r: r.shard)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(shards) > 1 and [i for r in shards for i in r.doc_ids] == [i for i, _ in mixed_by_force(rows, registry.WEIGHTS, registry.BUDGET_SHARE)]
