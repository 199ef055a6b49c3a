"""Queries of this subpackage over the driver tables, with their SQL twins where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.session import fresh_path

from . import decontaminate, html_consensus, jaccard, language_id, mixing, ordinal, quality_rules, secrets, warc, wavelet

#: A public byte-level vocabulary; any rank file of that kind will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Target weights by source; a source that isn't named has weight 1.
WEIGHTS = {"src0": 2.0, "src1": 0.5}
BUDGET_SHARE = 0.9


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class of similar texts, and to how many others it is linked."""
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted documents with their language; those of narrow margin are left out."""
    found = language_id.identify(_table(spark, sf_dir, "documents")).where("identified.language is not null")
    return found.select("doc_id", "identified.language", "identified.size", "identified.runner_up", "identified.margin")


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.shards(_table(spark, sf_dir, "documents"), VOCABULARY)


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.select(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), WEIGHTS, budget_share=BUDGET_SHARE)
    return mixed.select("doc_id", "source", "tokens", "virtual_finish")


def op9_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archive files with dictionaries, read back as streams and validated record by record."""
    folder = fresh_path(spark, "archives")
    warc.write_archives(warc.pack_pages(_table(spark, sf_dir, "pages")), folder)
    records = warc.scan(spark, folder)
    page = F.col("headers").getItem("x-page-id").cast("long").alias("page_id")
    return records.select(page, F.col("uri").alias("url"), "type", "length", F.decode("block", "utf-8").alias("html"), "error")


def op10_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract_pages(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_wavelet_shards": op6_wavelet_shards,
    "op7_ordinal_quality": op7_ordinal_quality,
    "op8_fair_mix": op8_fair_mix,
    "op9_warc_reader": op9_warc_reader,
    "op10_html_consensus": op10_html_consensus,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": r"""
        WITH t AS (
            SELECT doc_id, lang, source, text, regexp_replace(text, '[ \t\r\n]+', '', 'g') AS solid,
                trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS spaced, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents),
        c AS (
            SELECT *, length(solid) AS size, length(regexp_replace(solid, '[0-9A-Za-z\x{80}-\x{10ffff}]', '', 'g')) AS sym,
                length(regexp_replace(solid, '[^0-9]', '', 'g')) AS dig, length(regexp_replace(solid, '[^A-Z]', '', 'g')) AS cap,
                CASE WHEN spaced = '' THEN 1 ELSE length(spaced) - length(replace(spaced, ' ', '')) + 1 END AS words FROM t),
        f AS (
            SELECT doc_id, lang, source, 1000 * sym // (size + 30) AS symbols, 1000 * dig // (size + 30) AS digits, 1000 * cap // (size + 30) AS capitals,
                100 * size // words AS word_length,
                CASE WHEN len(lines) = 0 THEN 0 ELSE 1000 * (len(lines) - len(list_distinct(lines))) // len(lines) END AS repeated_lines FROM c),
        u AS (SELECT *, CASE WHEN length(bin(value)) > 6 THEN (value >> (length(bin(value)) - 6)) << (length(bin(value)) - 6) ELSE value END AS cell
            FROM (UNPIVOT f ON symbols, digits, capitals, word_length, repeated_lines INTO NAME feature VALUE value)),
        c1 AS (SELECT lang, source, feature, cell, count(*) AS n FROM u GROUP BY ALL),
        c2 AS (SELECT lang, feature, cell, sum(n) AS n FROM c1 GROUP BY ALL),
        c3 AS (SELECT feature, cell, sum(n) AS n FROM c1 GROUP BY ALL),
        r1 AS (SELECT *, 100 * sum(n) OVER (PARTITION BY lang, source, feature ORDER BY cell) AS r, sum(n) OVER (PARTITION BY lang, source, feature) AS total FROM c1),
        r2 AS (SELECT *, 100 * sum(n) OVER (PARTITION BY lang, feature ORDER BY cell) AS r, sum(n) OVER (PARTITION BY lang, feature) AS total FROM c2),
        r3 AS (SELECT *, 100 * sum(n) OVER (PARTITION BY feature ORDER BY cell) AS r, sum(n) OVER (PARTITION BY feature) AS total FROM c3),
        q1 AS (SELECT lang, source, feature, max(total) AS total, [min(cell) FILTER (r >= total * 25), min(cell) FILTER (r >= total * 75), min(cell) FILTER (r >= total * 95), min(cell) FILTER (r >= total * 99), max(cell)] AS p FROM r1 GROUP BY ALL),
        q2 AS (SELECT lang, feature, max(total) AS total, [min(cell) FILTER (r >= total * 25), min(cell) FILTER (r >= total * 75), min(cell) FILTER (r >= total * 95), min(cell) FILTER (r >= total * 99), max(cell)] AS p FROM r2 GROUP BY ALL),
        q3 AS (SELECT feature, [min(cell) FILTER (r >= total * 25), min(cell) FILTER (r >= total * 75), min(cell) FILTER (r >= total * 95), min(cell) FILTER (r >= total * 99), max(cell)] AS p FROM r3 GROUP BY ALL),
        p AS (
            SELECT q1.lang, q1.source, feature, CASE WHEN q1.total >= 50 THEN q1.p WHEN q2.total >= 50 THEN q2.p ELSE q3.p END AS p
            FROM q1 JOIN q2 USING (lang, feature) JOIN q3 USING (feature)),
        w AS (SELECT lang, source, feature, p[1] AS low, p[2] AS high, p[2] - p[1] AS spread, greatest(p[2], 3 * (p[3] - p[2]), p[4] - p[2]) AS tail, p[5] AS top FROM p),
        bad AS (SELECT DISTINCT doc_id FROM u JOIN w USING (lang, source, feature)
            WHERE spread > 0 AND (value < low - 3 * spread OR value > high + greatest(3 * spread, high)) OR spread = 0 AND tail > 0 AND value > high + tail OR spread = 0 AND tail = 0 AND value > top // 2)
        SELECT doc_id, lang, source, symbols::INTEGER AS symbols, digits::INTEGER AS digits, capitals::INTEGER AS capitals, word_length::INTEGER AS word_length,
            repeated_lines::INTEGER AS repeated_lines FROM f WHERE doc_id NOT IN (SELECT doc_id FROM bad)
    """,
    "op3_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10ffff}]+') AS w FROM documents),
        g AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
            FROM w WHERE len(w) > 0),
        grams AS (SELECT doc_id, len(g) AS size, unnest(g) AS gram FROM g),
        near AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.size) + any_value(b.size) - count(*) AS total
            FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM near WHERE common >= 0.5 * total UNION ALL SELECT y, x FROM near WHERE common >= 0.5 * total),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x)
        SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE links.x = c.doc_id) AS links FROM classes c
    """,
    "op8_fair_mix": r"""
        WITH t AS (SELECT doc_id, source, text, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS s FROM documents),
        d AS (
            SELECT doc_id, source, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS key, md5(text) AS tie,
                CASE WHEN s = '' THEN 0 ELSE length(s) - length(replace(s, ' ', '')) + 1 END AS tokens FROM t),
        f AS (
            SELECT *, (sum(tokens) OVER (PARTITION BY source ORDER BY key, tie ROWS UNBOUNDED PRECEDING))::BIGINT::DOUBLE
                / CASE source WHEN 'src0' THEN 2.0::DOUBLE WHEN 'src1' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS finish FROM d),
        r AS (SELECT *, sum(tokens) OVER (ORDER BY finish, key, tie ROWS UNBOUNDED PRECEDING) AS served, sum(tokens) OVER () AS total FROM f)
        SELECT doc_id, source, tokens::BIGINT AS tokens, finish AS virtual_finish FROM r WHERE served <= floor(total::DOUBLE * 0.9::DOUBLE)
    """,
    "op9_warc_reader": """
        SELECT page_id, url, 'resource' AS type, strlen(html)::BIGINT AS length, html, NULL::VARCHAR AS error FROM pages
    """,
}
