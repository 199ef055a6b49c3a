"""DuckDB twins of the registered queries, put together from common table expressions."""

from __future__ import annotations

import math

from polyglint.functions import locale as L
from polyglint.functions.text import BLANK, MERGED
from polyglint.operators import detect as D

F0 = D.floor_of(D.ALPHA, D.DAMPENING)
#: Tags with the language and script that they stand for, written down by hand; None: no language.
TAGS = [
    ("ger", "deu", ""), ("deu", "deu", ""), ("DE", "deu", ""), ("de-AT", "deu", ""), ("fre", "fra", ""), ("cy", "cym", ""), ("wel", "cym", ""), ("sv", "swe", ""), ("chi", "zho", ""), ("zh-TW", "zho", "Hant"),
    ("zh-CN", "zho", "Hans"), ("zh-hant", "zho", "Hant"), ("zho-Hans-CN", "zho", "Hans"), ("zho-Hant", "zho", "Hant"), ("zho", "zho", ""), ("sr-Cyrl", "srp", ""), ("sr-Latn", "srp", "Latn"), ("uz-Latn", "uzb", ""), ("az-Cyrl", "aze", "Cyrl"),
    ("az-Latn", "aze", ""), ("bs-Latn", "bos", ""), ("ms-Latn", "msa", ""), ("tk-Latn", "tuk", ""), ("mn-Cyrl", "mon", ""), ("mn-Mong", "mon", "Mong"), ("pa-Guru", "pan", ""), ("pa-Arab", "pan", "Arab"), ("nb", "nob", ""), ("nno", "nno", ""),
    ("nor", "nor", ""), ("no", "nor", ""), ("iw", "heb", ""), ("in", "ind", ""), ("alb", "sqi", ""), ("may", "msa", ""), ("mao", "mri", ""), ("rum", "ron", ""), ("q", None, None), ("", None, None), ("12", None, None), ("english", None, None), ("xx", None, None),
]
#: Languages to look for among the models.
WANTED = ["en", "eng", "ger", "fra", "es", "jpn", "nor", "zho-Hant"]
#: Latin letters, and Cyrillic ones in their place.
CYRILLIC = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "абцдефгхийклмнопярстувшхызАБЦДЕФГХИЙКЛМНОПЯРСТУВШХЫЗ")
_TAGS = ", ".join(f"('{t}', {l and repr(l) or 'NULL'}, {'NULL' if x is None else repr(x)})" for t, l, x in TAGS)


def fold(text: str) -> str:
    out = f"lower(translate({text}, 'Σİ', 'σi'))"
    for pattern, letter in MERGED:
        out = f"regexp_replace({out}, '{pattern}', '{letter}', 'g')"
    return out


def norm(text: str) -> str:
    return f"regexp_replace(' ' || {fold(text)} || ' ', '{BLANK}+', ' ', 'g')"


def grams(name: str, table: str, key: str, text: str = "text", extra: str = "", order: str = "") -> str:
    """name (key, extra..., o, pos, len, ngram); order tells chunks of one key apart."""
    extra = f", {extra}" if extra else ""
    o = order or "0"
    return f"""{name}_n AS (SELECT {key}{extra}, {o} AS o, {norm(text)} AS norm FROM {table} WHERE {text} IS NOT NULL),
        {name}_c AS (SELECT {key}{extra}, o, unnest(string_split(norm, '')) AS ch, generate_subscripts(string_split(norm, ''), 1) - 1 AS pos FROM {name}_n),
        {name}_w AS (SELECT {key}{extra}, o, pos, ch || coalesce(lead(ch, 1) OVER x, '') || coalesce(lead(ch, 2) OVER x, '') || coalesce(lead(ch, 3) OVER x, '') AS w
            FROM {name}_c WINDOW x AS (PARTITION BY {key}, o ORDER BY pos)),
        {name} AS (SELECT {key}{extra}, o, pos, len, substr(w, 1, len) AS ngram FROM {name}_w, (SELECT unnest([1, 2, 3, 4]) AS len) WHERE len <= length(w))"""


def model(source: str = "g", name: str = "m", least: int = 1) -> str:
    """name (lang, ngram, norm_count) from the ngrams of source, which has a column lang."""
    return f"""{name}_t AS (SELECT lang, ngram, count(*) AS n FROM {source} GROUP BY ALL),
        {name} AS (SELECT lang, ngram, floor(n * (1e6 / total::DOUBLE) + 0.5)::BIGINT AS norm_count
            FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM {name}_t) WHERE total >= 16000 AND floor(n * (1e6 / total::DOUBLE) + 0.5) >= {least})"""


TRAIN = grams("g", "documents", "doc_id", extra="lang")
MODEL = f"{TRAIN}, {model()}"
PROBS = "p AS (SELECT ngram, lang, norm_count::DOUBLE / (sum(norm_count) OVER (PARTITION BY ngram))::DOUBLE AS prob FROM m)"


def scored(source: str, key: str, keys: str, prior: str = "0.0", alpha: float = D.ALPHA, damp: float = D.DAMPENING) -> str:
    """post (key, lang, posterior) over the ngrams of source; keys is the relation of all keys."""
    f0 = repr(math.log(alpha + (1 - alpha) * damp))
    return f"""{PROBS},
        tf AS (SELECT {key}, ngram, count(*) AS tf FROM {source} GROUP BY ALL),
        kn AS (SELECT {key}, sum(tf) AS known FROM tf WHERE ngram IN (SELECT ngram FROM m) GROUP BY ALL),
        gain AS (SELECT {key}, p.lang AS l, sum(tf * (ln(prob + (1e0 - prob) * {damp!r}) - ({f0})::DOUBLE)) AS gain FROM tf JOIN p USING (ngram) GROUP BY ALL),
        sc AS (SELECT k.{key}, ls.l, ({prior})::DOUBLE + coalesce(known, 0)::DOUBLE * ({f0})::DOUBLE + coalesce(gain, 0) AS score
            FROM {keys} k CROSS JOIN (SELECT DISTINCT lang AS l FROM m) ls LEFT JOIN kn USING ({key}) LEFT JOIN gain USING ({key}, l)),
        post AS (SELECT {key}, l AS lang, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY {key}) AS posterior FROM (SELECT *, max(score) OVER (PARTITION BY {key}) AS mx FROM sc))"""


def ranked(key: str) -> str:
    return f"r AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY round(posterior, 9) DESC, lang) AS rank, lang, posterior FROM post WHERE posterior >= 0.1)"


DOCS = "(SELECT DISTINCT doc_id FROM documents)"
DETECT = f"{MODEL}, {scored('g', 'doc_id', DOCS)}, {ranked('doc_id')}"
BENCH = f"{MODEL}, {grams('b', 'benchmark', 'item_id')}, {scored('b', 'item_id', '(SELECT DISTINCT item_id FROM benchmark)')}, {ranked('item_id')}"
CHUNKS = f"{MODEL}, {grams('b', 'conversations', 'conv_id', order='turn')}, {scored('b', 'conv_id', '(SELECT DISTINCT conv_id FROM conversations)')}, {ranked('conv_id')}"
JOINED = "j AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)"
PAGE_TEXT = r"""pt AS (SELECT page_id, url, nullif(lower(regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1)), '') AS declared,
            trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|head|nav|footer)[^>]*>.*?</(script|style|head|nav|footer)>', ' ', 'g'),
                '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages)"""
LINES = r"""li AS (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1)::INTEGER AS line_no FROM documents),
        cl AS (SELECT doc_id, lang, line_no, trim(regexp_replace(regexp_replace(trim(line), '\(.+\)', '', 'g'), ':.{1,20}$', '')) AS line FROM li WHERE NOT starts_with(trim(line), '<')),
        clean AS (SELECT * FROM cl WHERE length(line) >= 20)"""
JUDGED = "e AS (SELECT d.doc_id, d.lang AS label, r.lang AS predicted, CASE WHEN d.lang = r.lang THEN 0 ELSE 1 END AS miss FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r.rank = 1)"
MASK = 4294967295
_H = f"(((h + c) & {MASK}) * 1025) & {MASK}"
JOAAT = f"""hs AS (SELECT ngram, (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(ngram, ''), lambda x: unicode(x)::BIGINT)), lambda h, c: xor({_H}, ({_H}) >> 6)) * 9) & {MASK} AS h FROM vocab),
        hh AS (SELECT ngram, (xor(h, h >> 11) * 32769) & {MASK} AS h FROM hs), hashed AS (SELECT ngram, (CASE WHEN h > 2147483647 THEN h - 4294967296 ELSE h END)::INTEGER AS hash FROM hh)"""
# the hashed mode has no blank behind a text and cuts its tail
CLIPPED = f"""cn AS (SELECT doc_id, lang, CASE WHEN length(x) > 1 THEN rtrim(x) ELSE x END AS norm FROM (SELECT doc_id, lang, regexp_replace(' ' || {fold('text')}, '{BLANK}+', ' ', 'g') AS x FROM documents WHERE text IS NOT NULL)),
        cc AS (SELECT doc_id, lang, length(norm) AS size, unnest(string_split(norm, '')) AS ch, generate_subscripts(string_split(norm, ''), 1) - 1 AS pos FROM cn),
        cw AS (SELECT lang, size, pos, ch || coalesce(lead(ch, 1) OVER x, '') || coalesce(lead(ch, 2) OVER x, '') || coalesce(lead(ch, 3) OVER x, '') AS w FROM cc WINDOW x AS (PARTITION BY doc_id ORDER BY pos)),
        cg AS (SELECT lang, substr(w, 1, len) AS ngram, count(*) AS n FROM cw, (SELECT unnest([1, 2, 3, 4]) AS len) WHERE len <= length(w) AND pos <= greatest(0, size - 3) GROUP BY ALL),
        vocab AS (SELECT DISTINCT ngram FROM cg), {JOAAT},
        hc AS (SELECT lang, hash AS ngram, sum(n) AS n FROM cg JOIN hashed USING (ngram) GROUP BY ALL)"""
def stopped(source: str, key: str, keys: str, order: str = "") -> str:
    """fin (key, lang, posterior, read): detection up to the step at which two looks agree; st (key, step, sure)."""
    return f"""{MODEL}, {PROBS},
        kn AS (SELECT {key}, ngram, row_number() OVER (PARTITION BY {key} ORDER BY {order}pos, len) AS k FROM {source} WHERE ngram IN (SELECT ngram FROM m)),
        tf AS (SELECT {key}, ceil(k / 110.0)::INTEGER AS step, ngram, count(*) AS tf FROM kn GROUP BY ALL),
        seen AS (SELECT {key}, step, sum(tf) AS seen FROM tf GROUP BY ALL),
        gn AS (SELECT {key}, step, lang, sum(tf * (ln(prob + (1e0 - prob) * 0.001) - ({F0!r})::DOUBLE)) AS gain FROM tf JOIN p USING (ngram) GROUP BY ALL),
        cs AS (SELECT {key}, step, ls.lang, sum(seen) OVER x AS read, sum(coalesce(gain, 0)) OVER x AS gain FROM seen CROSS JOIN (SELECT DISTINCT lang FROM m) ls LEFT JOIN gn USING ({key}, step, lang)
            WINDOW x AS (PARTITION BY {key}, ls.lang ORDER BY step ROWS UNBOUNDED PRECEDING)),
        ex AS (SELECT {key}, step, lang, read, exp(s - max(s) OVER (PARTITION BY {key}, step)) AS e FROM (SELECT *, read::DOUBLE * ({F0!r})::DOUBLE + gain AS s FROM cs)),
        po AS (SELECT *, e / sum(e) OVER (PARTITION BY {key}, step) AS posterior FROM ex),
        lo AS (SELECT {key}, step, max(CASE WHEN posterior > 0.99 AND read = step * 110 THEN lang END) AS leader FROM po GROUP BY ALL),
        la AS (SELECT *, lag(leader) OVER (PARTITION BY {key} ORDER BY step) AS before FROM lo),
        st AS (SELECT {key}, coalesce(min(CASE WHEN leader = before THEN step END), max(step)) AS step, coalesce(bool_or(leader = before), false) AS sure FROM la GROUP BY ALL),
        fin AS (SELECT {key}, lang, posterior, read FROM po JOIN st USING ({key}, step) UNION ALL
            SELECT d.{key}, ls.lang, 1e0 / count(*) OVER (PARTITION BY d.{key}), 0 FROM {keys} d CROSS JOIN (SELECT DISTINCT lang FROM m) ls WHERE d.{key} NOT IN (SELECT {key} FROM st))"""


STOP = f"""{stopped('g', 'doc_id', DOCS)}
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(posterior, 9) DESC, lang)::INTEGER AS rank, lang, round(posterior, 6) AS posterior, read::BIGINT AS stopped_at FROM fin WHERE posterior >= 0.1"""
CONVERSATIONS = "(SELECT DISTINCT conv_id FROM conversations)"
SURE = f"""{stopped('b', 'conv_id', CONVERSATIONS, 'o, ').replace(PROBS + ',', PROBS + ', ' + grams('b', 'conversations', 'conv_id', order='turn') + ',')},
        rk AS (SELECT conv_id, lang, posterior, read, row_number() OVER (PARTITION BY conv_id ORDER BY round(posterior, 9) DESC, lang) AS rank FROM fin)
        SELECT conv_id, read::BIGINT AS stopped_at, coalesce(sure, false) AS enough, CASE WHEN posterior >= 0.1 THEN lang END AS lang, CASE WHEN posterior >= 0.1 THEN round(posterior, 6) END AS posterior
        FROM rk LEFT JOIN st USING (conv_id) WHERE rank = 1"""
TRACE = f"""{MODEL}, {PROBS}, {grams('b', 'benchmark', 'item_id')},
        kn AS (SELECT item_id, ngram, row_number() OVER (PARTITION BY item_id ORDER BY pos, len) AS k FROM b WHERE ngram IN (SELECT ngram FROM m)),
        rs AS (SELECT item_id, k, ngram, ls.lang, prob, sum(ln(coalesce(prob, 2e-6) + (1e0 - coalesce(prob, 2e-6)) * 0.001)) OVER (PARTITION BY item_id, ls.lang ORDER BY k) AS s
            FROM kn CROSS JOIN (SELECT DISTINCT lang FROM m) ls LEFT JOIN p USING (ngram, lang)),
        ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY item_id, k)) AS e FROM rs),
        po AS (SELECT *, e / sum(e) OVER (PARTITION BY item_id, k) AS posterior FROM ex)
        SELECT item_id, k::INTEGER AS k, ngram, lang, round(prob, 6) AS prob, round(posterior, 6) AS posterior FROM po WHERE posterior >= 5e-7"""
_GRID = " UNION ALL ".join(f"SELECT {a!r}::DOUBLE AS alpha, {d!r}::DOUBLE AS dampening" for a in (2e-6, 1e-4) for d in (1e-3, 2e-2))
TUNE = f"""{MODEL}, {PROBS}, grid AS ({_GRID}), tf AS (SELECT doc_id, ngram, count(*) AS tf FROM g GROUP BY ALL),
        gn AS (SELECT alpha, dampening, doc_id, p.lang AS l, sum(tf * (ln(prob + (1e0 - prob) * dampening) - ln(alpha + (1e0 - alpha) * dampening))) AS gain FROM tf JOIN p USING (ngram) CROSS JOIN grid GROUP BY ALL),
        al AS (SELECT g.alpha, g.dampening, d.doc_id, d.lang AS label, ls.l AS lang, coalesce(gain, 0) AS gain FROM documents d CROSS JOIN grid g CROSS JOIN (SELECT DISTINCT lang AS l FROM m) ls
            LEFT JOIN gn ON gn.alpha = g.alpha AND gn.dampening = g.dampening AND gn.doc_id = d.doc_id AND gn.l = ls.l),
        tp AS (SELECT *, row_number() OVER (PARTITION BY alpha, dampening, doc_id ORDER BY round(gain, 6) DESC, lang) AS rank FROM al)
        SELECT alpha, dampening, count(*) AS texts, sum(CASE WHEN lang = label THEN 0 ELSE 1 END)::BIGINT AS errors FROM tp WHERE rank = 1 GROUP BY ALL"""
ISO = "CASE {0} WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' WHEN 'it' THEN 'ita' WHEN 'nl' THEN 'nld' WHEN 'pt' THEN 'por' ELSE {0} END"
HELD = "('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT < 858993459"
HOLDOUT = f"""tr AS (SELECT * FROM documents WHERE NOT ({HELD})), te AS (SELECT * FROM documents WHERE {HELD}),
        {grams('g', 'tr', 'doc_id', extra='lang')}, {model()}, {grams('b', 'te', 'doc_id')}, {scored('b', 'doc_id', '(SELECT DISTINCT doc_id FROM te)')}, {ranked('doc_id')},
        e AS (SELECT te.doc_id, te.lang AS label, r.lang AS predicted, CASE WHEN te.lang = r.lang THEN 0 ELSE 1 END AS miss FROM te LEFT JOIN r ON r.doc_id = te.doc_id AND r.rank = 1)"""
RATES = "SELECT label, count(*) AS texts, sum(miss)::BIGINT AS errors, round(avg(miss), 6) AS rate FROM e GROUP BY ROLLUP (label)"
TOP = "SELECT {0}, lang, round(posterior, 6) AS posterior FROM r WHERE rank = 1"

_NAMES = " ".join(f"WHEN '{code}' THEN '{shown}'" for code, shown in sorted(L.NAMES.items()))
SHOWN = f"CASE lang {_NAMES} ELSE lang END"
BEYOND = rf"""tw AS (SELECT doc_id, text || chr(10) || translate(text, '{CYRILLIC[0]}', '{CYRILLIC[1]}') AS text FROM documents),
        al AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1)::INTEGER AS line_no FROM tw),
        bl AS (SELECT doc_id, line_no, line FROM al WHERE length(trim(line)) > 0 AND unicode(substr(trim(line), 1, 1)) > 255)"""

SQL: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "ngram_counts": f"WITH {TRAIN} SELECT lang, ngram, count(*) AS n FROM g GROUP BY ALL",
    "ngram_total_by_lang": f"WITH {TRAIN} SELECT lang, count(*) AS total, count(DISTINCT ngram) AS distinct_ngrams FROM g GROUP BY ALL",
    "model_normalized": f"WITH {MODEL} SELECT * FROM m",
    "model_min_frequency": f"WITH {TRAIN}, {model(least=20)} SELECT * FROM m",
    "model_size": f"WITH {MODEL} SELECT lang, count(*) AS ngrams, '''' || lang || ''': ' || count(*) || ' ngrams' AS description FROM m GROUP BY lang",
    "model_max_length": f"WITH {MODEL} SELECT max(length(ngram))::INTEGER AS max_n FROM m",
    "model_prune": f"WITH {MODEL} SELECT lang, count(*) FILTER (norm_count >= 20) AS kept, count(*) FILTER (norm_count < 20) AS dropped FROM m GROUP BY lang",
    "model_equal": "SELECT false AS equal",
    "ngram_lookup": f"""WITH {MODEL}, {grams('b', 'benchmark', 'item_id')}, want AS (SELECT * FROM (SELECT DISTINCT lang FROM m), (SELECT DISTINCT ngram FROM b))
        SELECT lang, ngram, coalesce(norm_count, 0)::BIGINT AS norm_count FROM want LEFT JOIN m USING (lang, ngram)""",
    "ngram_singletons": f"WITH {MODEL} SELECT ngram, min(lang) AS lang FROM m GROUP BY ngram HAVING count(*) = 1",
    "ngram_shared": f"WITH {MODEL} SELECT ngram, count(*) AS langs FROM m GROUP BY ngram HAVING count(*) > 1",
    "ngram_set_operations": f"""WITH {MODEL}, a AS (SELECT ngram FROM m WHERE lang = 'en'), b AS (SELECT ngram FROM m WHERE lang = 'fr')
        SELECT 'union' AS operation, count(*) AS ngrams FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersection', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
        UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "lang_overlap": f"""WITH {MODEL}, z AS (SELECT lang, count(*) AS n FROM m GROUP BY lang), s AS (SELECT a.lang AS lang_a, b.lang AS lang_b, count(*) AS shared FROM m a JOIN m b ON a.ngram = b.ngram AND a.lang < b.lang GROUP BY ALL)
        SELECT x.lang AS lang_a, y.lang AS lang_b, coalesce(shared, 0) AS shared, x.n + y.n - coalesce(shared, 0) AS either, round(100.0::DOUBLE * coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)), 6) AS percent
        FROM z x JOIN z y ON x.lang < y.lang LEFT JOIN s ON s.lang_a = x.lang AND s.lang_b = y.lang""",
    "lang_separability": f"""WITH {MODEL}, x AS (SELECT a.lang AS lang_a, l.lang AS lang_b, a.norm_count AS ca, coalesce(b.norm_count, 0) AS cb FROM m a JOIN (SELECT DISTINCT lang FROM m) l ON a.lang <> l.lang LEFT JOIN m b ON b.lang = l.lang AND b.ngram = a.ngram)
        SELECT lang_a, lang_b, round(sum(floor((ca + cb) / 1e3 + 0.5) * (ln(ca::DOUBLE / (ca + cb)) - ln(CASE WHEN cb = 0 THEN 2e-6 ELSE cb::DOUBLE / (ca + cb) END))), 6) AS log_odds FROM x GROUP BY ALL""",
    "ngram_probability": f"WITH {MODEL}, {PROBS} SELECT ngram, lang, round(prob, 9) AS prob FROM p",
    "ngram_probability_subset": f"WITH {TRAIN}, {model(name='mm')}, m AS (SELECT * FROM mm WHERE lang IN ('en', 'fr')), {PROBS} SELECT ngram, lang, round(prob, 9) AS prob FROM p",
    "detect_full": f"WITH {DETECT} SELECT doc_id, rank::INTEGER AS rank, lang, round(posterior, 6) AS posterior FROM r",
    "detect_top1": f"WITH {DETECT} {TOP.format('doc_id')}",
    "detect_benchmark": f"WITH {BENCH} {TOP.format('item_id')}",
    "detect_margin": f"""WITH {DETECT} SELECT a.doc_id, a.lang, round(a.posterior, 6) AS posterior, b.lang AS second_lang, round(b.posterior, 6) AS second_posterior
        FROM r a LEFT JOIN r b ON b.doc_id = a.doc_id AND b.rank = 2 WHERE a.rank = 1""",
    "detect_confidence": f"""WITH {DETECT} SELECT doc_id, lang, CASE WHEN posterior > 0.9 THEN 'HIGH' WHEN posterior > 0.7 THEN 'MEDIUM' WHEN posterior > 0 THEN 'LOW' ELSE 'NONE' END AS confidence,
        'Language ''' || lang || ''' with score ' || printf('%.6f', round(posterior, 6)) || ' and confidence ' || printf('%.6f', round(posterior, 6)) AS described FROM r WHERE rank = 1""",
    "detect_good": f"WITH {DETECT} SELECT doc_id, lang FROM r WHERE posterior > 0.99",
    "detect_priors": f"""WITH {MODEL}, {scored('g', 'doc_id', DOCS, "ln(CASE ls.l WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.3 ELSE 0.1 END)")}, {ranked('doc_id')} {TOP.format('doc_id')}""",
    "detect_unknown_ratio": f"""WITH {MODEL}, u AS (SELECT doc_id, count(*) FILTER (ngram IN (SELECT ngram FROM m)) AS known, count(*) AS total FROM g GROUP BY doc_id)
        SELECT d.doc_id, coalesce(known, 0)::BIGINT AS known, (coalesce(total, 0) - coalesce(known, 0))::BIGINT AS unknown FROM {DOCS} d LEFT JOIN u USING (doc_id)""",
    "detect_early_stop": f"WITH {STOP}",
    "detect_trace": f"WITH {TRACE}",
    "eval_error_rate": f"WITH {DETECT}, {JUDGED} {RATES}",
    "eval_single_rate": f"WITH {DETECT}, {JUDGED} SELECT round(avg(miss), 6) AS rate FROM e",
    "eval_confusion": f"""WITH {DETECT}, {JUDGED}, c AS (SELECT label, predicted, miss, count(*) AS n FROM e GROUP BY ALL)
        SELECT label, predicted, n, CASE WHEN miss = 1 THEN round(n::DOUBLE / (sum(n) OVER (PARTITION BY label, miss))::DOUBLE, 6) END AS share_of_misses FROM c""",
    "eval_holdout": f"WITH {HOLDOUT} {RATES}",
    "eval_spread": f"WITH {HOLDOUT}, q AS ({RATES}) SELECT min(rate) AS least, max(rate) AS most, round(avg(rate), 6) AS mean, round(stddev_samp(rate), 6) AS deviation FROM q WHERE label IS NOT NULL",
    "tune_grid": f"WITH {TUNE}",
    "locale_canonical": f"""WITH t AS (SELECT DISTINCT lang AS tag, {ISO.format('lang')} AS lang, '' AS script FROM documents UNION SELECT * FROM (VALUES {_TAGS}) v (tag, lang, script) WHERE lang IS NOT NULL)
        SELECT tag, lang, script, n AS name, n || ' (' || {SHOWN} || ')' AS display FROM (SELECT *, CASE WHEN script = '' THEN lang ELSE lang || '-' || script END AS n FROM t)""",
    "locale_rejected": f"SELECT tag FROM (VALUES {_TAGS}) v (tag, lang, script) WHERE lang IS NULL",
    "locale_weak_match": f"""WITH t AS (SELECT * FROM (VALUES {_TAGS}) v (tag, lang, script) WHERE lang IS NOT NULL)
        SELECT a.tag AS result, b.tag AS target, (a.lang = b.lang OR (a.lang IN ('nob', 'nno') AND b.lang = 'nor')) AND (b.script = '' OR a.script = b.script) AS weakly, a.lang = b.lang AND a.script = b.script AS strictly FROM t a, t b""",
    "model_presence": f"""WITH {MODEL}, w AS (SELECT unnest({WANTED!r}) AS tag)
        SELECT tag, CASE tag WHEN 'eng' THEN 'en' WHEN 'ger' THEN 'de' WHEN 'fra' THEN 'fr' ELSE tag END IN (SELECT lang FROM m) AS has_model FROM w""",
    "model_core_load": f"WITH {MODEL} SELECT lang, ngram, norm_count FROM m WHERE lang IN ('en', 'de', 'fr', 'es')",
    "model_kept_load": f"WITH {MODEL} SELECT lang, ngram, norm_count FROM m",
    "model_dump": f"WITH {MODEL} SELECT lang, ngram || chr(9) || norm_count AS line FROM m",
    "sql_ngrams": f"WITH {TRAIN} SELECT len, ngram, count(*) AS n FROM g WHERE len <= 3 GROUP BY ALL",
    "sql_detect": f"WITH {DETECT} {TOP.format('doc_id')}",
    "stream_until_sure": f"WITH {SURE}",
    "supported_docs": f"WITH {MODEL} SELECT doc_id, lang FROM documents WHERE lang IN (SELECT lang FROM m)",
    "chunked_detect": f"WITH {CHUNKS} {TOP.format('conv_id')}",
    "stream_detect": f"WITH {CHUNKS} {TOP.format('conv_id')}",
    "conversation_lang": f"WITH {MODEL}, {JOINED}, {grams('b', 'j', 'conv_id')}, {scored('b', 'conv_id', '(SELECT DISTINCT conv_id FROM j)')}, {ranked('conv_id')} {TOP.format('conv_id')}",
    "pages_text": f"WITH {PAGE_TEXT} SELECT page_id, declared, text FROM pt WHERE length(text) >= 100",
    "pages_detect_vs_declared": f"""WITH {MODEL}, {PAGE_TEXT}, {grams('b', 'pt', 'page_id')}, {scored('b', 'page_id', '(SELECT DISTINCT page_id FROM pt)')}, {ranked('page_id')}
        SELECT declared, lang AS detected, count(*) AS pages FROM r JOIN pt USING (page_id) WHERE rank = 1 GROUP BY ALL""",
    "pages_host": r"SELECT page_id, nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '') AS host FROM pages",
    "corpus_languages": "SELECT DISTINCT lang FROM documents",
    "corpus_clean_lines": f"WITH {LINES} SELECT * FROM clean",
    "corpus_sample": f"""WITH {LINES}, o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('/', doc_id::VARCHAR, line_no::VARCHAR)), doc_id, line_no) AS r, count(*) OVER (PARTITION BY lang) AS s FROM clean)
        SELECT doc_id, lang, line_no, line FROM o WHERE r <= floor(s * 0.1::DOUBLE + 0.5)""",
    "corpus_merged_lines": r"""WITH l AS (SELECT lang, unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM documents),
        c AS (SELECT lang, trim(regexp_replace(regexp_replace(line, '\[[ ]*\d+[ ]*\]', ' ', 'g'), '[ \t]+', ' ', 'g')) AS line FROM l) SELECT * FROM c WHERE length(line) > 0""",
    "lang_char_budget": """WITH b AS (SELECT doc_id, lang, n_chars, coalesce(sum(least(n_chars, 10240)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM documents)
        SELECT * FROM b WHERE chars_before < 100000""",
    "lang_budget_complete": """WITH b AS (SELECT lang, n_chars, coalesce(sum(least(n_chars, 10240)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
        SELECT lang, sum(least(n_chars, 10240))::BIGINT AS chars, sum(least(n_chars, 10240)) >= 100000 AS complete FROM b WHERE before < 100000 GROUP BY lang""",
    "non_latin_lines": f"WITH {BEYOND} SELECT * FROM bl",
    "non_latin_report": f"""WITH {MODEL}, {BEYOND}, bk AS (SELECT *, doc_id || '/' || line_no AS k FROM bl), {grams('b', 'bk', 'k', 'line')}, {scored('b', 'k', '(SELECT k FROM bk)')}, {ranked('k')}
        SELECT doc_id, line_no, line, x.lang, round(x.posterior, 6) AS posterior, y.lang AS second_lang, round(y.posterior, 6) AS second_posterior
        FROM bk LEFT JOIN r x ON x.k = bk.k AND x.rank = 1 LEFT JOIN r y ON y.k = bk.k AND y.rank = 2 WHERE coalesce(x.lang, '') <> 'en'""",
    "joaat_ngrams": f"WITH {TRAIN}, vocab AS (SELECT DISTINCT ngram FROM g), {JOAAT} SELECT ngram, hash FROM hashed",
    "hashed_counts": f"WITH {CLIPPED} SELECT lang, ngram, n::BIGINT AS n FROM hc",
    "model_roundtrip": f"""WITH {CLIPPED} SELECT lang, 4 AS max_n, ngram, floor(n * (1e6 / total::DOUBLE) + 0.5)::BIGINT AS norm_count FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM hc)
        WHERE total >= 16000 AND floor(n * (1e6 / total::DOUBLE) + 0.5) >= 1""",
    "model_text_roundtrip": f"WITH {MODEL} SELECT lang, 4 AS max_n, ngram, norm_count FROM m",
    "model_tier_roundtrip": f"WITH {MODEL} SELECT lang, ngram, norm_count FROM m",
    "labelled_roundtrip": r"SELECT lang, regexp_replace(text, '[\r\n]+', ' ', 'g') AS text, true AS valid FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL",
}
