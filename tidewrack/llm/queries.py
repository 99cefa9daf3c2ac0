"""The queries opN_<name>: each operator over its whole table with production parameters, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, collocations, decontamination, jaccard_join, language_id, language_model, periodic_runs, quality_model, quality_rules, secrets, substring_dedup, url_filter
from .shared import table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def word_bpe() -> str:
    """The production tokenizer's file, found by the package that brings it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), word_bpe())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_model.held_out(F.col("doc_id"), 4, 2)
    model = quality_model.train(docs, table(spark, sf_dir, "labels").where(~out))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_model.held_out(F.col("doc_id"), 3, 1)
    return language_id.predict(docs, ~out).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_model.held_out(F.col("doc_id"), 10, 0)
    scored = language_model.score(table(spark, sf_dir, "documents"), ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.planted(table(spark, sf_dir, "documents"))
    found = periodic_runs.find(docs, min_exponent=4, min_length=6)
    first = F.array_max(F.transform("runs", lambda x: F.struct(x["length"], (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    found = found.withColumn("first", first)
    every = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), F.concat(x["period"].cast("string"), F.lit("\n")))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("first.start")).alias("start"), F.col("first.length").alias("length"), (-F.col("first.period")).alias("period"),
        F.expr("1000 * first.length div -first.period").alias("exponent_milli"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.digests(chat_format.format_parts(rows.unionByName(more)))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), max_words=3, least=10, share=50, top=2000)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_bpe, op3_substring_dedup, op4_quality_model, op5_decontamination, op6_language_id, op7_secrets, op8_quality_rules, op9_jaccard_join, op10_language_model, op11_periodic_runs, op12_chat_format, op13_collocations)}

_URL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
numbered AS (SELECT *, row_number() OVER () AS k FROM parts),
fits AS (
  SELECT k, rh || rp AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, length(rh) DESC) AS r
  FROM numbered JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM fits WHERE r = 1) USING (k)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"'[^\x20\x09-\x0D]+'"

_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
e AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END AS win FROM w, unnest(range(1, len(ws) + 1)) AS u(i)),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS met FROM e),
c AS (SELECT doc_id, i, word, bool_or(met) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAMINATED = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win FROM b, unnest(range(1, greatest(2, len(ws) - 8))) AS u(i) WHERE len(ws) > 0),
spots AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM wins), unnest(range(1, len(ws) - n + 2)) AS u(i)),
hits AS (SELECT doc_id, i, n, item FROM spots JOIN wins USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM w, unnest(range(1, greatest(2, len(ws) - 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
"""

_PARTS = [f"len(regexp_extract_all(rare, '{p}'))" for p in ("[A-Z]", "[0-9]", "[.,;:!?''\"()-]", "[#*$%&|<>]")]
_QUALITY = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws, regexp_replace(coalesce(text, ''), '[a-z\x20\x{{00C0}}-\x{{024F}}]+', '', 'g') AS rare FROM documents),
wins AS (SELECT doc_id, i, CASE WHEN i + 7 <= len(ws) THEN array_to_string(ws[i:i + 7], ' ') END AS win FROM w, unnest(range(1, len(ws) + 1)) AS u(i)),
twice AS (SELECT doc_id, i, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS t FROM wins),
covered AS (SELECT doc_id, bool_or(t) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM twice),
rep AS (SELECT doc_id, count(*) FILTER (c) AS n FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, {_WORDS}) GROUP BY doc_id),
lead AS (SELECT lang, word, k FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k FROM (SELECT lang, unnest(ws) AS word FROM w WHERE lang IS NOT NULL) GROUP BY lang, word) WHERE k <= 12),
listed AS (SELECT doc_id, k, count(*) AS c FROM (SELECT doc_id, lang, unnest(ws) AS word FROM w) JOIN lead USING (lang, word) GROUP BY ALL),
cells AS (
  SELECT doc_id, lang, 'w' AS kind, k, coalesce(c, 0) AS c FROM w JOIN lead USING (lang) LEFT JOIN listed USING (doc_id, k)
  UNION ALL SELECT doc_id, lang, 'w', 99, len(ws) - coalesce(n, 0) FROM w LEFT JOIN (SELECT doc_id, sum(c) AS n FROM listed GROUP BY doc_id) USING (doc_id)
  UNION ALL SELECT doc_id, lang, 'c', k, c FROM (SELECT doc_id, lang, unnest([length(t) - length(rare), {', '.join(_PARTS)}, length(rare) - {' - '.join(_PARTS)}]) AS c, unnest([0, 1, 2, 3, 4, 5]) AS k FROM w)),
shares AS (SELECT doc_id, lang, kind, k, c / greatest(sum(c) OVER (PARTITION BY doc_id, kind), 1) AS p FROM cells),
refs AS (SELECT lang, kind, k, sum(c) / sum(sum(c)) OVER (PARTITION BY lang, kind) AS q FROM cells GROUP BY lang, kind, k),
far AS (SELECT doc_id, kind, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0)) AS d FROM shares JOIN refs USING (lang, kind, k) GROUP BY doc_id, kind),
over AS (SELECT doc_id, bool_or(d > CASE kind WHEN 'w' THEN 0.31 ELSE 0.28 END) AS o FROM far GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(rare, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, o FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN over USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (n_words < 40 OR NOT coalesce(o, false)) AS kept FROM failed
"""

#: CRC-32 of a decimal number, by the table that its polynomial gives.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda b: list_reduce([CAST(b AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END)) AS tab)"


def _crc32(number: str) -> str:
    """SQL for the unsigned CRC-32 of a number's digits; a column tab must hold the table."""
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(unicode(x) AS UBIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {codes}), lambda c, b: xor(tab[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8)), CAST(4294967295 AS UBIGINT))"


_RUNS = f"""
WITH h AS (SELECT doc_id, CAST({_crc32("doc_id")} AS BIGINT) AS h, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents, {_CRC_TABLE}),
a AS (SELECT *, h // 10 AS g, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a FROM h),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM a),
e AS (SELECT doc_id, n, i, ws[i + 1] AS word FROM w, unnest(range(n)) AS u(i)),
same AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
numbered AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS s FROM same),
long AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM numbered GROUP BY doc_id, p, s HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM long GROUP BY doc_id, start, length),
best AS (SELECT doc_id, count(*) AS n_runs, min_by(struct_pack(s := start, l := length, p := period), struct_pack(l := -length, s := start, p := period)) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS u(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: The control strings of chat_format as a pattern; none can overlap another, so matches are all that there are.
_CONTROLS = r"'</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[/TURN\]'"
_GUARDED = lambda c: f"(length({c}) + length({c}) - length(replace({c}, chr(92), '')) + len(regexp_extract_all({c}, {_CONTROLS})))"
_CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_GUARDED("text")} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 17 ELSE 20 + {_GUARDED("role")} END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_PHRASES = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM p, (VALUES (1), (2), (3)) AS s(k), unnest(range(1, len(ws) - k + 2)) AS u(i) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2 AND f >= 10),
cuts AS (SELECT c.lang, c.k, c.phrase, a, j, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c, unnest(range(1, c.k)) AS u(j) JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:j], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(ws[j + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS over FROM (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) LEFT JOIN longer USING (lang, phrase) WHERE over IS NULL OR 100 * over < 50 * a QUALIFY rank <= 2000
"""

ORACLE_SQL = {"op1_url_filter": _URL, "op3_substring_dedup": _DEDUP, "op5_decontamination": _CONTAMINATED, "op8_quality_rules": _QUALITY, "op9_jaccard_join": _JOIN, "op11_periodic_runs": _RUNS, "op12_chat_format": _CHAT, "op13_collocations": _PHRASES}
