"""Queries over the test tables, one or more for each operator, with DuckDB SQL for each.

The tables hold invented prose, so queries that need vocabularies, catalogues
or messages bring their own small ones as rows; the operators are those of
production. "now" is always a parameter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import names as N
from ..functions import text as X
from ..functions import urls as U
from ..functions import vocab
from ..operators import enrich, resolve, serving, tables
from ..sources import config, feeds

NOW = dt.datetime(2024, 1, 29)
TERMS = ["licensed", "thertion", "reserved", "queelle", "ungver", "ciónla"]
THEMES = {"terms": ["licensed", "rights reserved", " license"], "english": [" the ", " of "], "french": [" les ", " des "], "german": [" und ", " der "], "spanish": [" los ", " una "], "letters": ["tion", "ung"]}
TAGS = ["license", "spam", "error", "view"]

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- SQL twins of functions ----

WS = X.WS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sql_squeeze(c: str) -> str:
    return sql_trim(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


def sql_clip(c: str, n: int) -> str:
    s = sql_squeeze(f"coalesce({c}, '')")
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE regexp_replace(regexp_replace(substring({s}, 1, {n - 1}), '{WS}+[^\\s]*$', ''), '{WS}+$', '') || '…' END"


def sql_entities(c: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("mdash", "—"), ("ndash", "–"), ("hellip", "…"), ("#39", "'"), ("amp", "&")):
        c = f"replace({c}, '&{name};', {q(char)})"
    return c


def sql_norm(c: str) -> str:
    return f"' ' || regexp_replace(lower(coalesce({c}, '')), '{WS}+', ' ', 'g') || ' '"


def sql_any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def sql_clean(c: str) -> str:
    return f"trim(regexp_replace(replace(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[.]', '', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def sql_norm_company(c: str) -> str:
    return f"regexp_replace({sql_clean(c)}, '^(\\S+(?: \\S+)*?)(?: (?:{'|'.join(vocab.COMPANY_SUFFIXES)}))+$', '\\1')"


def sql_dice(a: str, b: str) -> str:
    grams = lambda s: f"list_transform(range(1, length({s})), lambda i: substring({s}, i, 2))"
    count = lambda s: f"len(list_filter({grams(s)}, lambda y: y = x))"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0 ELSE 2.0 * list_sum(list_transform(list_distinct({grams(a)}), lambda x: least({count(a)}, {count(b)}))) / (length({a}) + length({b}) - 2) END"


_QUERY = "coalesce(nullif(regexp_extract(trim(url), '^[^?#]*[?]([^#]*)', 1), ''), '')"
CANON = f"""(SELECT page_id, url, html,
    lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '')
    || CASE WHEN regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[^?#]*)', 1), '/+$', '') END
    || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS canon
  FROM (SELECT *, list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^({"|".join(vocab.TRACKING)})'))) AS kept FROM pages))"""


# ---- urls and pages ----


@query(f"SELECT page_id, canon AS canonical_url, sha256(canon) AS url_hash FROM {CANON}")
def canonical_urls(spark, d):
    c = U.canonical_url(F.col("url"))
    return t(spark, d, "pages").select("page_id", c.alias("canonical_url"), U.url_hash(c).alias("url_hash"))


@query(f"SELECT canon AS url, min(page_id) AS page_id FROM {CANON} GROUP BY canon")
def dedup_pages(spark, d):
    p = t(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"))
    return tables.first_by(p, ["url"], ["page_id"])


@query(f"SELECT url, arg_min(page_id, page_id) AS page_id, sha256(url) AS url_hash FROM (SELECT page_id, canon AS url FROM {CANON}) GROUP BY url")
def page_index(spark, d):
    """Pages as items: canonical url and hash, the first page of each url."""
    p = t(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"))
    return tables.first_by(p, ["url"], ["page_id"]).withColumn("url_hash", U.url_hash(F.col("url")))


_TITLE = sql_squeeze(sql_entities("regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')"))


@query(f"SELECT page_id, nullif({_TITLE}, '') AS title, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS image_url FROM pages")
def page_meta(spark, d):
    return feeds.extract_meta(t(spark, d, "pages")).select("page_id", "title", "summary", "image_url")


def _sql_html_text() -> str:
    s = "coalesce(html, '')"
    for tag in ("script", "style", "noscript", "nav", "header", "footer", "aside", "form"):
        s = f"regexp_replace({s}, '<{tag}.*?</{tag}>', ' ', 'gis')"
    # Without back-references each container has its own pattern; pages have one kind of junk container.
    for _ in range(3):
        for tag in ("div", "section", "ul", "ol", "aside"):
            s = f"""regexp_replace({s}, '<{tag}[^>]*\\b(?:class|id)\\s*=\\s*["''][^"'']*(?:{vocab.JUNK_PARTS})[^"'']*["''][^>]*>.*?</{tag}>', ' ', 'gis')"""
    s = f"regexp_replace({s}, '<ul[^>]*>(?:[^<]|<[^a/]|<a[^\\s>]|</[^u]|</u[^l])*(?:<a\\b(?:[^<]|<[^a/]|<a[^\\s>]|</[^u]|</u[^l])*){{3,}}</ul>', ' ', 'gis')"
    s = f"coalesce(nullif(regexp_extract({s}, '(?is)<article.*?</article>'), ''), {s})"
    s = sql_entities(f"regexp_replace(regexp_replace({s}, '</(?:p|div|li|h[1-6]|br|tr|section)>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')")
    return sql_trim(f"regexp_replace(regexp_replace(regexp_replace({s}, '[ \\t\\f\\x0B]+', ' ', 'g'), '{WS}*\\n{WS}*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


_MARK = "least(" + ", ".join(f"coalesce(nullif(strpos(substring(lower(s), 401), {q(m)}), 0) + 400, 1000000000)" for m in vocab.CUT_MARKERS) + ")"


@query(f"SELECT page_id, {sql_trim(f'substring(s, 1, {_MARK} - 1)')} AS body FROM (SELECT page_id, {_sql_html_text()} AS s FROM pages)")
def html_text(spark, d):
    return t(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("body"))


@query("SELECT page_id, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(url, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % 5 + 1 AS INTEGER) AS placeholder FROM pages")
def page_placeholder(spark, d):
    return t(spark, d, "pages").select("page_id", X.placeholder(F.col("url")).alias("placeholder"))


_PATH = "coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/')"


@query(f"""SELECT page_id FROM pages WHERE lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)) = lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1))
  AND length({_PATH}) >= 6 AND NOT regexp_matches({_PATH}, '(?i)/(category|tag|tags|author|page|topics?|section|feed|wp-|search)\\b')
  AND NOT regexp_matches({_PATH}, '(?i)\\.(jpg|jpeg|png|webp|gif|pdf|xml)$') AND regexp_matches(regexp_extract({_PATH}, '([^/]*)/*$', 1), '(?i)[a-z]{{4}}')""")
def article_url_filter(spark, d):
    return t(spark, d, "pages").where(U.looks_like_article(F.col("url"), U.origin(F.col("url")))).select("page_id")


_HOST = "nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:@]+)', 1)), '^www\\.', ''), '')"


@query(f"SELECT host, count(*) AS n, count(*) FILTER (contains(url, '?')) AS with_query FROM (SELECT *, {_HOST} AS host FROM pages) GROUP BY host")
def host_counts(spark, d):
    return t(spark, d, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count_if(F.contains("url", F.lit("?"))).alias("with_query"))


# ---- classification ----


@query(f"SELECT doc_id FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS k FROM labels WHERE toxic = 1) ON k = doc_id WHERE k IS NOT NULL OR {sql_any(sql_norm('text'), TERMS)}")
def relevance_gate(spark, d):
    special = t(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("specialist")).distinct()
    return t(spark, d, "documents").join(special, "doc_id", "left").where(C.is_relevant(F.col("text"), F.col("specialist"), TERMS)).select("doc_id")


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {sql_any('t', words)} THEN {q(name)} END" for name, words in THEMES.items()) + "], lambda x: x IS NOT NULL)"
_TAGGED = f"(SELECT *, {_TAGS} AS themes FROM (SELECT *, {sql_norm('text')} AS t FROM documents))"


@query(f"SELECT doc_id, array_to_string(list_concat(themes, [lower(source), 'region-' || lang]), ',') AS tags FROM {_TAGGED}")
def theme_tags(spark, d):
    tags = C.tag_item(F.col("text"), F.array("source"), F.lit("regional"), F.concat("lang", F.lit("/X")), THEMES)
    return t(spark, d, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"))


@query(f"SELECT coalesce(themes[1], 'other') AS theme, count(*) AS n FROM {_TAGGED} GROUP BY 1")
def primary_theme_counts(spark, d):
    none = F.array().cast("array<string>")
    tags = C.tag_item(F.col("text"), none, F.lit("global"), F.lit(None).cast("string"), THEMES)
    return t(spark, d, "documents").groupBy(C.primary_theme(tags, list(THEMES)).alias("theme")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {sql_clip('text', 280)} AS summary FROM documents")
def clip_summary(spark, d):
    return t(spark, d, "documents").select("doc_id", X.clip(F.col("text")).alias("summary"))


# ---- serving ----


def _events(spark, d):
    return t(spark, d, "events")


@query("SELECT event_id, ts, value FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 24 OFFSET 48")
def feed_page(spark, d):
    return serving.feed_page(_events(spark, d), offset=48, order=serving.newest("ts", "event_id")).select("event_id", "ts", "value")


@query("SELECT doc_id, title FROM (SELECT doc_id, substring(text, 1, 60) AS title, text AS summary, n_chars FROM documents) WHERE title ILIKE '%tion th%' OR summary ILIKE '%tion th%' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 24")
def feed_search(spark, d):
    a = t(spark, d, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), F.col("text").alias("summary"), "n_chars")
    return serving.feed_page(a, query=" tion th ", order=serving.newest("n_chars", "doc_id")).select("doc_id", "title")


@query("SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts DESC NULLS LAST, event_id LIMIT 24")
def feed_tag(spark, d):
    return serving.feed_page(_events(spark, d).withColumn("tags", F.array("event_type")), tag="click", order=serving.newest("ts", "event_id")).select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 120")
def recent_n(spark, d):
    return t(spark, d, "orders").orderBy(*serving.newest("o_orderdate", "o_orderkey")).limit(120).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n, count(*) FILTER (quality IS NULL) AS pending FROM documents LEFT JOIN (SELECT DISTINCT ON (doc_id) doc_id, quality FROM labels ORDER BY doc_id, quality) USING (doc_id)")
def count_pending(spark, d):
    return t(spark, d, "documents").join(_labels(spark, d), "doc_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("pending"))


def _labels(spark, d):
    return tables.first_by(t(spark, d, "labels"), ["doc_id"], ["quality"]).select("doc_id", "quality")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 150")
def work_queue(spark, d):
    queue = t(spark, d, "documents").join(_labels(spark, d), "doc_id", "left")
    return tables.work_queue(queue, "quality", serving.newest("n_chars", "doc_id"), 150).select("doc_id", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_analyzed(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT source, count(*) FILTER (n_chars >= 1000) AS kept, count(*) AS total FROM documents GROUP BY source")
def source_report(spark, d):
    return serving.source_report(t(spark, d, "documents"), F.col("n_chars") >= 1000)


_DIGEST = """SELECT theme, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts DESC, event_id) AS ids FROM (
  SELECT event_id, ts, CASE WHEN event_type IN ('error', 'purchase', 'signup') THEN event_type ELSE 'other' END AS theme
  FROM (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-29' - INTERVAL '{hours}' HOUR ORDER BY ts DESC, event_id LIMIT 600)) GROUP BY theme"""


def _digest(spark, d, hours):
    items = serving.since(_events(spark, d), NOW, hours, time="ts", order=serving.newest("ts", "event_id"))
    items = items.select("event_id", F.col("ts").alias("published_at"), F.array("event_type").alias("tags"))
    out = serving.digest(items, order=["error", "purchase", "signup"], key="event_id")
    return out.select("theme", "n", F.array_join(F.transform("urls", lambda x: x.cast("string")), ",").alias("ids"))


@query(_DIGEST.format(hours=24))
def digest_day(spark, d):
    return _digest(spark, d, 24)


@query(_DIGEST.format(hours=168))
def digest_week(spark, d):
    return _digest(spark, d, 168)


@query("""SELECT email, count(*) AS n, min(event_id) AS least, max(event_id) AS most FROM (VALUES ('a@example.com', ''), ('b@example.com', 'error,view'), ('c@example.com', 'none')) r(email, want)
  JOIN events ON want = '' OR list_contains(string_split(want, ','), event_type) GROUP BY email""")
def digest_recipients(spark, d):
    r = config.recipients(spark, file_json='["a@example.com", {"email": "b@example.com", "tags": ["error", "view"]}, {"email": "c@example.com", "tags": ["none"]}]')
    items = _events(spark, d).select("event_id", F.array("event_type").alias("tags"))
    return serving.for_recipients(items, r, "event_id").groupBy("email").agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("most"))


@query("""WITH s AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'U' ELSE 'u' END || c_custkey % 400 || '@example.com' AS email, c_custkey AS k FROM customer WHERE c_custkey % 11 > 0)
  SELECT email, array_to_string(tags, ',') AS tags FROM (VALUES ('u1@example.com', ['x']), ('U1@example.com', ['y']), ('U2@Example.com', []::VARCHAR[])) v(email, tags)
  UNION ALL SELECT arg_min(email, k), '' FROM s WHERE lower(email) NOT IN ('u1@example.com', 'u2@example.com') GROUP BY lower(email)""")
def recipient_union(spark, d):
    """Recipients of a file, and customers as sign-ups: new addresses only, the first of each whatever its case."""
    base = config.recipients(spark, file_json='[{"email": "u1@example.com", "tags": ["x"]}, {"email": "U1@example.com", "tags": ["y"]}, "U2@Example.com"]')
    k = F.col("c_custkey")
    mail = F.when(k % 11 > 0, F.concat(F.when(k % 3 == 0, "U").otherwise("u"), (k % 400).cast("string"), F.lit("@example.com")))
    signups = t(spark, d, "customer").select(mail.alias("email"), k.alias("created_at"))
    return config.with_signups(base, signups).select("email", F.array_join("tags", ",").alias("tags"))


@query("SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS first_turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS r FROM conversations) WHERE r <= 3 GROUP BY conv_id")
def first_n_collect(spark, d):
    turns = t(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(F.col("turn").cast("string"), F.lit(":"), "role").alias("first_turns"))
    return resolve.first_values(turns, "conv_id", "first_turns", ["turn", "role"], 3).select("conv_id", F.array_join("first_turns", ",").alias("first_turns"))


@query("""WITH r AS (SELECT role, conv_id, turn, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS k FROM conversations)
  SELECT role AS lo, sha256(string_agg(text, '|' ORDER BY k) FILTER (k <= 2)) AS seen_in, string_agg('u' || conv_id, ',' ORDER BY k) FILTER (k <= 3) AS urls FROM r WHERE role <> 'system' GROUP BY role""")
def gate_contexts(spark, d):
    """What vetting gets to see of names that half of all rows have: roles as names, texts as titles."""
    c = t(spark, d, "conversations")
    found = c.select(F.col("role").alias("lo"), F.col("role").alias("tag"), F.col("conv_id").alias("art_ord"), F.col("turn").alias("tag_ord"), F.col("text").alias("title"), F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("url"))
    decisions = found.select("lo", F.when(F.col("lo") == "system", "cache").otherwise("unknown").alias("source")).distinct()
    return resolve.gate_input(found, decisions).select("lo", F.sha2(F.array_join("seen_in", "|"), 256).alias("seen_in"), F.array_join("urls", ",").alias("urls"))


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_daily(spark, d):
    return _events(spark, d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


# ---- keyed tables ----

_NEW = "(SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 10 = 0)"


def _new_customers(c):
    changed = c.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return changed.unionByName(c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name", "c_acctbal"))


@query(f"""SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE o.c_name END AS c_name,
  CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal, CASE WHEN o.c_custkey IS NOT NULL THEN o.c_mktsegment ELSE 'NEW' END AS c_mktsegment
  FROM customer o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey""")
def upsert_merge(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return tables.upsert(c, _new_customers(c), ["c_custkey"], {"c_mktsegment": F.lit("NEW")})


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal FROM {_NEW} n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return tables.insert_ignore(c, _new_customers(c), ["c_custkey"])


_GAPS = "(SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier)"


@query(f"SELECT g.s_suppkey, CASE WHEN coalesce(g.s_name, '') = '' AND s.s_suppkey % 2 = 0 THEN 'filled' ELSE g.s_name END AS s_name, CASE WHEN g.s_acctbal IS NULL AND s.s_suppkey % 2 = 0 THEN s.s_acctbal ELSE g.s_acctbal END AS s_acctbal FROM {_GAPS} g JOIN supplier s USING (s_suppkey)")
def null_only_fill(spark, d):
    s = t(spark, d, "supplier")
    gaps = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("s_name"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("s_acctbal"))
    supplied = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("filled").alias("s_name"), "s_acctbal")
    return tables.patch(gaps, supplied, ["s_suppkey"], overwrite=False)


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def stamp_ids(spark, d):
    ids = t(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.stamp(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ids, "o_orderkey", "o_orderstatus", F.lit("X"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def delete_ids(spark, d):
    ids = t(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.delete(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name ASC NULLS LAST, c_custkey LIMIT 50 OFFSET 100")
def name_page(spark, d):
    return enrich.nth_page(t(spark, d, "customer").select("c_custkey", "c_name").withColumns({"name": F.col("c_name"), "id": F.col("c_custkey")}), 50, 100).select("c_custkey", "c_name")


@query("SELECT doc_id, text, lang FROM documents WHERE length(text) >= 200")
def usable_bodies(spark, d):
    return t(spark, d, "documents").where(X.usable_body(F.col("text")) != "").select("doc_id", "text", "lang")


# ---- names and entity resolution ----

#: An invented catalogue, as (ord, id, name) and aliases (ord, company_id, alias).
CATALOGUE = [(0, "c0", "Norrvik Systems AB"), (1, "c1", "Halden Aero (HAX)"), (2, "c2", "Tern Rotor Works"), (3, "c3", "Oriel & Sons Ltd."), (4, "c4", "Éclat Robotique SA"), (5, "c5", "Norrvik"), (6, "c6", "HAX Marine"), (7, "c7", "Tern Rotor Works Group")]
ALIASES = [(0, "c2", "TRW Lifts"), (1, "c3", "Oriel and Sons")]
MENTIONS = ["norrvik systems ab", "NORRVIK", "Norrvik Inc", "Halden Aero", "HAX", "Tern Rotor Works Europe", "Tern Rotor Work", "Eclat Robotique", "Oriel and Sons GmbH", "Oriel & Sons Ltd.", "Royal Navy", "Unknown Thing", "TRW Lifts", "Eclat Robotiqe"]


def _catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "ord int, id string, name string"), spark.createDataFrame(ALIASES, "ord int, company_id string, alias string")


def _mentions(spark, d):
    """Names with something to say of, and those of all parts and suppliers."""
    fixed = spark.createDataFrame([(m,) for m in MENTIONS], "tag string")
    every = fixed.union(t(spark, d, "part").select("p_name")).union(t(spark, d, "supplier").select(F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, " Air Force").otherwise(" Airforce")))).distinct()
    return every.select(F.lower("tag").alias("lo"), "tag")


_VALUES = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"
_OK = lambda name, key: f"(contains({key}, ' ') OR len(string_split({sql_clean(name)}, ' ')) <= 2)"
_SAID = f"(SELECT * FROM {_VALUES([(m,) for m in MENTIONS])} v(tag) UNION SELECT p_name FROM part UNION SELECT s_name || CASE s_suppkey % 3 WHEN 0 THEN ' Air Force' ELSE ' Airforce' END FROM supplier)"
_CASCADE = f"""WITH c(ord, id, name) AS {_VALUES(CATALOGUE)}, a(ord, id, name) AS {_VALUES(ALIASES)}, m(tag) AS {_SAID},
named AS (SELECT 0 AS part, ord, id, name FROM c UNION ALL SELECT 1, ord, id, name FROM a),
exact AS (SELECT lower(name) AS lo, arg_min(id, part * 1000 + ord) AS id FROM named GROUP BY 1),
inn AS (SELECT ord, id, trim(regexp_extract(name, '^([^(]{{2,}}?)\\s*\\(([^)]+)\\)', 1)) AS o, trim(regexp_extract(name, '^([^(]{{2,}}?)\\s*\\(([^)]+)\\)', 2)) AS i FROM c WHERE regexp_matches(name, '^([^(]{{2,}}?)\\s*\\(([^)]+)\\)')),
every AS (SELECT * FROM named UNION ALL SELECT 2, ord, id, o FROM inn UNION ALL SELECT 3, ord, id, i FROM inn WHERE lower(i) NOT IN (SELECT lo FROM exact)),
normed AS (SELECT *, {sql_norm_company('name')} AS key FROM every WHERE {_OK('name', sql_norm_company('name'))}),
heads AS (SELECT key AS k, arg_min(id, part * 1000 + ord) AS id, min(part * 1000 + ord) AS ord FROM normed GROUP BY 1),
t AS (SELECT lower(tag) AS lo, tag, {sql_norm_company('tag')} AS key FROM m),
s1 AS (SELECT lo, 1 AS stage, id, 0.0 AS score, 0 AS ord, 'exact' AS reason FROM t JOIN exact USING (lo)),
s2 AS (SELECT lo, 2, id, {sql_dice('lo', 'lower(name)')}, part * 1000 + ord, 'normalized' FROM t JOIN normed USING (key) WHERE {_OK('tag', 't.key')}),
s3 AS (SELECT lo, 3, id, length(k), ord, 'prefix' FROM t JOIN heads ON contains(key, ' ') AND contains(k, ' ') AND (starts_with(key || ' ', k || ' ') OR starts_with(k || ' ', key || ' '))),
s4 AS (SELECT lo, 4, id, {sql_dice('key', 'k')} AS score, ord, 'fuzzy:' || printf('%.2f', {sql_dice('key', 'k')}) FROM t JOIN heads ON string_split(key, ' ')[1] = string_split(k, ' ')[1] WHERE {sql_dice('key', 'k')} >= 0.9),
u AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4),
best AS (SELECT *, row_number() OVER (PARTITION BY lo ORDER BY stage, score DESC, ord) AS r FROM u)"""


@query(f"{_CASCADE} SELECT lo, id, reason FROM best WHERE r = 1")
def match_cascade(spark, d):
    exact, normed = resolve.company_keys(*_catalogue(spark))
    return resolve.match_companies(_mentions(spark, d), exact, normed)


@query(f"SELECT p_partkey, {sql_norm_company('p_name || s')} AS key, replace({sql_clean('p_name || s')}, ' ', '') AS compact, substring(replace({sql_clean('p_name || s')}, ' ', '-'), 1, 80) AS slug FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN ' Systems, Inc.' WHEN 1 THEN ' & Co' WHEN 2 THEN ' Défense' ELSE '' END AS s FROM part)")
def norm_company(spark, d):
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, " Systems, Inc.").when(k == 1, " & Co").when(k == 2, " Défense").otherwise(""))
    return t(spark, d, "part").select("p_partkey", N.norm_company(name).alias("key"), N.norm_product(name).alias("compact"), N.slugify(name).alias("slug"))


_P = "(SELECT DISTINCT p_name FROM part)"


@query(f"SELECT a.p_name AS a, b.p_name AS b, round({sql_dice('a.p_name', 'b.p_name')}, 6) AS dice FROM {_P} a JOIN {_P} b ON string_split(a.p_name, ' ')[1] = string_split(b.p_name, ' ')[1] AND a.p_name < b.p_name")
def fuzzy_dice(spark, d):
    p = t(spark, d, "part").select(F.col("p_name").alias("a")).distinct().withColumn("w", F.split("a", " ")[0])
    return p.join(p.withColumnRenamed("a", "b"), "w").where("a < b").select("a", "b", F.round(N.dice(F.col("a"), F.col("b")), 6).alias("dice"))


_HEADS = f"""SELECT s_suppkey AS ord, 's' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 1000000 + min(p_partkey), 'p' || min(p_partkey), p_name || ' Works Ltd' FROM part GROUP BY p_name
  UNION ALL SELECT 2000000 + c_custkey, 'c' || c_custkey, c_name FROM customer WHERE c_custkey % 10 = 0"""
_TAGS = """SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN replace(c_name, '#', ' - ') || ' GmbH' WHEN 2 THEN replace(c_name, 'omer', 'mer') ELSE c_name || '0' END FROM customer WHERE c_custkey % 3 = 1
  UNION SELECT p_name || CASE p_partkey % 3 WHEN 0 THEN ' works of ' || p_partkey % 5 WHEN 1 THEN ' wrks' ELSE '' END FROM part UNION SELECT s_name || ' Supply' FROM supplier"""
_NAMED = f"WITH c(ord, id, name) AS ({_HEADS}), a(ord, id, name) AS (SELECT 0, '', '' WHERE false), m(tag) AS ({_TAGS})," + _CASCADE.split(_SAID + ",", 1)[1]


@query(f"{_NAMED} SELECT lo, id, reason FROM best WHERE r = 1")
def name_matches(spark, d):
    """Names of customers, parts and suppliers, altered in several ways, in a catalogue of such names: nearly all begin with one of three words."""
    c = t(spark, d, "customer")
    k, p = F.col("c_custkey"), F.col("p_partkey")
    first = t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("i"))
    entry = lambda df, shift, letter, i, name: df.select((F.lit(shift) + F.col(i)).alias("ord"), F.concat(F.lit(letter), F.col(i).cast("string")).alias("id"), name.alias("name"))
    heads = entry(t(spark, d, "supplier"), 0, "s", "s_suppkey", F.col("s_name")).unionByName(entry(first, 1000000, "p", "i", F.concat("p_name", F.lit(" Works Ltd")))).unionByName(entry(c.where("c_custkey % 10 = 0"), 2000000, "c", "c_custkey", F.col("c_name")))
    name = F.when(k % 4 == 0, F.upper("c_name")).when(k % 4 == 1, F.concat(F.replace("c_name", F.lit("#"), F.lit(" - ")), F.lit(" GmbH"))).when(k % 4 == 2, F.replace("c_name", F.lit("omer"), F.lit("mer"))).otherwise(F.concat("c_name", F.lit("0")))
    more = F.when(p % 3 == 0, F.concat(F.lit(" works of "), (p % 5).cast("string"))).when(p % 3 == 1, " wrks").otherwise("")
    tags = c.where("c_custkey % 3 = 1").select(name.alias("tag")).union(t(spark, d, "part").select(F.concat("p_name", more))).union(t(spark, d, "supplier").select(F.concat("s_name", F.lit(" Supply")))).distinct()
    exact, normed = resolve.company_keys(heads, spark.createDataFrame([], "ord bigint, company_id string, alias string"))
    return resolve.match_companies(tags.select(F.lower("tag").alias("lo"), "tag"), exact, normed)


@query(f"SELECT tag FROM {_SAID} m(tag) WHERE regexp_matches(tag, '(?i)\\b({'|'.join(vocab.BLOCKLIST)})\\b')")
def blocklist(spark, d):
    return _mentions(spark, d).where(C.is_blocklisted(F.col("tag"))).select("tag")


CACHE = [("company", "unknown thing", "rejected", None, "blocklist"), ("company", "HAX", "matched", "c6", "exact")]


def _articles(spark, d):
    """Documents as articles; which mentions they have follows from their ids."""
    names = F.array(*map(F.lit, MENTIONS))
    n = len(MENTIONS)
    pick = F.array(*[names[(F.col("doc_id") * k + k).cast("int") % n] for k in (1, 3)])
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.substring("text", 1, 40).alias("title"), F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("url"), pick.alias("companies"), F.array().cast("array<string>").alias("products"))


def _decisions(spark, d):
    found = resolve.mentions(_articles(spark, d), "company")
    exact, normed = resolve.company_keys(*_catalogue(spark))
    tags = found.groupBy("lo").agg(F.min("tag").alias("tag"))
    cache = spark.createDataFrame(CACHE, "kind string, tag string, decision string, entity_id string, reason string")
    return found, resolve.decide(found, cache, resolve.match_companies(tags, exact, normed), "company")


_N = len(MENTIONS)
_FOUND = f"found AS (SELECT doc_id AS article_id, k AS tag_ord, tag, lower(tag) AS lo FROM (SELECT doc_id, unnest([1, 3]) AS k FROM documents) JOIN (SELECT tag, row_number() OVER () - 1 AS i FROM m) ON i = (doc_id * k + k) % {_N})"
_DECIDED = f"""{_CASCADE}, {_FOUND},
decided AS (SELECT f.lo, f.tag, CASE WHEN f.lo = 'unknown thing' THEN 'rejected' WHEN f.lo = 'hax' THEN 'matched' WHEN b.id IS NOT NULL THEN 'matched' WHEN regexp_matches(f.tag, '(?i)\\b({'|'.join(vocab.BLOCKLIST)})\\b') THEN 'rejected' ELSE 'unknown' END AS decision,
  CASE WHEN f.lo = 'hax' THEN 'c6' WHEN f.lo = 'unknown thing' THEN NULL ELSE b.id END AS entity_id
  FROM (SELECT DISTINCT lo, tag FROM found) f LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (lo))"""


@query(f"{_DECIDED} SELECT lo, decision, entity_id FROM decided")
def cache_decisions(spark, d):
    return _decisions(spark, d)[1].select("lo", "decision", "entity_id")


@query(f"{_DECIDED} SELECT DISTINCT article_id, entity_id AS company_id FROM found JOIN decided USING (lo) WHERE entity_id IS NOT NULL")
def article_links(spark, d):
    return resolve.links(*_decisions(spark, d))


@query(f"{_DECIDED} SELECT doc_id AS article_id FROM documents WHERE doc_id NOT IN (SELECT article_id FROM found JOIN decided USING (lo) WHERE decision = 'unknown')")
def article_complete(spark, d):
    return resolve.complete_articles(_articles(spark, d), *_decisions(spark, d))


@query(f"{_DECIDED} SELECT lo, count(*) AS n FROM found JOIN decided USING (lo) WHERE decision = 'unknown' GROUP BY lo")
def gate_queue(spark, d):
    found, decisions = _decisions(spark, d)
    queue = resolve.gate_input(found, decisions)
    return queue.join(found.groupBy("lo").agg(F.count("*").alias("n")), "lo").select("lo", "n")


# ---- enrichment ----


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_claim(spark, d):
    return enrich.latest(t(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT band, count(*) AS n FROM (SELECT CASE WHEN x <= 10 THEN '1-10' WHEN x <= 50 THEN '11-50' WHEN x <= 200 THEN '51-200' WHEN x <= 500 THEN '201-500' WHEN x <= 1000 THEN '501-1000' WHEN x <= 5000 THEN '1001-5000' WHEN x <= 10000 THEN '5001-10000' ELSE '10000+' END AS band FROM (SELECT p_size * p_size * 5 AS x FROM part)) GROUP BY band")
def emp_band(spark, d):
    return t(spark, d, "part").groupBy(C.employee_band(F.col("p_size") * F.col("p_size") * 5).alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT company_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, rank) AS r FROM (
  SELECT s_nationkey AS company_id, s_suppkey AS rank, CASE WHEN s_suppkey % 7 = 0 THEN 100 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 0 END AS score FROM supplier)) WHERE r = 1 AND score >= 15""")
def kb_best_candidate(spark, d):
    k = F.col("s_suppkey")
    c = t(spark, d, "supplier").select(F.col("s_nationkey").alias("company_id"), k.alias("rank"), F.concat(F.lit("Q"), k.cast("string")).alias("qid"), F.when(k % 2 == 0, "an aerospace firm").otherwise("a river").alias("description"), F.when(k % 7 == 0, "https://www.example.com/x").otherwise("https://example.net").alias("site"), F.when(k % 3 == 0, F.array(F.lit("Q43229"))).otherwise(F.array(F.lit("Q5"))).alias("instance_of"), F.lit("http://sub.example.com").alias("website"))
    return enrich.best_candidate(c).select("company_id", "rank", "score")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS employee_count, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 90 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS latitude, CAST(NULL AS VARCHAR) AS description FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 0")
def coerce_profile(spark, d):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    e = _events(spark, d).select("event_id", v.alias("v"))
    return e.select("event_id", enrich.coerce(F.col("v"), "int").alias("employee_count"), enrich.coerce(F.col("v"), "lat").alias("latitude"), enrich.coerce(F.col("v"), "text").alias("description")).where("employee_count IS NOT NULL")


@query("SELECT p_partkey, CASE WHEN r = 1 THEN b ELSE b || '-' || r END AS slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS b, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)")
def unique_slugs(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    return resolve.unique_slugs(p, spark.createDataFrame([], "slug string"), "name", ["p_partkey"]).select("p_partkey", "slug")
