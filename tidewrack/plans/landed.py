"""Queries over landed payloads: feeds, sitemaps, pages' meta elements, replies and profiles made from the test tables by column functions.

The payloads are built here as text, and each SQL says from the tables' own
columns what must be read out of them again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import enrich, ingest, resolve, serving, tables
from ..sources import config, feeds, knowledge
from .queries import CANON, query, sql_clip, sql_trim, t

BEGIN = "2024-01-01"
NOW = dt.datetime(2024, 1, 29)


def _at(minutes):
    return F.timestamp_add("MINUTE", minutes, F.lit(dt.datetime(2024, 1, 1)))


def _plain(c):
    """Texts without characters that mean something in markup."""
    return F.regexp_replace(c, "[<>&]", " ")


_PLAIN = "regexp_replace(text, '[<>&]', ' ', 'g')"


def _s(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


# ---- feeds ----


@query(f"""SELECT doc_id, 'https://www.Example.com/' || doc_id || '?b=2&c=' || lang AS url, 'Item ' || doc_id || ' & ' || source AS title, {sql_clip(_PLAIN, 300)} AS summary,
  CASE doc_id % 3 WHEN 0 THEN 'https://example.com/i.jpg?a=1&b=2' WHEN 1 THEN 'https://example.com/e.png' END AS image_url,
  CASE WHEN doc_id % 5 > 0 THEN TIMESTAMP '{BEGIN}' + to_minutes(doc_id) END AS published_at, lang || '|' || source AS categories FROM documents""")
def rss_items(spark, d):
    """RSS: CDATA, escaped links, three kinds of image, RFC 822 dates of which some can't be read, categories."""
    i, k = F.col("doc_id"), F.col("doc_id") % 3
    image = F.when(k == 0, F.lit('<media:content url="https://example.com/i.jpg?a=1&amp;b=2" medium="image"/>')).when(k == 1, F.lit('<enclosure url="https://example.com/e.png" length="1" type="image/png"/>')).otherwise(F.lit('<enclosure url="https://example.com/e.mp3" type="audio/mpeg"/>'))
    date = F.when(i % 5 > 0, F.date_format(_at(i.cast("int")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    xml = _s("<rss><channel><title>No item</title><item><title><![CDATA[Item <b>", i, "</b> & ", F.col("source"), "]]></title><link> https://www.Example.com/", i, "?b=2&amp;c=", F.col("lang"), " </link><description><![CDATA[<p>", _plain(F.col("text")), "</p>]]></description>", image, "<pubDate>", date, "</pubDate><category>", F.col("lang"), "</category><category>", F.col("source"), "</category></item><item><title>Without a link</title></item></channel></rss>")
    items = feeds.parse_feeds(t(spark, d, "documents").select("doc_id", xml.alias("xml")))
    return items.select("doc_id", "url", "title", "summary", "image_url", F.col("published_at").cast("timestamp_ntz").alias("published_at"), F.array_join("categories", "|").alias("categories"))


@query(f"""SELECT doc_id, 'https://example.org/' || doc_id AS url, source AS title, {sql_clip(_PLAIN, 300)} AS summary, 'https://example.org/t.png' AS image_url,
  TIMESTAMP '{BEGIN}' + to_minutes(doc_id) AS published_at, lang AS categories FROM documents""")
def atom_items(spark, d):
    """Atom: the alternate link, in either order of attributes, ISO dates, terms."""
    i = F.col("doc_id")
    link = F.when(i % 2 == 0, _s('<link rel="self" href="https://example.org/x"/><link rel="alternate" href="https://example.org/', i, '"/>')).otherwise(_s('<link href="https://example.org/', i, '" rel="alternate"/><link rel="edit" href="https://example.org/y"/>'))
    xml = _s("<feed><title>f</title><entry><title>", F.col("source"), "</title>", link, "<summary>", _plain(F.col("text")), "</summary><published>", F.date_format(_at(i.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), '</published><media:thumbnail url="https://example.org/t.png"/><category term="', F.col("lang"), '"/></entry></feed>')
    items = feeds.parse_feeds(t(spark, d, "documents").select("doc_id", xml.alias("xml")))
    return items.select("doc_id", "url", "title", "summary", "image_url", F.col("published_at").cast("timestamp_ntz").alias("published_at"), F.array_join("categories", "|").alias("categories"))


_INGESTED = f"(SELECT canon, page_id % 3 + 1 AS source_id, page_id FROM {CANON} WHERE page_id % 30 <= 14 AND (page_id % 3 = 2 OR page_id % 4 = 0))"


@query(f"SELECT url, source_id, sha256(url) AS url_hash, CASE WHEN source_id = 2 THEN 'region-norway' ELSE '' END AS region FROM (SELECT canon AS url, min(source_id) AS source_id FROM {_INGESTED} GROUP BY canon)")
def ingest_articles(spark, d):
    """Landed feeds to rows: fresh, relevant, and of equal canonical urls the first source's."""
    sources = spark.createDataFrame([(1, "A", None, "global", "en", False, "https://a.example"), (2, "B", "Norway/Sweden", "regional", "no", False, "https://b.example"), (3, "C", None, "global", "en", True, "https://c.example")], "id int, name string, country string, scope string, lang string, specialist boolean, website string")
    i = F.col("page_id")
    day = F.date_format(F.timestamp_add("DAY", -(i % 30).cast("int"), F.lit(NOW)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    title = F.when(i % 4 == 0, "A counter-drone order").otherwise("Cooking")
    xml = _s("<rss><item><title>", title, "</title><link>", X.escape_html(F.col("url")), "</link><dc:date>", day, "</dc:date></item></rss>")
    landed = t(spark, d, "pages").select((i % 3 + 1).cast("int").alias("source_id"), xml.alias("xml"))
    rows = ingest.ingest(landed, sources, NOW, terms=["drone"])
    return rows.select("url", "source_id", "url_hash", F.array_join(F.filter("tags", lambda x: x.startswith("region-")), ",").alias("region"))


# ---- sitemaps and pages ----


@query(f"SELECT page_id, trim(url) AS loc, CASE WHEN page_id % 3 > 0 THEN TIMESTAMP '{BEGIN}' + to_minutes(page_id) END AS lastmod FROM pages WHERE url IS NOT NULL AND trim(url) <> ''")
def sitemap_entries(spark, d):
    i = F.col("page_id")
    date = F.when(i % 3 == 1, F.date_format(_at(i.cast("int")), "yyyy-MM-dd'T'HH:mm:ssXXX")).when(i % 3 == 2, F.date_format(_at(i.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("unknown")
    xml = _s('<?xml version="1.0"?><urlset><url><loc> ', X.escape_html(F.col("url")), " </loc><lastmod>", date, "</lastmod></url><url><lastmod>2024-01-01</lastmod></url></urlset>")
    return feeds.parse_sitemaps(t(spark, d, "pages").select("page_id", xml.alias("xml"))).select("page_id", "loc", F.col("lastmod").cast("timestamp_ntz").alias("lastmod"))


@query(f"""SELECT 'w' || s AS website, 'p' || page_id AS loc, TIMESTAMP '{BEGIN}' + to_days(CAST(page_id % 40 AS INTEGER)) AS lastmod FROM (
  SELECT page_id, page_id // 50 AS s, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id % 40 DESC, 'p' || page_id) AS r FROM pages WHERE page_id % 40 >= 10) WHERE r <= 20""")
def sitemap_crawl(spark, d):
    """For each 50 pages a website: robots' index, an index in it, and a map with the pages; the newest 20 since a day."""
    p = t(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 50).cast("bigint").alias("s"))
    entry = _s("<url><loc>p", F.col("page_id"), "</loc><lastmod>", F.date_format(F.timestamp_add("DAY", (F.col("page_id") % 40).cast("int"), F.lit(dt.datetime(2024, 1, 1))), "yyyy-MM-dd"), "</lastmod></url>")
    leaves = p.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("x")).select(_s("leaf", F.col("s")).alias("url"), _s("<urlset>", F.col("x"), "</urlset>").alias("xml"))
    sites = p.select("s").distinct()
    index = lambda a, b: sites.select(_s(a, F.col("s")).alias("url"), _s("<sitemapindex><sitemap><loc>", b, F.col("s"), "</loc></sitemap><sitemap><loc>old</loc><lastmod>2001-01-01</lastmod></sitemap></sitemapindex>").alias("xml"))
    seeds = sites.select(_s("w", F.col("s")).alias("website"), _s("top", F.col("s")).alias("url"))
    found = feeds.crawl_sitemaps(seeds, leaves.unionByName(index("top", "mid")).unionByName(index("mid", "leaf")), F.lit(dt.datetime(2024, 1, 11)), max_urls=20)
    return found.select("website", "loc", F.col("lastmod").cast("timestamp_ntz").alias("lastmod"))


@query(f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'It''s ' || page_id ELSE 'T ' || page_id END AS title, CASE page_id % 3 WHEN 0 THEN 'og & d' WHEN 1 THEN 'plain' END AS summary,
  CASE page_id % 4 WHEN 0 THEN 'https://example.com/o' WHEN 1 THEN 'https://example.com/u' WHEN 2 THEN 'https://example.com/t' END AS image_url,
  CASE page_id % 4 WHEN 0 THEN TIMESTAMP '{BEGIN} 10:00:00' WHEN 1 THEN TIMESTAMP '2024-02-02' WHEN 2 THEN TIMESTAMP '2024-03-03' END AS published_at FROM pages""")
def meta_chains(spark, d):
    """Meta elements put before each page: all fallbacks, both orders of attributes, quotes in values."""
    i = F.col("page_id")
    of = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (i % n + 1).cast("int"))
    title = F.when(i % 2 == 0, _s('<meta property="og:title" content="It\'s ', i, '">')).otherwise(_s("<meta content='T ", i, "' name=\"og:title\">"))
    summary = of(3, '<meta name="description" content="no"><meta property="og:description" content="og &amp; d">', '<meta content="plain" name="description">', "")
    image = of(4, '<meta property="twitter:image" content="no"><meta property="og:image" content="https://example.com/o">', '<meta property="og:image:url" content="https://example.com/u">', "<meta name='twitter:image' content='https://example.com/t'>", "")
    date = of(4, f'<meta property="article:published_time" content="{BEGIN}T10:00:00Z"><time datetime="2020-01-01">', '<meta property="og:updated_time" content="2024-02-02T00:00:00Z">', '<time class="x" datetime="2024-03-03">', "")
    pages = t(spark, d, "pages").select("page_id", F.concat(title, summary, image, date, F.coalesce("html", F.lit(""))).alias("html"))
    return feeds.extract_meta(pages).select("page_id", "title", "summary", "image_url", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


# ---- replies and profiles ----


@query("SELECT conv_id, turn, role || '|Übung ' || conv_id AS companies, '' AS products FROM conversations")
def reply_names(spark, d):
    """Names in replies: fenced JSON with prose round it, members of other kinds, blanks, and doubles but for case."""
    reply = _s('Sure!\n```json\n{"companies": ["', F.col("role"), '", 5, null, "  ", "', F.upper("role"), '", {"x": [1]}, "Übung\\n', F.col("conv_id"), '"], "products": "none"}\n```\nDone.')
    r = t(spark, d, "conversations").select("conv_id", "turn", reply.alias("r"))
    return r.select("conv_id", "turn", *[F.array_join(X.names_in_reply(F.col("r"), k), "|").alias(k) for k in ("companies", "products")])


@query("SELECT doc_id, sha256('TITLE: ' || source || chr(10) || 'ARTICLE:' || chr(10) || substring(CASE WHEN doc_id % 3 = 0 THEN source ELSE text END, 1, 12000)) AS sha256 FROM documents WHERE text <> ''")
def reading_text(spark, d):
    docs = t(spark, d, "documents").where("text <> ''")
    return docs.select("doc_id", F.sha2(X.article_text(F.col("source"), F.lit(None).cast("string"), F.when(F.col("doc_id") % 3 > 0, F.col("text"))), 256).alias("sha256"))


_KIND = {
    "company_type": ("' Tier-1 '", "'State Owned'", "'JV'", "'bakery'", "7"), "ownership": ("'Listed'", "'state-owned'", "'N.G.O.'", "''", "true"),
    "founded_year": ("'1999'", "1799", "2024.9", "'x'", "null"), "employee_count": ("12.7", "'0'", "5000000", "4999999", "''"), "employee_range": ("'1,001 - 5000'", "'10000+'", "'1-11'", "5", "null"),
    "latitude": ("90", "90.5", "-90", "'-10.5'", "true"), "longitude": ("180", "-180.5", "'x'", "0", "[1]"), "total_funding": ("0", "-1", "'1e3'", "''", "{}"),
    "is_public": ("true", "false", "'true'", "1", "null"), "revenue_currency": ("'usd'", "' EUR '", "'euro'", "'E1R'", "5"), "linkedin_url": ("' https://x.example/y '", "'ftp://x'", "'http://a b'", "'HTTP://Z'", "5"),
    "risk_flags": ("['a', 1, ' a ', '']", "[]", "'a'", "['b', 'a', 'b']", "null"), "stock_ticker": ("' T '", "'  '", "5", "'é'", "['x']"),
}
_RIGHT = {
    "company_type": ("'tier1'", "'state_owned'", "'jv'", "NULL", "NULL"), "ownership": ("'public'", "'state_owned'", "NULL", "NULL", "NULL"),
    "founded_year": ("1999", "NULL", "2024", "NULL", "NULL"), "employee_count": ("12", "NULL", "NULL", "4999999", "NULL"), "employee_range": ("'1001-5000'", "'10000+'", "NULL", "NULL", "NULL"),
    "latitude": ("90.0", "NULL", "-90.0", "-10.5", "NULL"), "longitude": ("180.0", "NULL", "NULL", "0.0", "NULL"), "total_funding": ("0.0", "NULL", "1000.0", "NULL", "NULL"),
    "is_public": ("true", "false", "NULL", "NULL", "NULL"), "revenue_currency": ("'USD'", "'EUR'", "NULL", "NULL", "NULL"), "linkedin_url": ("'https://x.example/y'", "NULL", "NULL", "'HTTP://Z'", "NULL"),
    "risk_flags": ("'a'", "NULL", "NULL", "'b,a'", "NULL"), "stock_ticker": ("'T'", "NULL", "NULL", "'é'", "NULL"),
}
_TYPES = {"founded_year": "BIGINT", "employee_count": "BIGINT", "latitude": "DOUBLE", "longitude": "DOUBLE", "total_funding": "DOUBLE", "is_public": "BOOLEAN"}


@query("SELECT p_partkey AS company_id, " + ", ".join(f"CAST(CASE (p_partkey + {k}) % 5 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + f" END AS {_TYPES.get(f, 'VARCHAR')}) AS {f}" for k, (f, xs) in enumerate(_RIGHT.items())) + " FROM part")
def coerce_kinds(spark, d):
    """All thirteen kinds of profile field, each with right, wrong and odd values, for every part."""
    pick = lambda k, xs: F.element_at(F.array(*[F.lit(x.replace("'", '"')) for x in xs]), ((F.col("p_partkey") + k) % 5 + 1).cast("int"))
    fields = [_s(f'"{f}": ', pick(k, xs)) for k, (f, xs) in enumerate(_KIND.items())]
    p = t(spark, d, "part").select(F.col("p_partkey").alias("company_id"), _s("{", F.concat_ws(", ", *fields), "}").alias("json"))
    got = enrich.profiles(p, this_year=2024)
    return got.select("company_id", *[F.array_join(f, ",").alias(f) if f == "risk_flags" else F.col(f) for f in _KIND])


@query("""SELECT lower(s_name) AS name_lc, s_suppkey % 4 <> 1 AND s_suppkey % 2 = 0 OR s_suppkey % 4 = 3 AND s_suppkey % 3 = 0 AS ok, CASE WHEN s_suppkey % 5 = 0 THEN 'investor' ELSE 'company' END AS entity_kind,
  CASE WHEN s_suppkey % 2 = 0 THEN 'C ' || s_suppkey ELSE s_name END AS canonical, CASE WHEN s_suppkey % 3 = 0 THEN 'https://example.com/' || s_suppkey END AS website, CASE WHEN s_suppkey % 2 = 0 THEN 'prime' END AS type, CASE WHEN s_suppkey % 3 = 0 THEN 'UAV' END AS category FROM supplier""")
def verdict_fields(spark, d):
    k = F.col("s_suppkey")
    s = t(spark, d, "supplier").select(
        F.when(k % 2 == 0, "company").otherwise("product").alias("kind"), F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("name"), (k % 4 != 1).alias("ok"),
        F.when(k % 5 == 0, "investor").when(k % 5 == 1, "alien").alias("entity_kind"), F.when(k % 2 == 0, _s(" C ", k)).otherwise(" ").alias("canonical"), F.lit("X").alias("country"),
        F.when(k % 3 == 0, _s(" https://example.com/", k)).otherwise("ftp://example.com").alias("website"), F.when(k % 2 == 0, "prime").otherwise("baker").alias("type"), F.when(k % 3 == 0, "UAV").otherwise("Toaster").alias("category"), F.lit(None).cast("string").alias("maker"),
    )
    return enrich.verdict_fields(s).select("name_lc", "ok", "entity_kind", "canonical", "website", "type", "category")


# ---- serving ----


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' - INTERVAL 14 DAY OR event_id % 10 = 0")
def fresh_events(spark, d):
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 > 0, F.col("ts")).alias("published_at"))
    return serving.fresh(e, NOW).select("event_id")


_ESC = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""SELECT page_id, sha256('<item><title>' || {_ESC('html')} || '</title><link>' || {_ESC('url')} || '</link><guid>' || {_ESC('url')} || '</guid><description></description>' ||
  CASE WHEN page_id % 3 > 0 THEN '<pubDate>' || strftime(TIMESTAMP '{BEGIN}' + to_minutes(page_id), '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate>' ELSE '' END || '</item>') AS sha256 FROM pages""")
def rss_rendered(spark, d):
    """Pages as RSS items, their whole markup escaped in the title."""
    p = t(spark, d, "pages").select("page_id", F.col("html").alias("title"), "url", F.lit(None).cast("string").alias("summary"), F.when(F.col("page_id") % 3 > 0, _at(F.col("page_id").cast("int"))).alias("published_at"))
    return p.select("page_id", F.sha2(serving.rss_item(), 256).alias("sha256"))


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(source || ' ' || text), '[\\p{L}\\p{N}]+'))) AS BIGINT) AS n_terms FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def full_text_terms(spark, d):
    docs = t(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    return docs.select("doc_id", F.size(serving.full_text_terms(F.col("source"), F.col("text"))).cast("long").alias("n_terms"))


@query("""SELECT email, source FROM (SELECT 'c0@example.com' AS email, 'old' AS source UNION ALL
  SELECT email, arg_min(source, k) FROM (SELECT 'c' || c_custkey % 500 || '@example.com' AS email, c_mktsegment AS source, c_custkey AS k FROM customer WHERE c_custkey % 7 > 0) WHERE email <> 'c0@example.com' GROUP BY email)""")
def subscribers_added(spark, d):
    """Sign-ups: bad addresses go, case and blanks don't matter, the first of each counts, and known ones stay."""
    k = F.col("c_custkey")
    mail = F.when(k % 7 > 0, _s(" C", k % 500, "@Example.com ")).otherwise(_s("c", k, "@example"))
    asked = t(spark, d, "customer").select(mail.alias("email"), F.col("c_mktsegment").alias("source"), k.alias("created_at"))
    old = spark.createDataFrame([("c0@example.com", "old", 0)], "email string, source string, created_at bigint")
    return ingest.subscribe(old, asked).select("email", "source")


# ---- catalogue ----


@query("SELECT p_partkey, CASE WHEN r = 1 THEN b ELSE b || '-' || (r + 2) END AS slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS b, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)")
def slugs_beside_taken(spark, d):
    """Slugs of all parts where -2 and -4 of every name are taken, and so is its base's -3."""
    p = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    base = p.select(F.replace("name", F.lit(" "), F.lit("-")).alias("b")).distinct()
    taken = base.select(F.explode(F.array(*[F.concat("b", F.lit(x)) for x in ("-2", "-3")])).alias("slug"))
    return resolve.unique_slugs(p, taken, "name", ["p_partkey"]).select("p_partkey", "slug")


@query(f"""SELECT p_partkey AS product_id, 's' || min(s_suppkey) AS company_id FROM part JOIN supplier ON lower(s_name) = lower({sql_trim("CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'Supplier#' || lpad(CAST(p_partkey % 60 AS VARCHAR), 9, '0') END")}) GROUP BY p_partkey""")
def maker_links(spark, d):
    """Makers of all parts among the suppliers, by name whatever its case; numbers of one digit apart must not match."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), _s("s", F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    exact, normed = resolve.company_keys(s, spark.createDataFrame([], "ord bigint, company_id string, alias string"))
    maker = F.when(F.col("p_partkey") % 3 > 0, F.upper(_s("Supplier#", F.lpad((F.col("p_partkey") % 60).cast("string"), 9, "0"))))
    links = resolve.maker_links(t(spark, d, "part").select(F.col("p_partkey").alias("id"), maker.alias("maker")), exact, normed.where("false"))
    return links.select("product_id", "company_id")


@query("SELECT c_custkey % 97 AS k, min(c_custkey) AS c_custkey, arg_min(c_name, c_custkey) AS c_name FROM customer GROUP BY 1")
def first_of_new(spark, d):
    """Insert-ignore of rows of which many have one key: the first in order counts."""
    new = t(spark, d, "customer").select((F.col("c_custkey") % 97).alias("k"), "c_custkey", "c_name")
    return tables.insert_ignore(new.limit(0), new, ["k"], ["c_custkey"])


@query("SELECT event_id, event_id % 3 = 0 OR event_id % 3 = 1 AS ok FROM events")
def valid_emails(spark, d):
    i = F.col("event_id")
    mail = F.when(i % 3 == 0, _s("u", i, "@example.com")).when(i % 3 == 1, _s("ü.", i, "@a.b.example")).otherwise(_s("u", i, "@exam ple.com"))
    return t(spark, d, "events").select("event_id", config.valid_email(mail).alias("ok"))


# ---- knowledge base ----


@query("""WITH p AS (SELECT p_partkey AS k, p_size, p_name FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 11 > 0)
  SELECT 'Q' || k AS qid, CAST(1900 + k % 100 AS INTEGER) AS founded_year, CAST(CASE WHEN k % 2 = 0 THEN p_size * 100 ELSE p_size END AS BIGINT) AS employee_count, CASE WHEN k % 3 > 0 THEN n_name END AS hq_city,
    'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') || '_(' || k || ')' AS wikipedia_url, CASE WHEN k % 5 = 0 THEN 'https://www.linkedin.com/company/l' || k END AS linkedin_url,
    CASE WHEN k % 3 = 1 THEN 'EUR' END AS revenue_currency, 'https://x' || k || '.example' AS website
  FROM p LEFT JOIN nation ON n_nationkey = k % 25""")
def knowledge_profiles(spark, d):
    """Nested entities made of parts: dated claims, references to nations by id, links; a seventh is missing and an eleventh isn't JSON."""
    k = F.col("p_partkey")
    value = lambda v: _s('{"mainsnak":{"datavalue":{"value":', v, "}}}")
    dated = lambda n, year: _s('{"mainsnak":{"datavalue":{"value":{"amount":"+', n, '","unit":"1"}}},"qualifiers":{"P585":[{"datavalue":{"value":{"time":"+', year, '-01-01T00:00:00Z"}}}]}}')
    claims = [
        _s('"P571":[', value(_s('{"time":"+', 1900 + k % 100, '-06-01T00:00:00Z"}')), "]"), _s('"P1128":[', dated(F.col("p_size"), "2010"), ",", dated(F.col("p_size") * 100, F.when(k % 2 == 0, "2020").otherwise("2001")), "]"),
        _s('"P159":[', value(_s('{"id":"N', F.when(k % 3 > 0, (k % 25).cast("string")).otherwise("x"), '"}')), "]"), _s('"P856":[', value(_s('"https://x', k, '.example"')), "]"),
        F.when(k % 5 == 0, _s('"P4264":[', value(_s('"l', k, '"')), "]")), F.when(k % 3 == 1, _s('"P2139":[', value(F.lit('{"amount":"+5","unit":"http://www.wikidata.org/entity/Q4916"}')), "]")),
    ]
    json = _s('{"id":"Q', k, '",', F.when(k % 7 == 0, '"missing":"",').otherwise(""), '"claims":{', F.concat_ws(",", *claims), '},"sitelinks":{"enwiki":{"title":"', F.col("p_name"), " (", k, ')"}}}')
    entities = t(spark, d, "part").select(F.when(k % 11 == 0, F.substring(json, 2, 1000)).otherwise(json).alias("json"))
    nations = t(spark, d, "nation").select(_s('{"id":"N', F.col("n_nationkey"), '","labels":{"en":{"value":"', F.col("n_name"), '"}}}').alias("json"))
    got = knowledge.profile(entities, knowledge.labels(nations))
    return got.select("qid", "founded_year", "employee_count", "hq_city", "wikipedia_url", "linkedin_url", "revenue_currency", "website")
