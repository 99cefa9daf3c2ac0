"""Queries that go through stored tables: merges by bucket, differences of snapshots, jobs, and searches by index.

Each builds its tables from the test tables in a new folder of the shared one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates, jobs, tables
from ..operators.paging import Feed
from ..operators.search import Index
from ..operators.store import Store, shared_folder
from .landed import _INGESTED, _s
from .queries import query, t

NOW = dt.datetime(2024, 1, 29)

# ---- merges and differences ----

_CHANGED = "o_orderkey % 100 = 1"


def _orders(spark, d):
    """Orders in a store, then a hundredth of them with another status, new keys, and some deleted."""
    store = Store(spark, shared_folder(spark, "orders"))
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    store.write("orders", orders, ["o_orderkey"], 64)
    _change(store, orders)
    return store


def _change(store, orders):
    some = orders.where(_CHANGED)
    changes = some.select("o_orderkey", F.lit("X").alias("o_orderstatus")).unionByName(some.select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    store.merge("orders", changes, lambda old, new: tables.upsert(old, new, ["o_orderkey"]))
    store.merge("orders", orders.where("o_orderkey % 100 = 2").select("o_orderkey"), lambda old, gone: tables.delete(old, gone, "o_orderkey"))


@query(f"""SELECT o_orderkey, o_custkey, CASE WHEN {_CHANGED} THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 100 <> 2
  UNION ALL SELECT -o_orderkey, -1, 'N', -1 FROM orders WHERE {_CHANGED}""")
def merged_by_bucket(spark, d):
    """A merge and a deletion that write only the buckets they touch give what they give on the whole table."""
    return _orders(spark, d).read("orders").fillna(-1)


@query(f"""SELECT 'update' AS change, o_orderkey, 'X' AS o_orderstatus FROM orders WHERE {_CHANGED} AND o_orderstatus <> 'X' UNION ALL SELECT 'insert', -o_orderkey, 'N' FROM orders WHERE {_CHANGED}
  UNION ALL SELECT 'delete', o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 100 = 2""")
def snapshot_changes(spark, d):
    return _orders(spark, d).diff("orders", 1).select("change", "o_orderkey", "o_orderstatus")


# ---- jobs ----


def _landed(spark, d):
    """Pages as items of the feeds of three sources, as ingest_articles has them."""
    i = F.col("page_id")
    day = F.date_format(F.timestamp_add("DAY", -(i % 30).cast("int"), F.lit(NOW)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    title = F.when(i % 4 == 0, "A counter-drone order").otherwise("Cooking")
    xml = _s("<rss><item><title>", title, "</title><link>", X.escape_html(F.col("url")), "</link><dc:date>", day, "</dc:date></item></rss>")
    return t(spark, d, "pages").select((i % 3 + 1).cast("int").alias("source_id"), xml.alias("xml"))


def _sources(spark):
    rows = [(1, "A", None, "global", "en", False, "https://a.example"), (2, "B", "Norway/Sweden", "regional", "no", False, "https://b.example"), (3, "C", None, "global", "en", True, "https://c.example")]
    return spark.createDataFrame(rows, "id int, name string, country string, scope string, lang string, specialist boolean, website string")


@query(f"""WITH a AS (SELECT canon AS url, min(source_id) AS source_id FROM {_INGESTED} GROUP BY canon),
  q AS (SELECT *, row_number() OVER (ORDER BY source_id, url) AS r FROM a)
  SELECT url, source_id, CASE WHEN r <= 50 THEN 'Org ' || length(url) % 7 END AS company, r <= 50 AS analyzed FROM q""")
def ingest_job(spark, d):
    """The ingest job in three runs: one over half of the feeds, one over all, and that one again; the first fifty articles of a run are analysed."""
    store = jobs.setup(spark, shared_folder(spark, "ingest"), 8)
    feeds, sources = _landed(spark, d), _sources(spark)
    store.run("ingest", "1", lambda tx: jobs.ingest(tx, feeds.where("source_id = 3"), sources, NOW, terms=["drone"]))
    urls = store.read("articles").select("url")
    said = lambda d: d.select("url", F.array(_s("Org ", F.length("url") % 7)).alias("companies"), F.array().cast("array<string>").alias("products"))
    every = jobs.I.ingest(feeds, sources, NOW, terms=["drone"]).select("url").unionByName(urls).distinct()
    for run in ("2", "2"):
        store.run("ingest", run, lambda tx: jobs.ingest(tx, feeds, sources, NOW, said(every), most=50, terms=["drone"]))
    a = store.read("articles")
    return a.select("url", "source_id", F.get("companies", F.lit(0)).alias("company"), F.col("analyzed_at").isNotNull().alias("analyzed"))


_NAME = "CASE WHEN doc_id % 3 < 2 THEN 'Supplier#' || lpad(CAST(doc_id % 10 + 1 AS VARCHAR), 9, '0') ELSE 'Org ' || substring(sha256(CAST(doc_id % 150 AS VARCHAR)), 1, 12) END"


@query(f"""WITH m AS (SELECT DISTINCT lower({_NAME}) AS tag_lc, CASE WHEN doc_id % 3 = 2 THEN doc_id % 150 END AS k FROM documents)
  SELECT tag_lc, CASE WHEN k IS NULL THEN 'matched' WHEN k % 2 = 0 THEN 'created' ELSE 'rejected' END AS decision, CASE WHEN k IS NULL THEN 's' || s_suppkey WHEN k % 2 = 0 THEN sha256('new ' || k) END AS entity_id,
    CASE WHEN k IS NULL THEN 'exact' WHEN k % 2 = 0 THEN 'verdict:created' ELSE 'verdict:rejected' END AS reason
  FROM m LEFT JOIN supplier ON lower(s_name) = tag_lc WHERE k IS NULL OR k % 5 > 0""")
def resolve_job(spark, d):
    """The resolve job over all documents as articles that name a supplier or, a third of them, somebody new, of whom a fifth has no verdict: the decision cache."""
    store = jobs.setup(spark, shared_folder(spark, "resolve"), 4)
    i = F.col("doc_id")
    null, at = F.lit(None), F.lit(NOW).cast("timestamp")
    empty = F.array().cast("array<string>")
    new = lambda k: _s("Org ", F.substring(F.sha2(k.cast("string"), 256), 1, 12))
    name = F.when(i % 3 < 2, _s("Supplier#", F.lpad((i % 10 + 1).cast("string"), 9, "0"))).otherwise(new(i % 150))
    given = {"id": _s("d", i), "url": _s("https://example.com/", i), "title": F.col("source"), "companies": F.array(name), "products": empty, "tags": empty, "published_at": at, "scraped_at": at, "analyzed_at": at}
    fields = [x.split()[0] for x in jobs.ARTICLES.split(", ")]
    tx = store.begin()
    tx.put("articles", t(spark, d, "documents").select(*[given.get(c, null).alias(c) for c in fields]))
    s = t(spark, d, "supplier")
    of = {"id": _s("s", F.col("s_suppkey")), "name": F.col("s_name"), "slug": F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), "source_urls": empty, "created_at": F.timestamp_micros(F.col("s_suppkey"))}
    tx.put("companies", s.select(*[of.get(c, null).alias(c) for c in tx.read("companies").columns]))
    tx.publish()
    k = F.col("id")
    v = spark.range(150).where("id % 5 > 0").select(F.lit("company").alias("kind"), F.lower(new(k)).alias("name_lc"), (k % 2 == 0).alias("ok"), F.lit("company").alias("entity_kind"), _s("New ", k).alias("canonical"), *[null.cast("string").alias(c) for c in ("country", "website", "type", "category", "maker")])
    store.run("resolve", "1", lambda tx: jobs.resolve(tx, v, NOW, most=1 << 30, gate=1 << 30))
    return store.read("tag_resolutions").select("tag_lc", "decision", "entity_id", "reason")


@query("""WITH i AS (SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-28'), top AS (SELECT * FROM i JOIN events USING (event_id)),
  n AS (SELECT count(*) AS every, count(*) FILTER (events.event_type IN ('error', 'view')) AS part FROM top JOIN events USING (event_id))
  SELECT 'a@example.com' AS email, every AS n FROM n WHERE every > 0 UNION ALL SELECT 'b@example.com', part FROM n WHERE part > 0""")
def digest_job(spark, d):
    """The digest job, run twice for one day, over events as articles: the items in the letters of each recipient."""
    store = jobs.setup(spark, shared_folder(spark, "digest"), 4)
    e = t(spark, d, "events")
    null = F.lit(None)
    key = F.lpad(F.col("event_id").cast("string"), 12, "0")
    given = {"id": key, "url": key, "title": F.col("event_type"), "source": F.lit("S"), "tags": F.array("event_type"), "published_at": F.col("ts").cast("timestamp"), "scraped_at": F.col("ts").cast("timestamp")}
    tx = store.begin()
    tx.put("articles", e.select(*[given.get(x.split()[0], null).alias(x.split()[0]) for x in jobs.ARTICLES.split(", ")]))
    tx.publish()
    to = spark.createDataFrame([("a@example.com", []), ("b@example.com", ["error", "view"]), ("c@example.com", ["none"])], "email string, tags array<string>")
    for run in ("1", "2"):
        store.run("digest", run, lambda tx: jobs.digest(tx, to, NOW))
    return store.read("outbox").groupBy("email").agg(F.sum("n").alias("n"))


# ---- searches ----

_ASKED = ["the of", "und zueinen", "license", "les éon the", "nowhere"]
_TEXT = "CASE WHEN doc_id % 10 = 3 THEN 'license ' || text ELSE text END"
_ALIVE = "doc_id % 13 <> 5"


def _indexed(spark, d, kind):
    """An index of documents made in three segments: all, a tenth with another text, and a thirteenth deleted.

    An index of grams has the documents in its store, where ILIKE looks at their texts; one of words answers alone.
    """
    store = Store(spark, shared_folder(spark, kind))
    docs = t(spark, d, "documents").select("doc_id", "text")
    index, looked_at = Index(store, kind, "doc_id", kind, 32), kind == "grams"
    tx = store.begin()
    if looked_at:
        tx.create("documents", docs.schema, ["doc_id"], 32)
        tx.put("documents", docs)
    index.refresh(tx, docs)
    tx.publish()
    changed = docs.where("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("license "), "text"))
    gone = docs.where("doc_id % 13 = 5").select("doc_id")
    tx = store.begin()
    if looked_at:
        tx.merge("documents", changed, lambda old, new: tables.upsert(old, new, ["doc_id"]))
    index.refresh(tx, changed)
    if looked_at:
        tx.merge("documents", gone, lambda old, x: tables.delete(old, x, "doc_id"))
    index.refresh(tx, changed.limit(0), deleted=gone)
    tx.publish()
    return store, index


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower({_TEXT}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents WHERE {_ALIVE}),
  n AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM w),
  q AS (SELECT q, unnest(list_distinct(string_split(q, ' '))) AS term FROM (VALUES {', '.join(f"('{x}')" for x in _ASKED)}) AS v(q)),
  tf AS (SELECT doc_id, len(ws) AS size, term, len(list_filter(ws, lambda x: x = term)) AS tf FROM w, (SELECT DISTINCT term FROM q) WHERE list_contains(ws, term)),
  idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY term, n),
  s AS (SELECT q, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS e FROM q JOIN tf USING (term) JOIN idf USING (term), n GROUP BY q, doc_id)
  SELECT q, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(e, 9) DESC, doc_id) <= 20""")
def text_search(spark, d):
    """Ranked searches through the index, after a refresh and deletions."""
    _, index = _indexed(spark, d, "words")
    found = None
    for q in _ASKED:
        rows = index.search(q, 20).select(F.lit(q).alias("q"), "doc_id", F.round("score", 6).alias("score"))
        found = rows if found is None else found.unionByName(rows)
    return found


_ALL_TERMS = lambda q: " AND ".join(f"list_contains(ws, '{x}')" for x in dict.fromkeys(q.split(" ")))


@query(f"WITH w AS (SELECT doc_id, string_split_regex(lower({_TEXT}), '[^\\p{{L}}\\p{{N}}]+') AS ws FROM documents WHERE {_ALIVE}) " + " UNION ALL ".join(f"SELECT '{q}' AS q, doc_id FROM w WHERE {_ALL_TERMS(q)}" for q in _ASKED))
def text_match(spark, d):
    """Which documents have every term, by the index compacted to one segment."""
    store, index = _indexed(spark, d, "words")
    tx = store.begin()
    index.compact(tx)
    tx.publish()
    found = [index.match(q).select(F.lit(q).alias("q"), "doc_id") for q in _ASKED]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


_PATTERNS = ["%license%", "%RIGHTS reserved%", "%the _n%ing%", "%ungver%schen%", "%Éon%", "%zzqx%", "%a%"]


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, doc_id FROM (SELECT doc_id, {_TEXT} AS text FROM documents WHERE {_ALIVE}) WHERE text ILIKE '{p}'" for p in _PATTERNS))
def substring_search(spark, d):
    """ILIKE over whole texts, by runs of three characters and a look at the texts that have them all."""
    _, index = _indexed(spark, d, "grams")
    out = None
    for p in _PATTERNS:
        rows = index.ilike(p, "documents").select(F.lit(p).alias("pattern"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- pages ----


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 50 > 0 THEN ts END AS seen FROM events)
  SELECT k AS page, event_id FROM (SELECT (row_number() OVER (ORDER BY seen DESC NULLS LAST, event_id) - 1) AS r, event_id FROM e), (VALUES (0), (1), (30), (98)) v(k) WHERE r // 24 = k AND (SELECT count(*) FROM e) > 0
    AND k <> 98 OR k = 98 AND r >= (SELECT count(*) FROM e) - 10""")
def feed_pages(spark, d):
    """Pages by cursor at the top and deep in a feed, and its last ten rows, which have no time: as by offset."""
    events = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 50 > 0, F.col("ts")).alias("at"))
    feed = Feed(spark, shared_folder(spark, "feed"), "at", "event_id")
    feed.write(events, 16)
    order = [F.desc_nulls_last("at"), F.asc("event_id")]
    back = [F.asc_nulls_first("at"), F.desc("event_id")]
    behind = lambda n, *by: feed.cursor(events.orderBy(*by).offset(n).limit(1))
    # What is near the end is looked for from there: an offset from the top would send all rows before it to the driver.
    cursors = {0: None, 1: feed.cursor(feed.page()), 30: behind(30 * 24 - 1, *order) or behind(0, *back), 98: behind(10, *back)}
    out = None
    for k, after in cursors.items():
        rows = feed.page(after).select(F.lit(k).alias("page"), "event_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS customers FROM (
  SELECT CASE WHEN {_CHANGED} THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 100 <> 2 UNION ALL SELECT 'N', 0 FROM orders WHERE {_CHANGED}) GROUP BY 1""")
def counts_kept(spark, d):
    """Counts and sums of orders by status, made once and then kept up to date from the changes alone."""
    store = Store(spark, shared_folder(spark, "counts"))
    orders = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("bigint").alias("o_custkey"), "o_orderstatus", "o_totalprice")
    store.write("orders", orders, ["o_orderkey"], 32)
    aggregates.refresh(store, "orders", "by_status", ["o_orderstatus"], ["o_custkey"])
    _change(store, orders)
    return aggregates.refresh(store, "orders", "by_status", ["o_orderstatus"], ["o_custkey"]).withColumnRenamed("sum_o_custkey", "customers")
