"""Feeds, sitemaps and pages that were landed as text, as frames of items. Malformed markup gives nulls or no rows, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def _first(block: Column, *tags: str) -> Column:
    return F.coalesce(*[X.first_element(block, t) for t in tags])


def _link(block: Column, atom: Column) -> Column:
    href = X.first_attribute(block, "link", "href")
    after = X.empty_to_null(F.regexp_extract(block, r"""(?is)<link\b[^>]*\brel\s*=\s*["']alternate["'][^>]*\bhref\s*=\s*["']([^"']*)["']""", 1))
    before = X.empty_to_null(F.regexp_extract(block, r"""(?is)<link\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*\brel\s*=\s*["']alternate["']""", 1))
    text = X.empty_to_null(X.trim(X.unwrap_cdata(X.first_element(block, "link"))))
    return X.empty_to_null(X.trim(X.decode_entities(F.when(atom, F.coalesce(after, before, href, text)).otherwise(F.coalesce(text, href)))))


def _image(block: Column) -> Column:
    enclosure = X.empty_to_null(F.regexp_extract(block, r"(?is)<enclosure\b[^>]*>", 0))
    kind, url = X.first_attribute(enclosure, "enclosure", "type"), X.first_attribute(enclosure, "enclosure", "url")
    body = [X.first_attribute(X.decode_entities(X.unwrap_cdata(X.first_element(block, t))), "img", "src") for t in ("content:encoded", "description", "content", "summary")]
    found = F.coalesce(X.first_attribute(block, "media:content", "url"), X.first_attribute(block, "media:thumbnail", "url"), F.when(kind.isNull() | kind.rlike("(?i)^image/"), url), *body)
    return X.empty_to_null(X.trim(X.decode_entities(found)))


def parse_feeds(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """All columns but the xml, with item_ord, url, title, summary, image_url, published_at, categories for every item of RSS 2.0 or Atom."""
    atom = F.col(xml).rlike("(?i)<entry") & ~F.col(xml).rlike("(?i)<item")
    blocks = F.when(atom, X.all_elements(F.col(xml), "entry")).otherwise(X.all_elements(F.col(xml), "item"))
    rest = [c for c in feeds.columns if c != xml]
    items = feeds.select(*rest, atom.alias("_atom"), F.posexplode(blocks).alias("item_ord", "_b"))
    b = F.col("_b")
    elements = F.regexp_extract_all(b, F.lit(r"(?is)<category\b[^>]*/>|<category\b[^>]*>.*?</category>"), F.lit(0))
    category = lambda e: X.strip_html(F.coalesce(X.first_attribute(e, "category", "term"), X.first_element(e, "category")))
    out = items.select(
        *rest, "item_ord",
        _link(b, F.col("_atom")).alias("url"),
        X.empty_to_null(X.strip_html(X.first_element(b, "title"))).alias("title"),
        X.clip(X.strip_html(_first(b, "description", "summary", "content:encoded", "content")), 300).alias("summary"),
        _image(b).alias("image_url"),
        X.parse_date(X.unwrap_cdata(_first(b, "pubDate", "published", "updated", "dc:date", "date"))).alias("published_at"),
        F.filter(F.transform(elements, category), lambda c: c != "").alias("categories"),
    )
    return out.where(F.col("url").isNotNull() & F.col("title").isNotNull())


def is_sitemap_index(xml: Column) -> Column:
    return F.coalesce(xml.rlike("(?i)<sitemapindex"), F.lit(False))


def parse_sitemaps(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    """All columns but the xml, with is_index, entry_ord, loc, lastmod for every entry that has a loc."""
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(?:url|sitemap)(?:\s[^>]*)?>(.*?)</(?:url|sitemap)>"), F.lit(1))
    rest = [c for c in sitemaps.columns if c != xml]
    d = sitemaps.select(*rest, is_sitemap_index(F.col(xml)).alias("is_index"), F.posexplode(blocks).alias("entry_ord", "_b"))
    loc = X.empty_to_null(X.trim(X.decode_entities(X.unwrap_cdata(X.first_element(F.col("_b"), "loc")))))
    return d.select(*rest, "is_index", "entry_ord", loc.alias("loc"), X.parse_date(X.first_element(F.col("_b"), "lastmod")).alias("lastmod")).where("loc IS NOT NULL")


def discover_sitemaps(robots: DataFrame) -> DataFrame:
    """website, ord, url: Sitemap lines of robots.txt first, then the usual places. robots: website, robots."""
    lines = F.filter(F.transform(F.split(F.coalesce("robots", F.lit("")), "\n"), lambda x: F.regexp_extract(x, r"(?i)^\s*sitemap:\s*(\S+)", 1)), lambda x: x != "")
    base = F.regexp_replace("website", "/+$", "")
    usual = F.array(*[F.concat(base, F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/news-sitemap.xml")])
    return robots.select("website", F.posexplode(F.array_distinct(F.concat(lines, usual))).alias("ord", "url"))


def crawl_sitemaps(seeds: DataFrame, sitemaps: DataFrame, since: Column, max_sitemaps: int = 12, max_urls: int = 400) -> DataFrame:
    """website, loc, lastmod: pages reachable from the seeds (website, url) over landed sitemaps (url, xml), newest first.

    An index's children are followed when they have no date or one after since
    less 31 days; pages go only if their date is before since. Both limits hold
    for each website as a whole: at most max_sitemaps are read, those nearest to
    the seeds and latest first. A level reads one at least, so levels end by
    themselves, however deep indexes are nested.
    """
    from pyspark.sql.window import Window

    entries = parse_sitemaps(sitemaps)
    level, seen, pages = seeds.select("website", "url", F.lit(None).cast("timestamp").alias("lastmod")), None, None
    rank = lambda d, keys, n: d.withColumn("_r", F.row_number().over(Window.partitionBy("website").orderBy(*keys))).where(F.col("_r") <= n).drop("_r")
    for _ in range(max_sitemaps):
        level = level.groupBy("website", "url").agg(F.max("lastmod").alias("lastmod"))
        if seen is not None:
            read = seen.groupBy("website").agg(F.count("*").alias("_n"))
            level = level.join(seen.select("website", "url"), ["website", "url"], "left_anti").join(read, "website", "left")
        else:
            level = level.withColumn("_n", F.lit(0))
        at = F.row_number().over(Window.partitionBy("website").orderBy(F.desc_nulls_last("lastmod"), "url"))
        level = level.withColumn("_r", at).where(F.col("_r") + F.coalesce("_n", F.lit(0)) <= max_sitemaps).select("website", "url")
        # Few rows, at most max_sitemaps a website; kept, so that levels aren't worked out again.
        level = level.checkpoint() if level.sparkSession.sparkContext.getCheckpointDir() else level.persist()
        if level.isEmpty():
            break
        seen = level if seen is None else seen.unionByName(level)
        here = level.join(entries, "url")
        found = here.where(~F.col("is_index") & (F.col("lastmod").isNull() | (F.col("lastmod") >= since))).select("website", "loc", "lastmod")
        pages = found if pages is None else pages.unionByName(found)
        below = here.where(F.col("is_index") & (F.col("lastmod").isNull() | (F.col("lastmod") >= since - F.expr("INTERVAL 31 DAYS"))))
        level = below.select("website", F.col("loc").alias("url"), "lastmod")
    if pages is None:
        pages = seeds.select("website", F.col("url").alias("loc"), F.lit(None).cast("timestamp").alias("lastmod")).limit(0)
    pages = pages.groupBy("website", "loc").agg(F.max("lastmod").alias("lastmod"))
    return rank(pages, [F.desc_nulls_last("lastmod"), "loc"], max_urls)


def _meta(html: Column, name: str) -> Column:
    """content of a meta element by property or name, in either order; a quote of the other kind may be inside."""
    key = rf"""\b(?:property|name)\s*=\s*["']{name}["']"""
    found = [X.empty_to_null(F.regexp_extract(html, rf"(?is)<meta\b[^>]*?{p}", 1)) for q in ('"', "'") for p in (rf"{key}[^>]*?\bcontent\s*=\s*{q}([^{q}]*){q}", rf"\bcontent\s*=\s*{q}([^{q}]*){q}[^>]*?{key}")]
    return F.coalesce(*found)


def extract_meta(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns with title, summary, image_url, published_at from a page's meta elements."""
    h = F.col(html)
    pick = lambda *xs: X.empty_to_null(X.strip_html(F.coalesce(*xs)))
    return pages.select(
        "*",
        pick(_meta(h, "og:title"), X.first_element(h, "title")).alias("title"),
        X.empty_to_null(X.clip(X.strip_html(F.coalesce(_meta(h, "og:description"), _meta(h, "description"))), 300)).alias("summary"),
        X.decode_entities(F.coalesce(_meta(h, "og:image"), _meta(h, "og:image:url"), _meta(h, "twitter:image"))).alias("image_url"),
        X.parse_date(F.coalesce(_meta(h, "article:published_time"), _meta(h, "og:updated_time"), X.first_attribute(h, "time", "datetime"))).alias("published_at"),
    )
