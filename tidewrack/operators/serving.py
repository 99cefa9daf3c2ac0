"""Reading the archive: pages of a feed, recent items, counts, digests, and what is rendered from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vocab
from ..functions.classify import primary_theme, theme_label


def newest(time: str = "published_at", tie: str = "url") -> list[Column]:
    """A total order: time descending, without one last, then the tie-breaker."""
    return [F.desc_nulls_last(time), F.asc(tie)]


def search_pattern(query: str) -> str:
    """An ilike pattern for a search box: %, comma and brackets are blanks; _ and \\ keep their meaning."""
    q = query.strip()
    for c in "%,()":
        q = q.replace(c, " ")
    return f"%{q}%"


def feed_page(articles: DataFrame, tag: str | None = None, query: str | None = None, offset: int = 0, page: int = 24, order: list[Column] | None = None) -> DataFrame:
    """A page of the feed: items with a tag, whose title or summary has the words, newest first."""
    d = articles
    if tag:
        d = d.where(F.array_contains("tags", tag))
    if query and query.strip():
        p = search_pattern(query)
        d = d.where(F.coalesce(F.col("title").ilike(p), F.lit(False)) | F.coalesce(F.col("summary").ilike(p), F.lit(False)))
    return d.orderBy(*(order or newest())).offset(offset).limit(page)


def full_text_terms(title: Column, summary: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", title, summary)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def since(articles: DataFrame, now: dt.datetime, hours: int, limit: int | None = 600, time: str = "scraped_at", order: list[Column] | None = None) -> DataFrame:
    """The newest items of the last hours; without a limit all of them, in no order."""
    d = articles.where(F.col(time) >= F.lit(now - dt.timedelta(hours=hours)))
    return d if limit is None else d.orderBy(*(order or newest())).limit(limit)


def fresh(items: DataFrame, now: dt.datetime, days: int = 14) -> DataFrame:
    """Items that aren't too old; those without a date stay."""
    return items.where(F.col("published_at").isNull() | (F.col("published_at") >= F.lit(now - dt.timedelta(days=days))))


def for_recipients(items: DataFrame, recipients: DataFrame, key: str = "url", block: int = 1000, spread: int = 32) -> DataFrame:
    """Every recipient with the items that have one of its tags, or all items if it has none.

    Tags are joined as rows, so no pair is made that doesn't match. Only those
    who want everything meet every item, which is their result: in blocks of
    about so many recipients, and with the items of each block spread over tasks.
    """
    none = F.array().cast("array<string>")
    wants = recipients.select("email", F.explode("tags").alias("_tag")).distinct()
    tagged = items.select(key, F.explode(F.array_distinct(F.coalesce("tags", none))).alias("_tag"))
    some = tagged.join(wants, "_tag").select("email", key).distinct()
    everything = recipients.where(F.size(F.coalesce("tags", none)) == 0).select("email").distinct()
    blocks = everything.count() // block + 1
    salts = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    who = everything.select("email", F.pmod(F.xxhash64("email"), F.lit(blocks)).cast("int").alias("_b"), salts(spread).alias("_s"))
    what = items.select(key, salts(blocks).alias("_b"), F.pmod(F.xxhash64(key), F.lit(spread)).cast("int").alias("_s"))
    return some.unionByName(what.join(who, ["_b", "_s"]).select("email", key)).join(items, key)


def in_letters(items: DataFrame, most: int = 600) -> DataFrame:
    """Items of recipients with the number (part) of the letter that each goes into: newest first, so many in a letter.

    An item's place is counted from how many newer minutes have and its place in its own, so no task ranks all items of a recipient.
    """
    undated = F.lit(-(1 << 53))
    d = items.withColumn("_minute", F.coalesce(F.floor(F.unix_micros(F.col("published_at").cast("timestamp")) / 60_000_000).cast("bigint"), undated))
    newer = Window.partitionBy("email").orderBy(F.desc("_minute")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = d.groupBy("email", "_minute").agg(F.count("*").alias("_n")).select("email", "_minute", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_ahead"))
    placed = d.withColumn("_r", F.row_number().over(Window.partitionBy("email", "_minute").orderBy(*newest()))).join(ahead, ["email", "_minute"])
    return placed.withColumn("part", F.floor((F.col("_ahead") + F.col("_r") - 1) / most).cast("int") + 1).drop("_minute", "_r", "_ahead")


def digest(items: DataFrame, by: list[str] | None = None, order: list[str] | None = None, key: str = "url") -> DataFrame:
    """Themes with their items, each item in its first theme: theme, label, place, n, urls (newest first); for each value of by."""
    by = by or []
    names = [*(order or []), "other"]
    themed = items.withColumn("theme", primary_theme(F.col("tags"), order) if order else primary_theme(F.col("tags")))
    if not order:
        from ..functions.vocab import THEME_LABELS

        names = list(THEME_LABELS)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("theme")).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("published_at").isNull().alias("undated"), (-F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0))).alias("t"), F.col(key).alias("k"))))
    return themed.groupBy(*by, "theme").agg(F.count("*").alias("n"), F.transform(ordered, lambda x: x["k"]).alias("urls")).select(*by, "theme", theme_label(F.col("theme")).alias("label"), place.alias("place"), "n", "urls")


def card_html() -> Column:
    """An item as HTML: image or numbered placeholder, title, up to four companies and three tags."""
    chips = lambda c, n: F.array_join(F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), lambda x: F.concat(F.lit("<li>"), X.escape_html(x), F.lit("</li>"))), "")
    image = F.coalesce(F.concat(F.lit('<img src="'), X.escape_html(X.empty_to_null(F.col("image_url"))), F.lit('">')), F.concat(F.lit('<span class="blank-'), X.placeholder(F.col("url")).cast("string"), F.lit('"></span>')))
    return F.concat(F.lit('<article><a href="'), X.escape_html(F.col("url")), F.lit('">'), image, F.lit("<h2>"), X.escape_html(F.col("title")), F.lit("</h2></a><p>"), X.escape_html(F.col("summary")), F.lit("</p><ul>"), chips(F.col("companies"), 4), chips(F.col("tags"), 3), F.lit("</ul></article>"))


def rss_item() -> Column:
    date = F.coalesce(F.concat(F.lit("<pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate>")), F.lit(""))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), X.escape_html(F.col(c)), F.lit(f"</{name}>"))
    return F.concat(F.lit("<item>"), tag("title", "title"), tag("link", "url"), tag("guid", "url"), tag("description", "summary"), date, F.lit("</item>"))


def rss(items: DataFrame, title: str, link: str, most: int = 50) -> DataFrame:
    """One row with an RSS 2.0 document of the newest items."""
    rows = items.orderBy(*newest()).limit(most).select(F.struct(F.col("published_at").isNull().alias("u"), (-F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0))).alias("t"), "url", rss_item().alias("x")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), "")
    return rows.agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'), X.escape_html(F.lit(title)), F.lit("</title><link>"), X.escape_html(F.lit(link)), F.lit("</link>"), body, F.lit("</channel></rss>")).alias("rss"))


def sitemap(items: DataFrame, base: str) -> DataFrame:
    return items.agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), F.lit(base), F.lit("</loc><lastmod>"), F.coalesce(F.date_format(F.max("published_at"), "yyyy-MM-dd"), F.lit("")), F.lit("</lastmod></url></urlset>")).alias("xml"))


def short_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "d MMM"), F.lit(""))


def digest_item() -> Column:
    """An item of a digest as HTML: image if it has one, source and date, title as a link, summary."""
    image = F.coalesce(F.concat(F.lit('<img src="'), X.escape_html(X.empty_to_null(F.col("image_url"))), F.lit('">')), F.lit(""))
    summary = F.coalesce(F.concat(F.lit("<p>"), X.escape_html(X.empty_to_null(F.col("summary"))), F.lit("</p>")), F.lit(""))
    return F.concat(F.lit("<li>"), image, F.lit("<small>"), X.escape_html(F.col("source")), F.lit(" · "), short_date(F.col("published_at")), F.lit('</small> <a href="'), X.escape_html(F.col("url")), F.lit('">'), X.escape_html(F.col("title")), F.lit("</a>"), summary, F.lit("</li>"))


def digest_html(items: DataFrame, period: str = "day", by: list[str] | None = None, site: str = "https://example.org/", unsubscribe: str = "unsubscribe@example.org") -> DataFrame:
    """Items as one HTML text for each value of by: a count, a section for each theme, what it is filtered by, and a link to leave.

    items: those of for_recipients(), with title, summary, image_url, source, published_at and tags; wanted, if there, is what the recipient chose.
    """
    by = by or []
    wanted = F.col("wanted") if "wanted" in items.columns else F.array().cast("array<string>")
    d = items.withColumn("_theme", primary_theme(F.col("tags")))
    place = F.array_position(F.array(*map(F.lit, vocab.THEME_LABELS)), F.col("_theme")).cast("int")
    row = F.struct(F.col("published_at").isNull().alias("undated"), (-F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0))).alias("t"), F.col("url").alias("k"), digest_item().alias("html"))
    parts = d.groupBy(*by, "_theme", place.alias("_place")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["html"]), "").alias("body"), F.first(F.coalesce(wanted, F.array().cast("array<string>"))).alias("_wanted"))
    section = F.concat(F.lit("<h3>"), X.escape_html(theme_label(F.col("_theme"))), F.lit(" ("), F.col("n").cast("string"), F.lit(")</h3><ul>"), F.col("body"), F.lit("</ul>"))
    total = F.sum("n")
    head = F.concat(F.lit("<h1>" + {"day": "Daily digest", "week": "Weekly roundup"}[period] + "</h1><p>"), total.cast("string"), F.lit(" new item"), F.when(total == 1, "").otherwise("s"), F.lit("</p>"))
    whole = parts.groupBy(*by).agg(head.alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", section.alias("h")))), lambda s: s["h"]), "").alias("sections"), total.alias("n"), F.max("_wanted").alias("wanted"))
    note = F.when(F.size("wanted") > 0, F.concat(F.lit("<p>Filtered to your topics: "), X.escape_html(F.array_join(F.transform("wanted", lambda x: theme_label(x)), ", ")), F.lit(".</p>"))).otherwise("")
    mail = F.col("email") if "email" in by else F.lit("")
    leave = F.concat(F.lit(f'<p><a href="{site}">Open the full feed</a></p><p><a href="mailto:{unsubscribe}?subject='), F.call_function("url_encode", F.concat(F.lit("Unsubscribe "), mail)), F.lit('">Unsubscribe</a></p>'))
    return whole.select(*by, F.concat("head", "sections", note, leave).alias("html"), "n")


def letter_id(subject: str, day: dt.date, part: Column | None = None) -> Column:
    """The id of a recipient's letter of a day, the first or, with part, one of several."""
    return F.sha2(F.concat_ws("\n", "email", F.lit(str(day)), F.lit(subject), F.lit(None).cast("string") if part is None else F.when(part > 1, part.cast("string"))), 256)


def outbox(letters: DataFrame, subject: str, day: dt.date) -> DataFrame:
    """What a mailer takes: id, email, subject, html, n. The id follows from recipient, day, subject and part, if there is one, so a repeated run sends nothing twice."""
    part = F.col("part") if "part" in letters.columns else F.lit(1)
    number = F.when(part > 1, F.concat(F.lit(" ("), part.cast("string"), F.lit(")"))).otherwise("")
    return letters.where("n > 0").select(letter_id(subject, day, part).alias("id"), "email", F.concat(F.lit(f"{subject} — "), F.col("n").cast("string"), F.lit(" new item"), F.when(F.col("n") == 1, "").otherwise("s"), number).alias("subject"), "html", "n")


def feed_json(items: DataFrame, most: int = 120) -> DataFrame:
    """One row with the newest items as a JSON array."""
    rows = items.orderBy(*newest()).limit(most)
    each = F.struct(F.col("published_at").isNull().alias("u"), (-F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0))).alias("t"), "url", F.to_json(F.struct(*items.columns)).alias("j"))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda r: r["j"]), ","), F.lit("]")).alias("json"))


def robots(site: str) -> str:
    return f"User-agent: *\nAllow: /\nSitemap: {site.rstrip('/')}/sitemap.xml\n"


def source_report(items: DataFrame, kept: Column, by: str = "source") -> DataFrame:
    return items.groupBy(by).agg(F.count_if(kept).alias("kept"), F.count("*").alias("total"))
