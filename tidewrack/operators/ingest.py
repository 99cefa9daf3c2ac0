"""From landed feeds or crawled pages to rows of the articles table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import urls as U
from ..functions import vocab
from ..sources.feeds import parse_feeds
from .serving import fresh
from .tables import first_by, insert_ignore, patch, upsert


def gate(items: DataFrame, sources: DataFrame, terms: list[str] = vocab.GATE_TERMS) -> DataFrame:
    """Items of specialist sources, and others with a term in title, summary or categories. Sources are few, but counted by the join's planner, not assumed."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"), F.col("website").alias("source_url"), "country", "scope", "lang", "specialist")
    text = F.concat_ws(" ", "title", "summary", F.array_join(F.coalesce("categories", F.array().cast("array<string>")), " "))
    return items.join(s, "source_id").where(C.is_relevant(text, F.col("specialist"), terms))


def to_rows(items: DataFrame, themes: dict[str, list[str]] = vocab.THEMES) -> DataFrame:
    text = F.concat_ws(" ", "title", "summary", F.array_join(F.coalesce("categories", F.array().cast("array<string>")), " "))
    tags = C.tag_item(text, F.col("categories"), F.col("scope"), F.col("country"), themes)
    return items.select("url", U.url_hash(F.col("url")).alias("url_hash"), "title", "summary", "image_url", "source", "source_id", "source_url", "country", "lang", tags.alias("tags"), "published_at")


def ingest(feeds: DataFrame, sources: DataFrame, now: dt.datetime, days: int = 14, terms: list[str] = vocab.GATE_TERMS, themes: dict[str, list[str]] = vocab.THEMES) -> DataFrame:
    """New rows of feeds (source_id, xml): parsed, fresh, relevant, and of equal canonical urls the first by source and place.

    The gate comes before the choice, so a url that one source is refused can come from another. One shuffle, by url.
    """
    items = gate(fresh(parse_feeds(feeds), now, days), sources, terms)
    items = first_by(items.withColumn("url", U.canonical_url(F.col("url"))), ["url"], ["source_id", "item_ord"])
    return to_rows(items, themes)


def merge(articles: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Upsert by url; a row keeps the time it was first seen, its id follows from its url."""
    empty = F.array().cast("array<string>")
    new = {"id": F.col("_n_url_hash"), "scraped_at": now, "companies": empty, "products": empty}
    return upsert(articles, rows, ["url"], new)


def analysed(articles: DataFrame, replies: DataFrame, now: Column) -> DataFrame:
    """Companies and products of replies (url, companies, products), stamped; urls without a reply stay in the queue."""
    return patch(articles, replies.select("url", "companies", "products", now.alias("analyzed_at")), ["url"])


def subscribe(subscribers: DataFrame, requests: DataFrame) -> DataFrame:
    """Sign-ups with a valid address that isn't there yet; a repeated one is no error."""
    from ..sources.config import valid_email

    ok = requests.withColumn("email", F.lower(F.trim("email"))).where(valid_email(F.col("email")))
    return insert_ignore(subscribers, ok, ["email"], ["created_at", "source"])
