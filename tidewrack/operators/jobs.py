"""The three jobs over a store: ingest, resolve, digest. Each is a function of a transaction, to be given to Store.run().

    store.run("ingest", "2025-06-10", lambda tx: jobs.ingest(tx, feeds, sources, now, replies))

A job's tables are published together or not at all, so it can be stopped and
run again at any point, and a run that was published isn't done twice. In a dry
transaction the same steps are worked out and nothing is written. External
services are tables: replies of text analysis, verdicts on names. What a job
hasn't got an answer for stays in its queue for the next run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ingest as I
from . import resolve as R
from . import serving, tables
from .store import Store, Transaction

ARTICLES = (
    "id string, url string, url_hash string, title string, summary string, image_url string, source string, source_id int, source_url string, country string, lang string, tags array<string>, "
    "companies array<string>, products array<string>, published_at timestamp, scraped_at timestamp, analyzed_at timestamp, entities_resolved_at timestamp"
)
_ENTITY = "name string, slug string, hq_country string, website string, publication_status string, confidence string, source_urls array<string>"
_SIDE = "slug string, name string, hq_country string, website string, source_urls array<string>"
#: Schema and key of each table.
TABLES = {
    "articles": (ARTICLES, ["url"]),
    "companies": (f"id string, {_ENTITY}, company_type string, created_at timestamp", ["id"]),
    "company_aliases": ("company_id string, alias string, type string, created_at timestamp", ["company_id", "alias"]),
    "products": (f"id string, {_ENTITY}, category string, created_at timestamp", ["id"]),
    "product_companies": ("product_id string, company_id string, role string", ["product_id", "company_id", "role"]),
    "tag_resolutions": ("kind string, tag_lc string, tag string, decision string, entity_id string, reason string, created_at timestamp", ["kind", "tag_lc"]),
    "article_companies": ("article_id string, company_id string", ["article_id", "company_id"]),
    "article_products": ("article_id string, product_id string", ["article_id", "product_id"]),
    "investors": (_SIDE, ["slug"]),
    "institutions": (_SIDE, ["slug"]),
    "outbox": ("id string, email string, subject string, html string, n bigint, created_at timestamp", ["id"]),
}


def setup(spark: SparkSession, folder: str, buckets: int = 16) -> Store:
    """A store that has all tables; those that there are stay as they are."""
    store = Store(spark, folder)
    tx = store.begin()
    for name, (schema, keys) in TABLES.items():
        tx.create(name, schema, keys, buckets)
    tx.publish()
    return store


def _at(now: dt.datetime) -> Column:
    return F.lit(now).cast("timestamp")


def _insert(tx: Transaction, name: str, rows: DataFrame, order: list | None = None) -> None:
    """Rows whose keys aren't there yet."""
    tx.merge(name, rows, lambda old, new: tables.insert_ignore(old, new, tx.keys(name), order))


def ingest(tx: Transaction, feeds: DataFrame, sources: DataFrame, now: dt.datetime, replies: DataFrame | None = None, days: int = 14, most: int = 80, **vocabulary) -> list[dict]:
    """Merge new articles of feeds (source_id, xml), then fill in what replies (url, companies, products) say of the first of them that nobody analysed. A report by source: kept rows."""
    rows = I.ingest(feeds, sources, now, days, **vocabulary)
    tx.merge("articles", rows, lambda old, new: I.merge(old, new, _at(now)))
    mine = tx.read("articles").join(rows.select("url"), "url", "left_semi")
    if replies is not None:
        queue = tables.work_queue(mine, "analyzed_at", ["source_id", "url"], most).select("url")
        empty = F.array().cast("array<string>")
        known = tables.first_by(replies.join(queue, "url", "left_semi"), ["url"], [F.col("companies").cast("string"), F.col("products").cast("string")])
        answers = known.select("url", F.coalesce("companies", empty).alias("companies"), F.coalesce("products", empty).alias("products"), _at(now).alias("analyzed_at"))
        tx.merge("articles", answers, lambda old, new: tables.patch(old, new, ["url"]))
    return [r.asDict() for r in mine.groupBy("source").agg(F.count("*").alias("kept")).orderBy("source").collect()]


def _catalogue(tx: Transaction) -> tuple[DataFrame, DataFrame, DataFrame]:
    """exact and normed keys of companies, and products, earlier entries first."""
    ord_ = F.unix_micros("created_at").alias("ord")
    exact, normed = R.company_keys(tx.read("companies").select(ord_, "id", "name"), tx.read("company_aliases").select(ord_, "company_id", "alias"))
    return exact, normed, tx.read("products").select(ord_, "id", "name")


def _match(tags: DataFrame, kind: str, exact: DataFrame, normed: DataFrame, products: DataFrame) -> DataFrame:
    return R.match_companies(tags, exact, normed) if kind == "company" else R.match_products(tags, products)


def resolve(tx: Transaction, verdicts: DataFrame, now: dt.datetime, most: int = 150, gate: int = 40) -> dict[str, int]:
    """Decide what the names in the newest unresolved articles are, by cache, catalogue, blocklist and verdicts (as of enrich.verdict_fields), create what is new, link and stamp.

    An article is stamped once all its names are decided. The numbers of decisions by kind and outcome.
    """
    unresolved = tables.work_queue(tx.read("articles").where("analyzed_at IS NOT NULL"), "entities_resolved_at", serving.newest(), most)
    queue = tx.stage("queue", unresolved.select("id", "url", "title", "companies", "products", F.row_number().over(Window.orderBy(*serving.newest())).alias("ord")))
    live = tx.read("companies").select(F.lit("company").alias("kind"), "id").unionByName(tx.read("products").select(F.lit("product").alias("kind"), "id"))
    _, stale = R.heal_cache(tx.read("tag_resolutions"), live)
    tx.merge("tag_resolutions", stale.select("kind", "tag_lc"), lambda old, gone: old.join(gone, ["kind", "tag_lc"], "left_anti"))
    cache, catalogue = tx.read("tag_resolutions"), _catalogue(tx)
    slugs = tx.read("companies").select("slug").unionByName(tx.read("products").select("slug"))
    counts, final, outcomes = {}, {}, {}
    for kind in ("company", "product"):
        found = R.mentions(queue, kind)
        tags = found.groupBy("lo").agg(F.min("tag").alias("tag"))
        decided = tx.stage("decided", R.decide(found, cache, _match(tags, kind, *catalogue), kind))
        said = verdicts.where(F.col("kind") == kind).drop("kind")
        asked = R.gate_input(found, decided, gate)
        canonical = _match(said.where("ok").select(F.lower("canonical").alias("lo"), F.col("canonical").alias("tag")), kind, *catalogue)
        named = said.where("ok").select("name_lc", F.lower("canonical").alias("lo")).join(canonical, "lo").select("name_lc", "id", "reason")
        outcome = outcomes[kind] = tx.stage("outcomes", R.apply_verdicts(asked, tables.first_by(said, ["name_lc"], ["canonical"]), tables.first_by(named, ["name_lc"], ["id"])))
        news = outcome.where("outcome <> 'undecided'").select("lo", F.when(F.col("outcome").isin("matched", "created"), F.col("outcome")).otherwise("rejected").alias("_d"), F.col("entity_id").alias("_e"), F.col("reason").alias("_r"))
        both = decided.join(news, "lo", "left")
        new = F.col("_d").isNotNull()
        final[kind] = tx.stage("decisions", both.select("lo", "tag", F.coalesce("_d", "decision").alias("decision"), F.when(new, F.col("_e")).otherwise(F.col("entity_id")).alias("entity_id"), F.coalesce("_r", "reason").alias("reason"), F.when(new, "verdict").otherwise(F.col("source")).alias("source")))
    companies, aliases = R.new_companies(outcomes["company"], slugs)
    companies = tx.stage("companies", companies)
    products, makers = R.new_products(outcomes["product"], slugs.unionByName(companies.select("slug")), catalogue[0], catalogue[1], companies.select("id", "name"))
    # All that is written is worked out from the tables as they were, so nothing below sees its own effects.
    plan = {
        "companies": companies.withColumn("created_at", _at(now)),
        "products": products.withColumn("created_at", _at(now)),
        "company_aliases": aliases.withColumns({"type": F.lit("aka"), "created_at": _at(now)}),
        "product_companies": makers,
        "investors": R.side_rows(outcomes["company"], "investor"),
        "institutions": R.side_rows(outcomes["company"], "institution"),
        "article_companies": R.links(R.mentions(queue, "company"), final["company"]),
        "article_products": R.links(R.mentions(queue, "product"), final["product"], name="product_id"),
    }
    learnt = [final[k].where("source NOT IN ('cache', 'unknown')").select(F.lit(k).alias("kind"), F.col("lo").alias("tag_lc"), "tag", "decision", "entity_id", "reason", _at(now).alias("created_at")) for k in final]
    plan["tag_resolutions"] = learnt[0].unionByName(learnt[1])
    done = R.complete_articles(queue, R.mentions(queue, "company"), final["company"]).join(R.complete_articles(queue, R.mentions(queue, "product"), final["product"]), "article_id")
    stamps = queue.join(done.withColumnRenamed("article_id", "id"), "id", "left_semi").select("url", _at(now).alias("entities_resolved_at"))
    for kind, rows in final.items():
        counts |= {f"{kind} {r.source}": r.n for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for name, rows in plan.items():
        _insert(tx, name, rows)
    tx.merge("articles", stamps, lambda old, new: tables.patch(old, new, ["url"]))
    return counts


def digest(tx: Transaction, recipients: DataFrame, now: dt.datetime, period: str = "day", most: int = 600, subject: str | None = None) -> int:
    """Put letters for each recipient (email, tags) that has new articles into the outbox, whose ids keep a letter from being sent twice. The number of letters there are for this run.

    All new articles go out: most are in a letter, the newest in the first. Who has a letter of the day gets no further ones.
    """
    items = serving.since(tx.read("articles"), now, {"day": 24, "week": 24 * 7}[period], None)
    wanted = recipients.select("email", F.coalesce("tags", F.array().cast("array<string>")).alias("wanted"))
    subject = subject or {"day": "Daily digest", "week": "Weekly roundup"}[period]
    before = tx.read("outbox").select("id")
    unsent = recipients.join(before, serving.letter_id(subject, now.date()) == before["id"], "left_anti")
    letters = serving.digest_html(serving.in_letters(serving.for_recipients(items, unsent), most).join(wanted, "email"), period, ["email", "part"])
    rows = serving.outbox(letters, subject, now.date()).withColumn("created_at", _at(now))
    _insert(tx, "outbox", rows)
    return tx.read("outbox").join(before, "id", "left_anti").count()
