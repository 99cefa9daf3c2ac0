"""Entities of an external knowledge base, landed as nested JSON, as rows of claims and labels.

An entity is {"id", "claims": {property: [{"mainsnak": {"datavalue": {"value"}}, "qualifiers": {property: [...]}}]}, "labels", "sitelinks"}.
Its two levels of claims are opened with variant_explode, so no property has to
be known beforehand. Texts that aren't JSON, and entities marked as missing,
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import empty_to_null
from ..operators.enrich import facts
from ..operators.tables import first_by

#: Properties of the knowledge base, and what a value of each becomes in front of it.
INSTANCE_OF, WEBSITE, SEAT, EXCHANGE, LOGO, LINKEDIN, TWITTER, POINT_IN_TIME = "P31", "P856", "P159", "P414", "P154", "P4264", "P2002", "P585"
LINKS = {LOGO: "https://commons.wikimedia.org/wiki/Special:FilePath/", LINKEDIN: "https://www.linkedin.com/company/", TWITTER: "https://twitter.com/"}
ARTICLES = "https://en.wikipedia.org/wiki/"


def _at(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _entities(entities: DataFrame, json: str) -> DataFrame:
    d = entities.select(F.try_parse_json(json).alias("_v"))
    return d.select(_at("_v", "$.id").alias("qid"), "_v").where(F.col("qid").isNotNull() & _at("_v", "$.missing", "variant").isNull())


def claims(entities: DataFrame, json: str = "json") -> DataFrame:
    """qid, property, pos, value, unit, time, qualifiers of all claims: a value's time, amount or id, else itself; time is that of the first point-in-time qualifier. An entity without claims has a row of nulls."""
    tvf = entities.sparkSession.tvf
    d = _entities(entities, json).select("qid", _at("_v", "$.claims", "variant").alias("_c"))
    d = d.lateralJoin(tvf.variant_explode_outer(F.col("_c").outer())).select("qid", F.col("key").alias("property"), F.col("value").alias("_l"))
    d = d.lateralJoin(tvf.variant_explode_outer(F.col("_l").outer())).select("qid", "property", "pos", F.col("value").alias("_c"))
    main = d.select("qid", "property", "pos", _at("_c", "$.mainsnak.datavalue.value", "variant").alias("_m"), _at("_c", "$.qualifiers", "variant").alias("qualifiers"))
    value = F.coalesce(_at("_m", "$.time"), _at("_m", "$.amount"), _at("_m", "$.id"), F.when(F.schema_of_variant("_m") == "STRING", _at("_m", "$")))
    return main.select("qid", "property", "pos", value.alias("value"), _at("_m", "$.unit").alias("unit"), _at("qualifiers", f"$.{POINT_IN_TIME}[0].datavalue.value.time").alias("time"), "qualifiers")


def labels(entities: DataFrame, json: str = "json", lang: str = "en") -> DataFrame:
    """id and label of the entities that have one in the language."""
    d = _entities(entities, json).select(F.col("qid").alias("id"), _at("_v", f"$.labels.{lang}.value").alias("label")).where("label IS NOT NULL")
    return first_by(d, ["id"], ["label"])


def titles(entities: DataFrame, json: str = "json", site: str = "enwiki") -> DataFrame:
    return _entities(entities, json).select("qid", _at("_v", f"$.sitelinks.{site}.title").alias("title")).where("title IS NOT NULL")


def url_part(c: Column) -> Column:
    """A text as a part of an address, spaces as _; signs that need no escape stay."""
    e = F.call_function("url_encode", F.replace(c, F.lit(" "), F.lit("_")))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(code), F.lit(sign))
    return e


def candidates(found: DataFrame, known: DataFrame) -> DataFrame:
    """Search results (company_id, rank, qid, ...) with site and instance_of from the claims of their entities; those without an entity go."""
    first = first_by(known.where(F.col("property") == WEBSITE), ["qid"], ["pos"]).select("qid", F.col("value").alias("site"))
    kinds = known.where((F.col("property") == INSTANCE_OF) & F.col("value").isNotNull()).groupBy("qid").agg(F.collect_set("value").alias("instance_of"))
    return found.join(known.select("qid").distinct(), "qid").join(first, "qid", "left").join(kinds, "qid", "left")


def profile(entities: DataFrame, named: DataFrame, json: str = "json", this_year: int = 2100) -> DataFrame:
    """qid with the catalogue's columns: those of facts(), links, the seat and the exchange by name. named: id and label of what entities refer to; all are looked up in one join."""
    known = claims(entities, json)
    first = first_by(known.where(F.col("property").isin(SEAT, EXCHANGE, *LINKS)), ["qid", "property"], ["pos"]).select("qid", "property", "value")
    first = first.join(named.select(F.col("id").alias("value"), "label"), "value", "left")
    of = lambda p, c: F.max(F.when(F.col("property") == p, c))
    link = lambda p: of(p, F.concat(F.lit(LINKS[p]), url_part(F.col("value")) if p == LOGO else empty_to_null(F.col("value"))))
    more = first.groupBy("qid").agg(link(LOGO).alias("logo_url"), link(LINKEDIN).alias("linkedin_url"), link(TWITTER).alias("twitter_url"), of(SEAT, F.col("label")).alias("hq_city"), of(EXCHANGE, F.col("label")).alias("stock_exchange"))
    pages = titles(entities, json).select("qid", F.concat(F.lit(ARTICLES), url_part(F.col("title"))).alias("wikipedia_url"))
    every = facts(known, this_year).join(more, "qid", "full_outer").join(pages, "qid", "full_outer")
    return every.withColumn("is_public", F.when(F.col("stock_exchange").isNotNull(), F.lit(True)).otherwise(F.col("is_public")))
