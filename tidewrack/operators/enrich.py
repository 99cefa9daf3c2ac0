"""Filling the catalogue: checked profile fields, and facts of an external knowledge base landed as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import vocab
from ..functions.classify import employee_band
from ..functions.text import empty_to_null, literal_map, trim
from .tables import first_by


def _string(v: Column) -> Column:
    """The text of a VARIANT that is a string, else null."""
    return F.when(F.schema_of_variant(v).eqNullSafe("STRING"), F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    """Numbers and strings that are numbers; an empty string is none."""
    kind = F.schema_of_variant(v)
    return F.when(~F.coalesce(kind, F.lit("VOID")).isin("BOOLEAN", "VOID") & ~F.coalesce(kind, F.lit("")).startswith("ARRAY") & ~F.coalesce(kind, F.lit("")).startswith("OBJECT"), F.try_variant_get(v, "$", "string").try_cast("double"))


def coerce(v: Column, kind: str, field: str = "", this_year: int = 2100) -> Column:
    """A profile value of VARIANT type as its field's kind, or null if it doesn't fit."""
    s = trim(_string(v))
    if kind == "text":
        return F.substring(empty_to_null(s), 1, vocab.TEXT_CAPS.get(field, 200))
    if kind == "url":
        return F.when(s.rlike(r"(?i)^https?://\S+$"), F.substring(s, 1, 300))
    if kind in ("year", "int"):
        n = F.when(_number(v) >= 0, F.floor(_number(v))).otherwise(F.ceil(_number(v))).cast("long")
        return F.when(n.between(1800, this_year) if kind == "year" else (n > 0) & (n < 5_000_000), n)
    if kind in ("num", "lat", "lon"):
        n, (low, high) = _number(v), {"num": (0, float("inf")), "lat": (-90, 90), "lon": (-180, 180)}[kind]
        return F.when((n >= low) & (n <= high) & (n < float("inf")), n)
    if kind == "bool":
        return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
    if kind == "ctype":
        low = F.lower(s)
        joined = F.regexp_replace(low, r"[\s-]+", "_")
        return F.when(low.isin(vocab.COMPANY_TYPES), low).when(joined.isin(vocab.COMPANY_TYPES), joined).otherwise(F.try_element_at(literal_map(vocab.COMPANY_TYPE_WORDS), low))
    if kind == "ownership":
        return F.try_element_at(literal_map(vocab.OWNERSHIP_WORDS), F.lower(s))
    if kind == "emp":
        band = F.regexp_replace(_string(v), "[, ]", "")
        return F.when(band.isin(vocab.EMPLOYEE_BANDS), band)
    if kind == "ccy":
        return F.when(F.upper(s).rlike("^[A-Z]{3}$"), F.upper(s))
    if kind == "arr":
        items = F.try_variant_get(v, "$", "array<variant>")
        tidy = F.filter(F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.substring(trim(F.try_variant_get(x, "$", "string")), 1, 80)), lambda x: x != "")
        return F.when(F.size(tidy) > 0, F.slice(F.array_distinct(tidy), 1, 20))
    raise ValueError(kind)


def profiles(replies: DataFrame, key: str = "company_id", json: str = "json", this_year: int = 2100, fields: dict[str, str] = vocab.PROFILE_FIELDS) -> DataFrame:
    """key and the checked fields of each JSON object; a text that isn't one gives nulls."""
    d = replies.select(key, F.try_parse_json(json).alias("_v"))
    return d.select(key, *[coerce(F.try_variant_get("_v", f"$.{f}", "variant"), k, f, this_year).alias(f) for f, k in fields.items()])


def verdict_fields(replies: DataFrame) -> DataFrame:
    """Checked verdicts (kind, name, ok, entity_kind, canonical, country, website, type, category, maker): unknown values are null, products need a category."""
    cut = lambda c, n=120: F.substring(empty_to_null(trim(F.col(c))), 1, n)
    ok = F.coalesce("ok", F.lit(False)) & ((F.col("kind") == "company") | F.coalesce(F.col("category").isin(vocab.PRODUCT_CATEGORIES), F.lit(False)))
    site = cut("website", 200)
    return replies.where(cut("name").isNotNull()).select(
        "kind", F.lower(cut("name")).alias("name_lc"), ok.alias("ok"),
        F.when(F.col("entity_kind").isin(vocab.VERDICT_KINDS), F.col("entity_kind")).otherwise("company").alias("entity_kind"),
        F.coalesce(cut("canonical"), cut("name")).alias("canonical"), cut("country", 60).alias("country"),
        F.when(site.rlike(r"(?i)^https?://\S+\.[a-z]{2,}"), site).alias("website"),
        F.when(F.col("type").isin(vocab.COMPANY_TYPES), F.col("type")).alias("type"),
        F.when(F.col("category").isin(vocab.PRODUCT_CATEGORIES), F.col("category")).alias("category"), cut("maker").alias("maker"),
    )


def score_candidates(candidates: DataFrame, types: list[str] = vocab.ORG_TYPES) -> DataFrame:
    """candidates (company_id, rank, qid, description, site, instance_of, website) with score: 100 for the domain, 15 for an organisation, 4 for a word."""
    mine, theirs = U.host(F.col("website")), U.host(F.col("site"))
    org = F.coalesce(F.arrays_overlap(F.coalesce("instance_of", F.array().cast("array<string>")), F.array(*map(F.lit, types))), F.lit(False))
    word = F.coalesce(F.col("description").rlike(f"(?i){vocab.ORG_WORDS}"), F.lit(False))
    return candidates.withColumn("score", F.when(U.same_domain(mine, theirs), 100).otherwise(0) + F.when(org, 15).otherwise(0) + F.when(word, 4).otherwise(0))


def best_candidate(candidates: DataFrame, least: int = 15, key: str = "company_id") -> DataFrame:
    """The candidate of the highest score for each company, the first of equal ones, if it has at least 15."""
    return first_by(score_candidates(candidates).where(F.col("score") >= least), [key], [F.desc("score"), "rank", "qid"])


def latest(claims: DataFrame, keys: list[str], time: str = "time", pos: str = "pos") -> DataFrame:
    """The claim with the latest time for each key; of equal ones the first, and undated ones last."""
    return first_by(claims, keys, [F.desc_nulls_last(time), pos])


def year_of(time: Column, least: int = 1700, this_year: int = 2100) -> Column:
    """The year of a time such as +2020-01-01T00:00:00Z."""
    y = F.substring(time, 2, 4).try_cast("int")
    return F.when(y.between(least, this_year), y)


def amount(value: Column, unit: Column) -> tuple[Column, Column]:
    """Number and currency of a quantity; an unknown unit gives neither."""
    currency = F.try_element_at(literal_map(vocab.CURRENCIES), F.element_at(F.split(unit, "/"), -1))
    n = F.regexp_replace(value, r"^\+", "").try_cast("double")
    return F.when(currency.isNotNull(), n), F.when(n.isNotNull(), currency)


def facts(claims: DataFrame, this_year: int = 2100) -> DataFrame:
    """qid and catalogue columns from claims (qid, property, pos, value, unit, time): founding, employees, revenue, valuation, website, ticker."""
    last = latest(claims, ["qid", "property"])
    first = first_by(claims, ["qid", "property"], ["pos"])
    pick = lambda p, c: F.max(F.when(F.col("property") == p, c))
    n, ccy = amount(F.col("value"), F.col("unit"))
    employees = F.regexp_replace("value", r"^\+", "").try_cast("double")
    a = last.groupBy("qid").agg(pick("P1128", F.when(employees > 0, F.round(employees).cast("long"))).alias("employee_count"), pick("P1128", F.when(employees > 0, employee_band(employees))).alias("employee_range"), pick("P2139", n).alias("revenue_amount"), pick("P2139", ccy).alias("revenue_currency"), pick("P2139", F.when(n.isNotNull(), year_of(F.col("time"), 0, this_year))).alias("revenue_year"), pick("P2226", n).alias("valuation"), pick("P2226", ccy).alias("valuation_currency"))
    b = first.groupBy("qid").agg(pick("P571", year_of(F.col("value"), 1700, this_year)).alias("founded_year"), pick("P856", F.when(F.col("value").rlike("(?i)^https?://"), F.substring("value", 1, 300))).alias("website"), pick("P249", F.substring(empty_to_null(trim(F.col("value"))), 1, 20)).alias("stock_ticker"))
    return a.join(b, "qid", "full_outer").withColumn("is_public", F.when(F.col("stock_ticker").isNotNull(), F.lit(True)))


def with_labels(ids: DataFrame, labels: DataFrame, column: str, to: str) -> DataFrame:
    return ids.join(labels.select(F.col("id").alias(column), F.col("label").alias(to)), column, "left")


def confidence_counts(rows: DataFrame, by: str = "confidence") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def nth_page(rows: DataFrame, page: int, offset: int) -> DataFrame:
    return rows.orderBy(F.asc_nulls_last("name"), "id").offset(offset).limit(page)

