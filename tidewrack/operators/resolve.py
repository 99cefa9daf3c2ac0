"""Entity resolution: free-text mentions to a catalogue, by stages of joins of which the first that matches counts.

Every stage is a join by equality that its rule implies, so no mention meets the
whole catalogue: by a name, by a normal form, by a shorter key that is a prefix
of a longer one's words, or by rare pairs of letters under one first word. The
stages' matches are ranked together in one window, so none waits for another
and nothing is worked out twice. Ties go to the earlier catalogue entry (ord).
"""

from __future__ import annotations

import json
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions import vocab
from ..functions.classify import is_blocklisted
from .tables import first_by, insert_ignore

FUZZY = 0.9
#: Keys of a first word and a size that are so few are compared with each similar one; more meet by subsets of their letter pairs, each key by at most so many or one more than it may lack.
FEW, SUBSETS = 16, 36


def _words(c: Column) -> Column:
    return F.split(c, " ")


def company_keys(companies: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exact: lo, id) and (normed: key, id, name, part, ord), from companies (ord, id, name) and aliases (ord, company_id, alias).

    "Outer (Inner)" also stands under Outer, and under Inner unless that is a name or alias of its own.
    """
    named = companies.select("id", "name", F.lit(0).alias("part"), "ord").unionByName(aliases.select(F.col("company_id").alias("id"), F.col("alias").alias("name"), F.lit(1).alias("part"), "ord"))
    named = named.where("name IS NOT NULL")
    exact = first_by(named.withColumn("lo", F.lower("name")), ["lo"], ["part", "ord", "id"]).select("lo", "id")
    pattern = r"^([^(]{2,}?)\s*\(([^)]+)\)"
    split = companies.where(F.col("name").rlike(pattern)).select("id", "ord", F.regexp_extract("name", pattern, 1).alias("outer"), F.regexp_extract("name", pattern, 2).alias("inner"))
    outer = split.select("id", F.trim("outer").alias("name"), F.lit(2).alias("part"), "ord")
    inner = split.withColumn("lo", F.lower(F.trim("inner"))).join(exact.select("lo"), "lo", "left_anti").select("id", F.trim("inner").alias("name"), F.lit(3).alias("part"), "ord")
    normed = named.unionByName(outer).unionByName(inner).withColumn("key", N.norm_company(F.col("name")))
    return exact, normed.where((F.col("key") != "") & N.norm_key_ok(F.col("name"), F.col("key")))


def prefix_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """key and k of all pairs of keys where one is the other's first words, two words or more, or equals it. left: key, right: k.

    Each key stands under its own prefixes, and meets the keys that are one of them.
    """
    many = lambda c: F.contains(F.col(c), F.lit(" "))
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(2), F.size(_words(F.col(c)))), lambda n: F.array_join(F.slice(_words(F.col(c)), 1, n), " "))).alias("_p")
    a, b = left.select("key").distinct().where(many("key")), right.select("k").distinct().where(many("k"))
    longer = a.select("key", prefixes("key")).join(b, F.col("_p") == F.col("k")).select("key", "k")
    shorter = b.select("k", prefixes("k")).where("_p <> k").join(a, F.col("_p") == F.col("key")).select("key", "k")
    return longer.unionByName(shorter)


def _ordered_pairs(keys: DataFrame, c: str, frequency: DataFrame) -> DataFrame:
    """For each key of two letters and more: its number of letter pairs, and those, rarest first.

    Pairs that come again are told apart by their number, so that sets of them count as letter pairs do.
    """
    pair = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2)))
    d = keys.select(c).distinct().where(F.length(c) >= 2).select(c, pair.alias("_g"))
    numbered = F.transform(F.col("_g"), lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(F.col("_g"), F.lit(1), i + 1), lambda x: x == g)).alias("nth")))
    rows = d.select(c, F.size("_g").alias("_n"), F.explode(numbered).alias("_x")).select(c, "_n", "_x.g", "_x.nth")
    # Keys have 37 different characters, so there are 1,369 pairs at most.
    rows = rows.join(F.broadcast(frequency), "g", "left")
    return rows.groupBy(c, "_n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g", "nth"))).alias("_o"))


def _letter_pairs(keys: DataFrame, c: str, frequency: DataFrame, least: float) -> DataFrame:
    """For each key its first word, its number of letter pairs, and those of its pairs, rarest first, of which a similar key has one at least, with their places."""
    share = least / (2 - least)
    first = F.col("_n") - F.ceil(F.col("_n") * share - 1e-9).cast("int") + 1
    return _ordered_pairs(keys, c, frequency).select(c, "_n", F.posexplode(F.slice("_o", F.lit(1), first)).alias("_at", "_x")).select(c, _words(F.col(c))[0].alias("_w"), "_n", "_at", "_x.g", "_x.nth")


def _depths() -> list[int]:
    """By the number of letter pairs that a key may lack, how many common ones two keys meet by; 1 beyond the list."""
    deep = lambda lacking: max([1, *(c for c in range(1, SUBSETS) if comb(lacking + c, c) <= SUBSETS)])
    out = []
    while not out or out[-1] > 1:
        out.append(deep(len(out)))
    return out


def _meetings(lists: DataFrame, lacking: Column) -> DataFrame:
    """_met: for each subset of _c letter pairs among the key's lacking + _c rarest, a number of it. One for a _c of 0."""
    left_out = {f"{k} {c}": [list(x) for x in combinations(range(k + c), k)] for k in range(1, len(_depths())) for c in range(2, SUBSETS) if comb(k + c, c) <= SUBSETS}
    table = F.from_json(F.lit(json.dumps(left_out)), "map<string,array<array<int>>>")
    head = F.transform(F.slice("_o", F.lit(1), lacking + F.col("_c")), lambda x: F.concat(x["g"], x["nth"].cast("string")))
    d = lists.withColumn("_head", head).withColumn("_without", F.try_element_at(table, F.concat_ws(" ", lacking.cast("string"), F.col("_c").cast("string"))))
    some = F.transform("_without", lambda out: F.xxhash64(F.filter("_head", lambda x, i: ~F.array_contains(out, i))))
    met = F.when(F.col("_c") == 0, F.array(F.lit(0).cast("bigint"))).when(lacking == 0, F.array(F.xxhash64("_head"))).when(F.col("_c") == 1, F.transform("_head", lambda x: F.xxhash64(F.array(x)))).otherwise(some)
    return d.withColumn("_met", F.explode(met)).drop("_o", "_head", "_without")


def _met_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """key and k of the pairs of different keys that fuzzy_pairs() verifies, once for each subset they meet by.

    Two keys of n and m letter pairs whose Dice coefficient is least share
    least / 2 * (n + m) of them. So the c rarest that they share are among the
    rarest c + n - shared of one and c + m - shared of the other, and for each n
    and m under a first word keys meet by subsets of c of those. c is as large as
    few subsets allow, often all that must be shared: numbered names under one
    word then meet hardly any but those that are similar, however many there are.
    """
    gram = F.transform(F.sequence(F.lit(1), F.length("k") - 1), lambda i: F.substring(F.col("k"), i, F.lit(2)))
    frequency = right.select("k").distinct().where(F.length("k") >= 2).select(F.explode(gram).alias("g")).groupBy("g").agg(F.count("*").alias("often"))
    a = _ordered_pairs(left, "key", frequency).withColumn("_w", _words(F.col("key"))[0])
    b = _ordered_pairs(right, "k", frequency).withColumnRenamed("_n", "_m").withColumn("_w", _words(F.col("k"))[0])
    # From the keys alone: which sizes meet under a first word, and by how many letter pairs.
    size = lambda keys, c, n: keys.select(c).distinct().where(F.length(c) >= 2).groupBy(_words(F.col(c))[0].alias("_w"), (F.length(c) - 1).alias(n))
    need = F.ceil(least / 2 * (F.col("_n") + F.col("_m")) - 1e-9).cast("int")
    lacking = F.greatest("_n", "_m") - need
    depth = F.when(F.col("_many") <= FEW, 0).when(lacking == 0, need).otherwise(F.least(need, F.coalesce(F.get(F.array(*map(F.lit, _depths())), lacking), F.lit(1))))
    sizes = size(left, "key", "_n").agg(F.count("*")).select("_w", "_n").join(size(right, "k", "_m").agg(F.count("*").alias("_many")), "_w").where(need <= F.least("_n", "_m")).select("_w", "_n", "_m", depth.alias("_c"))
    met = _meetings(a.join(sizes, ["_w", "_n"]), F.col("_n") - need).join(_meetings(b.join(sizes, ["_w", "_m"]), F.col("_m") - need), ["_w", "_n", "_m", "_met"])
    return met.where("key <> k").select("key", "k")


def fuzzy_pairs(left: DataFrame, right: DataFrame, least: float = FUZZY) -> DataFrame:
    """key, k and d of all pairs of keys with one first word whose Dice coefficient d of letter pairs is at least so much. left: key, right: k."""
    verified = _met_pairs(left, right, least).distinct().withColumn("d", N.dice(F.col("key"), F.col("k"))).where(F.col("d") >= least)
    same = left.select("key").distinct().join(right.select("k").distinct(), F.col("key") == F.col("k")).select("key", "k", F.lit(1.0).alias("d"))
    return verified.unionByName(same)


def match_companies(tags: DataFrame, exact: DataFrame, normed: DataFrame) -> DataFrame:
    """lo, id, reason for the tags (lo, tag) that match: exact, normalized, prefix or fuzzy:<score>."""
    t = tags.groupBy("lo").agg(F.min("tag").alias("tag")).withColumn("key", N.norm_company(F.col("tag")))
    row = lambda stage, score, reason: ("lo", "id", F.lit(stage).alias("stage"), score.cast("double").alias("score"), "part", "ord", reason.alias("reason"))
    s1 = t.join(exact, "lo").withColumns({"part": F.lit(0), "ord": F.lit(0)}).select(*row(1, F.lit(0), F.lit("exact")))
    same = t.where(N.norm_key_ok(F.col("tag"), F.col("key"))).join(normed, "key").withColumn("d", N.dice(F.col("lo"), F.lower("name")))
    s2 = same.select(*row(2, F.col("d"), F.lit("normalized")))

    heads = first_by(normed, ["key"], ["part", "ord", "id"]).select(F.col("key").alias("k"), "id", "part", "ord")
    s3 = t.join(prefix_pairs(t, heads), "key").join(heads, "k").select(*row(3, F.length("k"), F.lit("prefix")))
    close = t.join(fuzzy_pairs(t, heads), "key").join(heads, "k")
    s4 = close.select(*row(4, F.col("d"), F.concat(F.lit("fuzzy:"), F.format_string("%.2f", "d"))))
    every = s1.unionByName(s2).unionByName(s3).unionByName(s4)
    return first_by(every, ["lo"], ["stage", F.desc("score"), "part", "ord", "id"]).select("lo", "id", "reason")


def match_products(tags: DataFrame, products: DataFrame) -> DataFrame:
    """lo, id, reason by name, then by name without spaces and signs. products: ord, id, name."""
    t = tags.groupBy("lo").agg(F.min("tag").alias("tag")).withColumn("key", N.norm_product(F.col("tag")))
    row = lambda stage, reason: ("lo", "id", F.lit(stage).alias("stage"), "ord", F.lit(reason).alias("reason"))
    exact = t.join(products.withColumn("lo", F.lower("name")), "lo").select(*row(1, "exact"))
    keys = products.withColumn("key", N.norm_product(F.col("name"))).where("key IS NOT NULL")
    return first_by(exact.unionByName(t.join(keys, "key").select(*row(2, "normalized"))), ["lo"], ["stage", "ord", "id"]).select("lo", "id", "reason")


def mentions(articles: DataFrame, kind: str) -> DataFrame:
    """article_id, art_ord, tag_ord, tag, lo: what the articles (id, companies, products, ord, title, url) mention. Blank tags are none."""
    column = {"company": "companies", "product": "products"}[kind]
    d = articles.select(F.col("id").alias("article_id"), F.col("ord").alias("art_ord"), "title", "url", F.posexplode(column).alias("tag_ord", "raw"))
    return d.withColumn("tag", F.trim("raw")).where(F.coalesce(F.col("tag"), F.lit("")) != "").withColumn("lo", F.lower("tag")).drop("raw")


def heal_cache(cache: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cache rows that hold, and those whose entity has gone. entities: kind, id."""
    live = entities.select("kind", F.col("id").alias("entity_id")).distinct()
    gone = cache.where("decision <> 'rejected'").join(live, ["kind", "entity_id"], "left_anti").select(*cache.columns)
    return cache.join(gone.select("kind", "tag"), ["kind", "tag"], "left_anti").select(*cache.columns), gone


def decide(found: DataFrame, cache: DataFrame, matches: DataFrame, kind: str) -> DataFrame:
    """lo, tag, decision, entity_id, reason, source: by cache, match or blocklist, else unknown. One row for each lo, as first seen."""
    tags = first_by(found, ["lo"], ["art_ord", "tag_ord"]).select("lo", "tag")
    c = first_by(cache.where(F.col("kind") == kind).withColumn("lo", F.lower("tag")), ["lo"], ["tag"]).select("lo", F.col("decision").alias("c_d"), F.col("entity_id").alias("c_e"), F.col("reason").alias("c_r"))
    d = tags.join(c, "lo", "left").join(matches.select("lo", F.col("id").alias("m_e"), F.col("reason").alias("m_r")), "lo", "left")
    cached, matched = F.col("c_d").isNotNull(), F.col("m_e").isNotNull()
    blocked = is_blocklisted(F.col("tag")) if kind == "company" else F.lit(False)
    pick = lambda a, b, x, y: F.when(cached, a).when(matched, b).when(blocked, x).otherwise(y)
    null = F.lit(None).cast("string")
    return d.select("lo", "tag", pick(F.col("c_d"), F.lit("matched"), F.lit("rejected"), F.lit("unknown")).alias("decision"), pick(F.col("c_e"), F.col("m_e"), null, null).alias("entity_id"), pick(F.col("c_r"), F.col("m_r"), F.lit("blocklist"), null).alias("reason"), pick(F.lit("cache"), F.lit("matched"), F.lit("blocked"), F.lit("unknown")).alias("source"))


def first_values(rows: DataFrame, key: str, value: str, order: list, most: int) -> DataFrame:
    """key and an array of its first values in order, nulls left out. Each task keeps at most so many rows of a key, before and after the shuffle, so no key is ever collected whole."""
    ranked = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"), F.row_number().over(Window.partitionBy(key).orderBy(*order, value)).alias("_r")).where(F.col("_r") <= most)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias(value))


def gate_input(found: DataFrame, decisions: DataFrame, most: int = 40, titles: int = 2, urls: int = 3) -> DataFrame:
    """Unknown names for vetting, in the order first seen: lo, tag, seen_in, urls, at."""
    unknown = found.join(decisions.where("source = 'unknown'").select("lo"), "lo", "left_semi")
    at = F.struct("art_ord", "tag_ord")
    names = unknown.groupBy("lo").agg(F.min_by("tag", at).alias("tag"), F.min(at).alias("at")).orderBy("at", "lo").limit(most)
    mine = unknown.join(names.select("lo"), "lo", "left_semi")
    none = F.array().cast("array<string>")
    seen = first_values(mine, "lo", "title", ["art_ord", "tag_ord"], titles).withColumnRenamed("title", "seen_in")
    where = first_values(mine, "lo", "url", ["art_ord", "tag_ord"], urls).withColumnRenamed("url", "urls")
    out = names.join(seen, "lo", "left").join(where, "lo", "left").select("lo", "tag", F.coalesce("seen_in", none).alias("seen_in"), F.coalesce("urls", none).alias("urls"), "at")
    return out.orderBy("at", "lo")


def unique_slugs(rows: DataFrame, taken: DataFrame, name: str = "name", order: list[str] | None = None) -> DataFrame:
    """rows with a slug each: the base, or base-2, base-3 and so on where it is taken. taken: slug.

    The first row of a base gets it unless it is taken. The others get the free
    numbers from 2 on in order; a number is not free if the slug with it is
    taken or some row's base. Slugs with numbers can't meet those of another
    base, so one window by base does, whatever is taken, and no row is left out.
    Equal rows get a slug each.
    """
    order = order or [name]
    based = rows.withColumn("_base", N.slugify(F.col(name))).withColumn("_id", F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    place = based.withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy(*order, "_id")))
    held = taken.select(F.col("slug")).where("slug IS NOT NULL").distinct()
    # Whether a base itself is taken shifts all its rows by one.
    place = place.join(held.select(F.col("slug").alias("_base"), F.lit(1).alias("_held")), "_base", "left").withColumn("_i", F.col("_n") - 1 + F.coalesce("_held", F.lit(0)))
    used = held.unionByName(place.select(F.col("_base").alias("slug"))).distinct()
    numbered = used.select(F.regexp_extract("slug", "^(.*)-([2-9]|[1-9][0-9]{1,8})$", 1).alias("_base"), F.regexp_extract("slug", "^(.*)-([2-9]|[1-9][0-9]{1,8})$", 2).alias("_k")).where("_k <> ''")
    # The j-th number that isn't free, k, stands behind k - 1 - j free ones.
    blocked = numbered.select("_base", F.col("_k").cast("int").alias("_k")).withColumn("_j", F.row_number().over(Window.partitionBy("_base").orderBy("_k")))
    events = place.select(*rows.columns, "_base", "_i", F.col("_i").alias("_at"), F.lit(0).alias("_blocked"))
    events = events.unionByName(blocked.select("_base", (F.col("_k") - 1 - F.col("_j")).alias("_at"), F.lit(1).alias("_blocked")), allowMissingColumns=True)
    before = F.coalesce(F.sum("_blocked").over(Window.partitionBy("_base").orderBy("_at", "_blocked").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done = events.withColumn("_before", before).where("_blocked = 0")
    slug = F.when(F.col("_i") == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), (F.col("_i") + 1 + F.col("_before")).cast("string")))
    return done.select(*rows.columns, slug.alias("slug"))


def apply_verdicts(queue: DataFrame, verdicts: DataFrame, canonical_matches: DataFrame) -> DataFrame:
    """What becomes of vetted names: lo, tag, outcome, entity_id, reason, and the verdict's columns.

    outcome is undecided (no verdict, so nothing is cached), rejected, side
    (another kind of body, for a table of its own), matched (the canonical name
    is in the catalogue) or created. canonical_matches: name_lc, id, reason.
    """
    more = [c for c in ("category", "maker") if c in verdicts.columns]
    v = verdicts.select(F.col("name_lc").alias("lo"), "ok", "entity_kind", "canonical", "country", "website", "type", *more)
    m = canonical_matches.select(F.col("name_lc").alias("lo"), F.col("id").alias("m_e"), F.col("reason").alias("m_r"))
    d = queue.join(v, "lo", "left").join(m, "lo", "left")
    outcome = F.when(F.col("ok").isNull(), "undecided").when(~F.col("ok"), "rejected").when(F.coalesce("entity_kind", F.lit("company")) != "company", "side").when(F.col("m_e").isNotNull(), "matched").otherwise("created")
    reason = F.when(outcome == "rejected", "verdict:rejected").when(outcome == "side", F.concat(F.lit("verdict:"), F.col("entity_kind"))).when(outcome == "matched", F.concat(F.lit("verdict-canonical:"), F.col("m_r"))).when(outcome == "created", "verdict:created")
    return d.select("lo", "tag", "urls", "at", outcome.alias("outcome"), F.when(outcome == "matched", F.col("m_e")).when(outcome == "created", entity_id(F.col("canonical"))).alias("entity_id"), reason.alias("reason"), "entity_kind", "canonical", "country", "website", "type", *more)


def entity_id(canonical: Column) -> Column:
    """Ids of new entities follow from their names, so a repeated run makes no others."""
    return F.sha2(F.lower(canonical), 256)


def new_companies(outcomes: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to create, one for each canonical name (the first name's attributes count), with slugs; and their aliases."""
    made = outcomes.where("outcome = 'created'").withColumn("canon", F.lower("canonical"))
    rows = first_by(made, ["canon"], ["at", "lo"]).select(F.col("entity_id").alias("id"), F.col("canonical").alias("name"), F.col("country").alias("hq_country"), "website", F.col("type").alias("company_type"), F.lit("live").alias("publication_status"), F.lit("low").alias("confidence"), F.col("urls").alias("source_urls"), "at")
    aliases = made.where("canon <> lo").select(F.col("entity_id").alias("company_id"), F.col("tag").alias("alias")).distinct()
    return unique_slugs(rows, taken, "name", ["at"]).drop("at"), aliases


def new_products(outcomes: DataFrame, taken: DataFrame, exact: DataFrame, normed: DataFrame, made: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Products to create, one for each canonical name, with slugs; and product_id, company_id, role of their makers.

    outcomes: as of apply_verdicts(), with category and maker too. A category that
    isn't known counts as none. made: companies (id, name) created just before;
    a maker of such a name is that company, else makers match the catalogue.
    """
    d = outcomes.where("outcome = 'created'").withColumn("canon", F.lower("canonical"))
    rows = first_by(d, ["canon"], ["at", "lo"])
    category = F.when(F.col("category").isin(*vocab.PRODUCT_CATEGORIES), F.col("category"))
    products = rows.select(F.col("entity_id").alias("id"), F.col("canonical").alias("name"), category.alias("category"), F.lit("live").alias("publication_status"), F.lit("low").alias("confidence"), F.col("urls").alias("source_urls"), F.col("maker"), "at")
    wanted = products.select("id", "maker")
    if made is None:
        return unique_slugs(products, taken, "name", ["at"]).drop("at", "maker"), maker_links(wanted, exact, normed)
    fresh = first_by(made.select(F.lower("name").alias("lo"), F.col("id").alias("company_id")), ["lo"], ["company_id"])
    direct = wanted.withColumn("lo", F.lower(F.trim("maker"))).join(fresh, "lo").select(F.col("id").alias("product_id"), "company_id", F.lit("manufacturer").alias("role"))
    rest = wanted.join(direct.select(F.col("product_id").alias("id")), "id", "left_anti")
    return unique_slugs(products, taken, "name", ["at"]).drop("at", "maker"), direct.unionByName(maker_links(rest, exact, normed))


def outcome_counts(decisions: DataFrame) -> DataFrame:
    """source, decision, n: how names were decided, for a run's report."""
    return decisions.groupBy("source", "decision").agg(F.count("*").alias("n"))


def side_rows(outcomes: DataFrame, kind: str) -> DataFrame:
    """Rows for the table of investors or institutions, the first for each slug."""
    d = outcomes.where((F.col("outcome") == "side") & (F.col("entity_kind") == kind)).withColumn("slug", N.slugify(F.col("canonical")))
    return first_by(d, ["slug"], ["at", "lo"]).select("slug", F.col("canonical").alias("name"), F.col("country").alias("hq_country"), "website", F.col("urls").alias("source_urls"))


def links(found: DataFrame, decisions: DataFrame, old: DataFrame | None = None, name: str = "company_id") -> DataFrame:
    """article_id and entity for every decided mention, once each, besides those there are."""
    new = found.join(decisions.where("entity_id IS NOT NULL").select("lo", F.col("entity_id").alias(name)), "lo").select("article_id", name).distinct()
    return insert_ignore(old, new, ["article_id", name]) if old is not None else new


def maker_links(products: DataFrame, exact: DataFrame, normed: DataFrame, role: str = "manufacturer") -> DataFrame:
    """product_id, company_id, role for products (id, maker) whose maker matches."""
    makers = products.where("maker IS NOT NULL").select(F.lower("maker").alias("lo"), F.col("maker").alias("tag"), "id")
    m = match_companies(makers, exact, normed).select("lo", F.col("id").alias("company_id"))
    return makers.join(m, "lo").select(F.col("id").alias("product_id"), "company_id", F.lit(role).alias("role")).distinct()


def complete_articles(articles: DataFrame, found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ids of articles whose mentions all have a decision; without mentions too."""
    d = decisions.select("lo", (F.col("decision") != "unknown").alias("decided"))
    per = found.join(d, "lo", "left").groupBy("article_id").agg(F.bool_and(F.coalesce("decided", F.lit(False))).alias("all"))
    return articles.select(F.col("id").alias("article_id")).join(per.where("NOT all"), "article_id", "left_anti")
