"""URL filters: a blocked Bloom filter of listed URLs passes possible hits to an exact hash join.

Rules are (host, path) keys with a verdict. A rule fits its host and all
subdomains where the url's path starts with the rule's path; the longest rule
wins, of equally long ones that with the longer host. Candidate keys of a url
are its host suffixes times its path prefixes. They are probed in place
against the filter, an array of 64-bit blocks made once as a scalar subquery,
so urls without a possible hit are never exploded or shuffled. No key has more
labels or slashes than the rules have, so a very long url has no more keys than
others. The exact join then removes false positives.

Defined results: a null url, or one without "://", has empty host and path,
fits no rule and gets the default verdict. Repeated pages, and those with a null
or repeated id, give a row each.
Rules with a null host, path or verdict are ignored; of repeated rules the
least verdict counts, so "allow" wins over "block". An empty rule list or page
table works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
PROBES = 4


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, with A-Z lower-cased."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains, longest first, of at most as many labels as a rule has."""
    labels = F.slice(F.reverse(F.split(host, r"\.")), 1, most)
    return F.transform(F.reverse(F.sequence(F.lit(1), F.size(labels))), lambda n: F.array_join(F.reverse(F.slice(labels, F.lit(1), n)), "."))


def _prefixes(path: Column, slashes: int, lengths: list[int]) -> Column:
    """Prefixes that end with a slash, of at most as many slashes as a rule has, the empty one, and those of the other lengths that rules have."""
    parts = F.split(path, "/", slashes + 1)
    slashed = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    other = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.array_distinct(F.array_compact(F.concat(slashed, F.array(F.lit(""), *other))))


def _mask(h: Column) -> Column:
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, s).bitwiseAND(F.lit(BITS - 1)).cast("int"))
    out = bit(0)
    for k in range(1, PROBES):
        out = out.bitwiseOR(bit(6 * k))
    return out


def _block(h: Column, n_blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(n_blocks)).cast("int")


def bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """One row with the filter: n_blocks 64-bit words, of which each key sets PROBES bits of one."""
    h = F.xxhash64("key")
    set_ = keys.groupBy(_block(h, n_blocks).alias("b")).agg(F.bit_or(_mask(h)).alias("m"))
    every = keys.sparkSession.range(n_blocks).select(F.col("id").cast("int").alias("b"))
    full = every.join(set_, "b", "left").select("b", F.coalesce("m", F.lit(0).cast("bigint")).alias("m"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda x: x["m"]).alias("filter"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", bits_per_rule: int = 24, max_blocks: int = 1 << 18, broadcast_rules: int = 50_000) -> DataFrame:
    """Judge every row of pages. rules: host, path, verdict. Returns page_id, host, path, rule, verdict.

    The filter never has more than max_blocks words (2 MiB at the default); a
    longer list only lets more keys through to the exact join. The rules are
    broadcast up to broadcast_rules of them, counted first, and shuffled beyond.
    """
    keyed = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    keyed = keyed.groupBy(F.concat("host", F.lit("\n"), "path").alias("key")).agg(F.min("verdict").alias("verdict"), F.first("host").alias("_rh"), F.first("path").alias("_rp"))
    ends = F.col("path").endswith("/") | (F.col("path") == "")
    longest = keyed.agg(F.count("*"), F.max(F.size(F.split("_rh", r"\."))), F.max(F.size(F.split("_rp", "/")) - 1)).first()
    n_rules, labels, slashes = longest[0], longest[1] or 1, longest[2] or 0
    lengths = sorted(r[0] for r in rules.where(~ends).select(F.length("path")).distinct().collect())
    n_blocks = 1
    while n_blocks < max_blocks and n_blocks * BITS < n_rules * bits_per_rule:
        n_blocks *= 2
    p = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    keys = F.flatten(F.transform(_suffixes(F.col("host"), labels), lambda s: F.transform(_prefixes(F.col("path"), slashes, lengths), lambda q: F.concat(s, F.lit("\n"), q))))
    p = p.withColumn("_filter", bloom(keyed, n_blocks).scalar()).withColumn("_keys", keys)
    maybe = F.filter("_keys", lambda k: F.get(F.col("_filter"), _block(F.xxhash64(k), n_blocks)).bitwiseAND(_mask(F.xxhash64(k))) == _mask(F.xxhash64(k)))
    p = p.select("page_id", "host", "path", maybe.alias("_maybe"))
    none = F.lit(None).cast("string")
    missed = p.where(F.size("_maybe") == 0).select("page_id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    hit = p.where(F.size("_maybe") > 0).select("page_id", "host", "path", F.posexplode("_maybe").alias("_at", "key"))
    listed = F.broadcast(keyed) if n_rules <= broadcast_rules else keyed
    hit = hit.join(listed, "key", "left")
    name = F.concat("_rh", "_rp")
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length(name).alias("n"), F.length("_rh").alias("m"), name.alias("rule"), F.col("verdict").alias("verdict"))))
    hit = hit.groupBy("page_id", "host", "path").agg(best.alias("_b"), F.count_if(F.col("_at") == 0).cast("int").alias("_n"))
    hit = hit.select("page_id", "host", "path", F.col("_b")["rule"].alias("rule"), F.coalesce(F.col("_b")["verdict"], F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_copy"))
    return missed.unionByName(hit.drop("_copy"))
