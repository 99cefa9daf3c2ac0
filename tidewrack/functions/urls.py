"""URL functions: canonical form, hash, host, and what looks like an article."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import empty_to_null, let, trim

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:@]+)(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column, dropped: list[str] = vocab.TRACKING) -> Column:
    """Without fragment, www., default port, end slashes and tracking parameters, with a small host and sorted parameters.

    The scheme stays, so http and https differ. What can't be parsed is only trimmed. Parameters are sorted by name, equal ones keep their order.
    """
    parts = lambda raw: F.array(*[F.regexp_extract(raw, f"(?s){_URL}", k) for k in range(1, 6)])
    return let(trim(url), lambda raw: let(parts(raw), lambda p: F.when(p[0] == "", raw).otherwise(_joined(p, dropped))))


def _joined(p: Column, dropped: list[str]) -> Column:
    """A canonical url of its scheme, host, port, path and query."""
    scheme, port = F.lower(p[0]), p[2]
    host = F.regexp_replace(F.lower(p[1]), r"^www\.", "")
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = let(F.regexp_replace(p[3], "/+$", ""), lambda x: F.coalesce(empty_to_null(x), F.lit("/")))
    text = lambda s: F.coalesce(F.try_url_decode(s), s)
    pairs = F.transform(F.filter(F.split(p[4], "&"), lambda q: q != ""), lambda q, i: F.struct(text(F.substring_index(q, "=", 1)).alias("k"), i.alias("i"), F.when(F.contains(q, F.lit("=")), text(F.regexp_replace(q, "^[^=]*=", ""))).otherwise(F.lit("")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda x: ~F.lower(x["k"]).rlike("^(" + "|".join(dropped) + ")")))
    search = F.array_join(F.transform(kept, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")
    begin = F.concat(scheme, F.lit("://"), host, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path)
    return F.concat(begin, let(search, lambda x: F.when(x == "", F.lit("")).otherwise(F.concat(F.lit("?"), x))))


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def host(url: Column) -> Column:
    """Small host without www., or null."""
    return empty_to_null(F.regexp_replace(F.lower(F.regexp_extract(trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), r"^www\.", ""))


def same_domain(a: Column, b: Column) -> Column:
    """Equal hosts, or one under the other."""
    return F.coalesce((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)), F.lit(False))


def origin(url: Column) -> Column:
    return empty_to_null(F.lower(F.regexp_extract(trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)))


def looks_like_article(url: Column, website: Column) -> Column:
    """On the website's own origin, with a path that is no listing or file and ends in words."""
    path = F.coalesce(empty_to_null(F.regexp_extract(trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)), F.lit("/"))
    last = F.regexp_extract(path, "([^/]*)/*$", 1)
    # Parts of a path that mark listings, and endings of files.
    listing = r"(?i)/(category|tag|tags|author|page|topics?|section|feed|wp-|search)\b"
    media = r"(?i)\.(jpg|jpeg|png|webp|gif|pdf|xml)$"
    ok = (origin(url) == origin(website)) & (F.length(path) >= 6) & ~path.rlike(listing) & ~path.rlike(media) & last.rlike("(?i)[a-z]{4}")
    return F.coalesce(ok, F.lit(False))
