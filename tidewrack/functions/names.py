"""Keys and similarity of entity names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import empty_to_null


def _folding() -> tuple[str, str]:
    """Letters below U+0250 and in U+1E00-1EFF that decompose to an ASCII letter and marks, with that letter."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base.isascii() and base.isalnum():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folding()


def clean(name: Column) -> Column:
    """Small ASCII letters and digits in words. Accents go; letters that don't decompose (ø, ł, ß) become spaces."""
    t = F.translate(F.lower(F.coalesce(name, F.lit(""))), _FROM, _TO)
    t = F.regexp_replace(F.replace(F.regexp_replace(t, r"[\x{300}-\x{36F}.]", ""), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    return F.trim(t)


def norm_company(name: Column, suffixes: list[str] = vocab.COMPANY_SUFFIXES) -> Column:
    """clean() without company words at the end; one word always stays."""
    return F.regexp_replace(clean(name), r"^(\S+(?: \S+)*?)(?: (?:" + "|".join(suffixes) + r"))+$", "$1")


def norm_key_ok(name: Column, key: Column) -> Column:
    """Whether a key says enough: several words, or a name that was short itself."""
    return F.contains(key, F.lit(" ")) | (F.size(F.split(clean(name), " ")) <= 2)


def norm_product(name: Column) -> Column:
    """clean() without spaces; null if nothing is left, so that such names don't match each other."""
    return empty_to_null(F.replace(clean(name), F.lit(" "), F.lit("")))


def slugify(name: Column) -> Column:
    return F.coalesce(empty_to_null(F.substring(F.replace(clean(name), F.lit(" "), F.lit("-")), 1, 80)), F.lit("x"))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the letter pairs, which count as often as they come."""
    pairs = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    ga, gb = pairs(a), pairs(b)
    count = lambda g, x: F.size(F.filter(g, lambda y: y == x))
    hits = F.aggregate(F.array_distinct(ga), F.lit(0), lambda n, x: n + F.least(count(ga, x), count(gb, x)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * hits / (F.length(a) + F.length(b) - 2))
