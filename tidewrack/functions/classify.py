"""Keyword gate, theme tags and bands."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import WS, let, literal_map, trim


def norm(text: Column) -> Column:
    """Small letters, single spaces, and one on either side."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"{WS}+", " "), F.lit(" "))


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether a term is anywhere in the text, inside words too."""
    return reduce(or_, [F.contains(text, F.lit(t)) for t in terms], F.lit(False))


def is_relevant(text: Column, specialist: Column, terms: list[str] = vocab.GATE_TERMS) -> Column:
    return F.coalesce(specialist, F.lit(False)) | let(norm(text), lambda t: any_term(t, terms))


def tag_item(text: Column, categories: Column, scope: Column, country: Column, themes: dict[str, list[str]] = vocab.THEMES, most: int = 12) -> Column:
    """Themes in their order, up to four categories as slugs, and the region of a regional source; at most 12 tags."""
    found = let(norm(text), lambda t: F.array_compact(F.array(*[F.when(any_term(t, words), F.lit(name)) for name, words in themes.items()])))
    slug = lambda c: F.regexp_replace(F.regexp_replace(trim(F.lower(c)), f"{WS}+", "-"), "[^a-z0-9-]", "")
    cats = F.transform(F.slice(F.coalesce(categories, F.array().cast("array<string>")), 1, 4), slug)
    cats = F.filter(cats, lambda c: (c != "") & (F.length(c) <= 30))
    region = F.when((scope == "regional") & country.isNotNull(), F.array(F.concat(F.lit("region-"), slug(F.substring_index(country, "/", 1))))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(found, cats, region)), 1, most)


def primary_theme(tags: Column, order: list[str] | None = None) -> Column:
    """The first theme, in the given order, among the tags; else other."""
    order = order or [t for t in vocab.THEME_LABELS if t != "other"]
    first = lambda x: F.try_element_at(F.filter(F.array(*map(F.lit, order)), lambda t: F.array_contains(x, t)), F.lit(1))
    return F.coalesce(let(F.coalesce(tags, F.array().cast("array<string>")), first), F.lit("other"))


def theme_label(theme: Column, labels: dict[str, str] = vocab.THEME_LABELS) -> Column:
    return F.coalesce(F.try_element_at(literal_map(labels), theme), theme)


def employee_band(n: Column) -> Column:
    out = None
    for top, band in zip((10, 50, 200, 500, 1000, 5000, 10000), vocab.EMPLOYEE_BANDS, strict=False):
        out = F.when(n <= top, band) if out is None else out.when(n <= top, band)
    return out.when(n.isNotNull(), vocab.EMPLOYEE_BANDS[-1])


def is_blocklisted(name: Column, words: list[str] = vocab.BLOCKLIST) -> Column:
    return F.coalesce(name.rlike(r"(?i)\b(" + "|".join(words) + r")\b"), F.lit(False))
