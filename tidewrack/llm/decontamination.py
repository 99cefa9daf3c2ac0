"""Benchmark decontamination: one Aho-Corasick automaton over the texts of all benchmark items.

Texts are normalised byte by byte: A-Z become a-z, every ASCII byte that isn't
a letter or digit becomes a space, and words are joined by one space. A window
is ten consecutive words of an item, or the whole item if it has fewer. Any ten
consecutive words of an item hold five that begin at a multiple of five, so the
automaton has each item's blocks of five words once, with a space on either
side, and not each of its windows: its size follows the benchmark's text. It
reads each normalised document once. Where a block occurs, the words around it
are compared with the item's, as far as they agree; ten or more are windows. A
block that many items share, as "which of the following is", isn't compared with
each: the windows around it, in all its places, are sorted by their words when
it is first met, and the document's windows around it are searched there. So a
hit costs a few searches, and items are named once for each different window.
Only documents with hits have their words' places in the original text worked
out.

Memory: a shard of at most shard_bytes of benchmark text is broadcast, and a
worker keeps one automaton, of about 50 bytes a byte, and of 24 bytes more for
each place of a shared block that it met. A larger benchmark is
read in several shards, one pass over the documents for each, that gives rows
for documents with hits only; nothing is dropped, and one shard at a time is on
the driver. A shard's items are chosen by hash, for half of that on average.

Defined results: a null text has no words and no hits; very long texts are read
whole, in time that follows their length. Items with a null id, or without
words, match nothing; without items, or documents, nothing is found. Items with
one text all count. Repeated documents, and those with a null or repeated id,
give a row each.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import id_field, pieces
from .shared import stored

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TO = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MATCHERS: dict[str, Matcher] = {}
#: Blocks with more places have the windows around them sorted.
FEW = 16


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO).split()


class Matcher:
    """An automaton over the items' blocks, with what it takes to tell whether a window is around one."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        import ahocorasick

        self.width, self.block = width, (width + 1) // 2
        self.names: list[str] = []
        self.texts: list[array] = []
        self.words: dict[bytes, int] = {}
        self.blocks = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        sizes, places, whole = [], [], {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            item = len(self.names)
            self.names.append(name)
            self.texts.append(array("I", [self.words.setdefault(w, len(self.words)) for w in words]))
            n = self.block if len(words) >= width else len(words)
            for at in range(0, len(words) - n + 1, n):
                key = f" {b' '.join(words[at : at + n]).decode('latin-1')} "
                k = self.blocks.get(key, -1)
                if k < 0:
                    k = len(sizes)
                    self.blocks.add_word(key, k)
                    sizes.append((len(key), n))
                    places.append(array("I"))
                if len(words) >= width:
                    places[k].extend((item, at))
                else:
                    whole.setdefault(k, array("I")).append(item)
        #: Of each block: bytes and words; item and word number of each place in a longer item; the items that it is all of.
        self.sizes, self.places, self.whole = sizes, places, whole
        self.around: dict[int, list[array]] = {}
        if sizes:
            self.blocks.make_automaton()

    def _window(self, k: int, place: int, before: int) -> tuple[int, ...]:
        """The words of the window around a place of block k that has so many words before the block."""
        item, at = self.places[k][2 * place : 2 * place + 2]
        return tuple(self.texts[item][at - before : at - before + self.width])

    def _around(self, k: int) -> list[array]:
        """For each number of words before block k, its places with such a window inside their item, sorted by the window's words."""
        if k not in self.around:
            items, starts = self.places[k][::2], self.places[k][1::2]
            self.around[k] = []
            for before in range(self.width - self.block + 1):
                inside = [p for p, (item, at) in enumerate(zip(items, starts, strict=True)) if before <= at <= len(self.texts[item]) - self.width + before]
                self.around[k].append(array("I", sorted(inside, key=lambda p, before=before: self._window(k, p, before))))
        return self.around[k]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of words, end exclusive, inside occurrences of windows; and the items."""
        if not words or not self.sizes:
            return [], set()
        normal = b" " + b" ".join(words) + b" "
        hits = [(end - self.sizes[k][0] + 1, k) for end, k in self.blocks.iter(normal.decode("latin-1"))]
        if not hits:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
        starts = np.searchsorted(spaces, [x for x, _ in hits]).tolist()
        known = self.words.get
        doc = [known(w, -1) for w in words]
        ranges: list[tuple[int, int]] = []
        found: set[int] = set()
        whole: set[int] = set()
        seen: dict[tuple[int, int], int] = {}
        met: dict[tuple[int, int, tuple[int, ...]], bool] = {}
        for start, (_, k) in zip(starts, hits, strict=True):
            n, place = self.sizes[k][1], self.places[k]
            if k in self.whole:
                ranges.append((start, start + n))
                whole.add(k)
            if len(place) > 2 * FEW:
                ranges += self._searched(doc, start, k, met, found)
                continue
            for item, at in zip(place[::2], place[1::2], strict=True):
                text = self.texts[item]
                if seen.get((item, start - at), -1) >= start + n:
                    continue
                low, high, shift = start, start + n, at - start
                first, last = max(0, -shift), min(len(doc), len(text) - shift)
                while low > first and doc[low - 1] == text[low - 1 + shift]:
                    low -= 1
                while high < last and doc[high] == text[high + shift]:
                    high += 1
                seen[item, start - at] = high
                if high - low >= self.width:
                    ranges.append((low, high))
                    found.add(item)
        for k in whole:
            found.update(self.whole[k])
        return _merged(ranges), {self.names[i] for i in found}

    def _searched(self, doc: list[int], start: int, k: int, met: dict, found: set[int]) -> Iterator[tuple[int, int]]:
        """The windows of doc around block k at start that items have; the items of those not met before are added to found."""
        for before, order in enumerate(self._around(k)):
            a = start - before
            if a < 0 or a + self.width > len(doc):
                continue
            window = tuple(doc[a : a + self.width])
            key = (k, before, window)
            if key not in met:
                words_at = lambda p, before=before: self._window(k, p, before)
                low = bisect_left(order, window, key=words_at)
                high = bisect_right(order, window, lo=low, key=words_at)
                found.update(self.places[k][2 * p] for p in order[low:high])
                met[key] = high > low
            if met[key]:
                yield a, a + self.width


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _shards(benchmark: DataFrame, item_col: str, item_text_col: str, shard_bytes: int) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """How many shards there are, and the items of each in turn."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-2 * size // shard_bytes)) if size > shard_bytes else 1
    for k in range(n):
        yield n, [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()]


def _matcher(key: str, items, width: int) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items.value, width)
    return _MATCHERS[key]


_FOUND = T.StructType([T.StructField("key", T.StringType()), T.StructField("r", T.ArrayType(T.LongType())), T.StructField("i", T.ArrayType(T.StringType()))])


def _hits(items, width: int):
    """Key, ranges and items of the documents with hits."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(name, items, width)
        for batch in batches:
            for piece in pieces(batch):
                rows = [(key, *m.find(words_of(text or ""))) for key, text in zip(piece.column("key").to_pylist(), piece.column("text").to_pylist(), strict=True)]
                rows = [(key, [x for a in r for x in a], sorted(i)) for key, r, i in rows if r]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True)], names=["key", "r", "i"])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, shard_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (code points)."""
    spark = docs.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    head = id_field(docs, id_col)
    schema = T.StructType([head, *(T.StructField(x, T.LongType()) for x in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span)])
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # A result follows from the text alone; a null text has no key and no hit.
    keyed = d.withColumn("key", F.sha2("text", 256))
    found = None
    for n, rows in _shards(benchmark, item_col, item_text_col, shard_bytes):
        items = spark.sparkContext.broadcast(rows)
        if n == 1:
            return d.mapInArrow(_results(schema, items, width), schema)
        # Equal texts have one key, and one result.
        one = stored(keyed.where("key IS NOT NULL").select("key", "text").mapInArrow(_hits(items, width), _FOUND).dropDuplicates(["key"]), "hits")
        items.destroy()
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("key").agg(F.flatten(F.collect_list("r")).alias("r"), F.flatten(F.collect_list("i")).alias("i"))
    return keyed.join(found, "key", "left").select("doc_id", "text", "r", "i").mapInArrow(_results(schema), schema)


def _results(schema: T.StructType, items=None, width: int = 0):
    """Result rows; without items the ranges and items found are in columns r and i."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        m = _matcher(name, items, width) if items else None
        for batch in batches:
            for piece in pieces(batch):
                rows = []
                given = zip(piece.column("r").to_pylist(), piece.column("i").to_pylist(), strict=True) if not m else ((None, None) for _ in range(piece.num_rows))
                for text, (r, i) in zip(piece.column("text").to_pylist(), given, strict=True):
                    words = words_of(text or "")
                    ranges, found = m.find(words) if m else (_merged([*zip((r or [])[::2], (r or [])[1::2], strict=True)]), set(i or ()))
                    rows.append(_result(text, len(words), ranges, found))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(to)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(to.field(0).type), *columns], schema=to)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, shard_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, with all columns, whose text holds no window of an item. Rows pass by one after another; nothing is shuffled."""
    name = uuid.uuid4().hex
    for n, rows in _shards(benchmark, item_col, item_text_col, shard_bytes):
        items = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], items=items, name=name) -> Iterator[pa.RecordBatch]:
            m = _matcher(name, items, width)
            for batch in batches:
                for piece in pieces(batch, text_col):
                    yield piece.filter(pa.array([not m.find(words_of(x or ""))[0] for x in piece.column(text_col).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if n > 1:
            docs = stored(docs, "clean")
            items.destroy()
        name = uuid.uuid4().hex
    return docs


def _result(text: str | None, n: int, ranges: list[tuple[int, int]], items: set[str]) -> tuple:
    names = sorted(items)
    spans = []
    if ranges:
        raw = text.encode("utf-8", "surrogatepass")
        at = [m.span() for m in WORD.finditer(raw.translate(_TO_KEEP))]
        points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
        spans = [{"start": int(points[at[a][0]]), "end": int(points[at[b - 1][1]])} for a, b in ranges]
    return n, sum(b - a for a, b in ranges), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(ranges), names, spans


#: Capitals as small letters, all else as it is.
_TO_KEEP = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
