"""Periodic runs of words, by an all-lag vectorised scan.

A run is a stretch of words with smallest period q that is at least
min_exponent periods and min_length words long and that no neighbouring word
extends. The array of a text's word ids is compared with itself shifted by each
lag up to n / min_exponent; true stretches of the comparison, run-length
encoded, are the stretches of that period. One that also stood at a smaller lag
isn't its smallest period: by Fine and Wilf it is then the very same stretch,
so of equal stretches the least lag counts. Word ids are exact, from a
dictionary of the words themselves.

Texts of up to range_bytes are scanned where they are read, many in one array:
sorted by length, a lag needs only the texts long enough for it, and ids differ
between texts, so no stretch crosses them. The work of a text grows with the
square of its length. Longer ones are cut into ranges of lags, one for each
range_bytes of text, that Spark deals out by size; so what a range costs grows
with the bytes that are sent for it. Their stretches meet again by a digest of
the text and mark its words.

Defined results: a null or empty text has no words and no runs. Rows are judged
by themselves: repeated and null ids get a result each, and extra columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from .batches import id_field, pieces
from .words import Words, split

MIN_EXPONENT, MIN_LENGTH = 4, 6
RANGE_BYTES = 1 << 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_ids(w: Words) -> np.ndarray:
    """A number for each word of a batch: the same for equal words of one text, and for those only."""
    if not len(w.start):
        return np.zeros(0, np.uint32)
    _, inside = _inside(w, np.ones(len(w.start), bool))
    offsets = np.concatenate([[0], np.cumsum(w.end - w.start)])
    words = pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(w.data[inside])])
    encoded = words.dictionary_encode()
    ids = encoded.indices.to_numpy().astype(np.uint64) + w.doc.astype(np.uint64) * np.uint64(len(encoded.dictionary))
    if ids[-1] >> np.uint64(31):
        ids = np.unique(ids, return_inverse=True)[1]
    return ids.astype(np.uint32 if len(ids) < 1 << 32 else np.uint64)


def _inside(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end marks summed up: flags of the bytes of the words that which marks."""
    step = np.zeros(len(w.data) + 1, np.int8)
    step[w.start[which]] += 1
    step[w.end[which]] -= 1
    return step, np.cumsum(step[:-1], dtype=np.int8).view(bool)


def stretches(ids: np.ndarray, lags: range, sizes: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """Rows (start, length, lag) of the long enough stretches at each lag. sizes: of the texts in ids, in falling order."""
    ends, found = np.cumsum(sizes), [np.zeros((0, 3), np.int64)]
    same = np.zeros(len(ids) + 2, bool)
    for p in lags:
        need = max(least, exponent * p)
        texts = int(np.searchsorted(-sizes, -need, side="right"))
        if not texts:
            break
        n = int(ends[texts - 1]) - p
        np.equal(ids[:n], ids[p : n + p], out=same[1 : n + 1])
        same[n + 1] = False
        if np.count_nonzero(same[: n + 1]) < need - p:
            continue
        edge = np.flatnonzero(same[1 : n + 2] != same[: n + 1])
        start, size = edge[::2], edge[1::2] - edge[::2]
        long = np.flatnonzero(size >= need - p)
        if len(long):
            found.append(np.column_stack([start[long], size[long] + p, np.full(len(long), p)]))
    return np.concatenate(found)


def smallest(found: np.ndarray) -> np.ndarray:
    """Of rows (start, length, lag), the least lag of each stretch, by start and lag."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    found = found[np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(axis=1)])] if len(found) else found
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _scan(w: Words, exponent: int, least: int) -> np.ndarray:
    """The runs of a batch, with starts counted through the whole batch."""
    sizes = w.counts()
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= least]
    if not len(order):
        return np.zeros((0, 3), np.int64)
    ids = word_ids(w)
    begin = np.cumsum(sizes[order]) - sizes[order]
    found = stretches(np.concatenate([ids[w.first[d] : w.first[d + 1]] for d in order]), range(1, int(sizes[order[0]]) // exponent + 1), sizes[order], exponent, least)
    text = np.searchsorted(begin, found[:, 0], side="right") - 1
    found[:, 0] += w.first[order[text]] - begin[text]
    return smallest(found)


def _rest(w: Words, runs: np.ndarray) -> pa.Array:
    """The texts, one space between words, without the words of runs beyond the first period."""
    step = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    doc = w.doc[kept]
    _, inside = _inside(w, kept)
    data = w.data.copy()
    # A kept word that isn't the last of its text has white space after it, which becomes the one space.
    spaced = w.end[kept[:-1][doc[:-1] == doc[1:]]]
    data[spaced] = 32
    inside[spaced] = True
    size = np.bincount(doc, weights=w.end[kept] - w.start[kept] + 1, minlength=w.n_docs).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))])
    return pa.Array.from_buffers(pa.large_string(), w.n_docs, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])]).cast(pa.string())


def _lists(w: Words, runs: np.ndarray) -> pa.Array:
    doc = w.doc[runs[:, 0]]
    columns = [runs[:, 0] - w.first[doc], runs[:, 1], runs[:, 2]]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=w.n_docs))])
    rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def _result(ids: pa.Array, w: Words, runs: np.ndarray, to: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.cast(to.field(0).type), pa.array(w.counts(), pa.int64()), _lists(w, runs).cast(to.field(2).type), _rest(w, runs)], schema=to)


def _whole(schema: T.StructType, exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        for batch in batches:
            for piece in pieces(batch):
                w = split(piece.column("text"))
                yield _result(piece.column("doc_id"), w, _scan(w, exponent, least), to)

    return run


def _ranges(schema: T.StructType, exponent: int, least: int):
    """Of each text and number of a range, the stretches at that range's lags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        for batch in batches:
            for piece in pieces(batch, rows=1):
                w = split(piece.column("text"))
                n, (k,), (of,) = len(w.start), piece.column("k").to_pylist(), piece.column("of").to_pylist()
                lags = range(n // exponent * k // of + 1, n // exponent * (k + 1) // of + 1)
                found = stretches(word_ids(w), lags, np.array([n]), exponent, least)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(to.field(0).type), piece.column("digest"), piece.column("k"), _lists(w, found).cast(to.field(3).type)], schema=to)

    return run


def _marked(schema: T.StructType):
    """Texts with the stretches of all lags: their runs, and what is left of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        for batch in batches:
            for piece in pieces(batch, rows=1):
                w = split(piece.column("text"))
                found = [(x["start"], x["length"], x["period"]) for x in piece.column("found").to_pylist()[0]]
                yield _result(piece.column("doc_id"), w, smallest(np.array(found, np.int64).reshape(-1, 3)), to)

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the words without repeated periods, joined by spaces."""
    head, long = id_field(docs, id_col), T.LongType()
    runs = T._parse_datatype_string(RUNS)
    last = T.StructType([head, T.StructField("n_words", long), T.StructField("runs", runs), T.StructField("collapsed", T.StringType())])
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    whole = d.where(size <= range_bytes).mapInArrow(_whole(last, min_exponent, min_length), last)

    large = d.where(size > range_bytes).withColumn("digest", F.sha2("text", 256))
    of = F.ceil(size / range_bytes).cast("int")
    dealt = large.withColumn("of", of).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).hint("rebalance")
    part = T.StructType([head, T.StructField("digest", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("runs", runs)])
    # Equal rows give equal parts, of which one stays.
    parts = dealt.mapInArrow(_ranges(part, min_exponent, min_length), part).groupBy("doc_id", "digest").agg(F.flatten(F.transform(F.collect_set(F.struct("k", "runs")), lambda x: x["runs"])).alias("found"))
    parts = parts.select(F.col("doc_id").alias("_d"), F.col("digest").alias("_g"), "found")
    both = large.join(parts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_g"))).select("doc_id", "text", "found")
    return whole.unionByName(both.mapInArrow(_marked(last), last))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, a tenth of them by the hash h of the id with the words from some word on repeated from there with some period; a null id or text stays."""
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i))), " "))

    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull() & (h % 10 == 0), let(words, repeated)).otherwise(F.col(text_col)))
