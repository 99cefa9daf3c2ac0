"""Substring deduplication over prefix-partitioned suffix groups.

A repeat is a window of 20 consecutive words that also starts earlier: in a
document with a smaller id, or before in the same one. Of the suffixes of all
texts, those that matter begin at an anchor: of the five-word prefixes that
start in a window, the one with the least fingerprint. Equal windows have equal
anchors at equal places, so they meet in the group of one prefix, and only
about two of seventeen suffixes are shuffled. Under a prefix, the nodes of the
suffix tree that are 20 words deep are kept as fingerprints of their windows;
the windows an anchor owns travel with it as one row. Runs of windows whose
node was met before are the repeats, of any length.

Prefixes are of variable length, so that groups fit in memory: a histogram of
all documents' windows by their prefix tells how large a group gets, with a
fixed number of cells. Where it would have more than group_windows windows (or
eight times the mean, if that is more), the prefix is lengthened to the first
ten words of a window, and where these are as frequent to all of its words: then
a group is one node. Each batch of documents first settles its own repeats, so a
passage of a third of all rows gives a few rows for each batch only; the rest of
a group is streamed in the order of documents, and only the distinct nodes under
the current prefix are held. Two windows count as equal if 64 bits of their
prefix and 56 of their words agree.

Defined results: a null text has no words; a text of under 20 words loses none.
A null id comes before all others. Repeated ids: different texts of one id are
different documents, in the order of a hash of the text; equal rows are one
document, and each of them gets its result. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import histogram
from .batches import id_field, pieces
from .words import SPACE, mix, split, windows

PREFIX, LONGER = 5, 10
WIDTH = 20
KEPT_BYTES = 7
_MASK = np.uint64((1 << (8 * KEPT_BYTES)) - 1)
_BATCH = 4 << 20


def _runs(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (places in at) and lengths of runs of consecutive numbers over which the other arrays don't change."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = at[1:] != at[:-1] + 1
    for x in same:
        new |= x[1:] != x[:-1]
    start = np.flatnonzero(np.r_[True, new])
    return start, np.diff(np.r_[start, len(at)])


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of width words, the place of its anchor: leftmost of the least prefix fingerprints that start in it."""
    g = windows(h, PREFIX, seed=5)
    at = np.arange(len(g))
    span, want = 1, width - PREFIX + 1
    while span < want:
        step = min(span, want - span)
        a, b = at[:-step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        span += step
    return at


class Piece:
    """The windows of a batch of texts: their places, anchors, nodes and, in prefixes, what stands for their prefixes of each length."""

    def __init__(self, texts: pa.Array, width: int):
        self.words = w = split(texts)
        h = w.hashes()
        enough = len(h) >= width
        self.inside = np.flatnonzero(w.doc[: len(h) - width + 1] == w.doc[width - 1 :]) if enough else np.zeros(0, np.int64)
        self.anchor = anchors(h, width)[self.inside] if enough else self.inside
        self.doc = w.doc[self.inside]
        self.node = windows(h, width, seed=3)[self.inside] if enough else np.zeros(0, np.uint64)
        self.prefixes = [windows(h, PREFIX, seed=5)[self.anchor], windows(h, min(LONGER, width), seed=7)[self.inside], self.node] if enough else [self.node] * 3

    def keys(self, large: np.ndarray) -> np.ndarray:
        """The prefix of each window that is long enough. large: flags of the cells of prefixes of the first two lengths."""
        a, b, c = self.prefixes
        first, second = large.reshape(2, -1)
        return np.where(~first[histogram.cells(a)], a, np.where(~second[histogram.cells(b)], b, mix(c)))


def _sizes(width: int):
    """How many windows have a prefix in each cell, for prefixes of the first two lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = histogram.empty(2)
        for batch in batches:
            for piece in pieces(batch, most=_BATCH):
                for of_length, prefix in zip(counts.reshape(2, -1), Piece(piece.column("text"), width).prefixes, strict=False):
                    histogram.add(of_length, histogram.cells(prefix))
        yield histogram.packed(counts)

    return run


def _suffixes(width: int, schema: T.StructType, large):
    """Of each batch: ranges of windows met before in it, and a row for each anchor and prefix with the windows it owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        flags = np.unpackbits(np.frombuffer(large.value, np.uint8)).astype(bool)
        for batch in batches:
            for piece in pieces(batch, most=_BATCH):
                order = pc.sort_indices(pa.table({"d": piece.column("doc_id"), "k": piece.column("k")}), [("d", "ascending"), ("k", "ascending")], null_placement="at_start")
                piece = piece.take(order)
                p = Piece(piece.column("text"), width)
                if not len(p.inside):
                    continue
                w, inside, anchor, doc, node = p.words, p.inside, p.anchor, p.doc, p.node & _MASK
                prefix = p.keys(flags)
                _, first, which = np.unique(node, return_index=True, return_inverse=True)
                met = (first[which] != np.arange(len(node))) & (prefix[first[which]] == prefix)
                place = w.position()[inside]
                old, new = np.flatnonzero(met), np.flatnonzero(~met)
                s, n = _runs(inside[old], doc[old])
                s2, n2 = _runs(inside[new], anchor[new], prefix[new])
                rows = np.concatenate([doc[old][s], doc[new][s2]])
                data = node[new].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes()
                offsets = np.concatenate([np.zeros(len(s) + 1, np.int32), (np.cumsum(n2) * KEPT_BYTES).astype(np.int32)])
                packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                # A settled range goes where its document's hash sends it.
                key = np.concatenate([mix(place[old][s].astype(np.uint64)), prefix[new][s2]]).view(np.int64)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), piece.column("doc_id").take(take).cast(to.field(1).type), piece.column("k").take(take), pa.array(np.concatenate([place[old][s], place[new][s2]]), pa.int32()), pa.array(np.concatenate([n, np.zeros(len(s2), np.int64)]), pa.int32()), packed.cast(to.field(5).type)], schema=to
                )

    return run


def _met_before(schema: T.StructType):
    """Over rows sorted by prefix and document: the ranges of windows whose node was met before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        held_prefix, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            n_old = batch.column("n").to_numpy()
            start = batch.column("start").to_numpy().astype(np.int64)
            size = pc.binary_length(batch.column("nodes")).to_numpy().astype(np.int64) // KEPT_BYTES
            raw = np.frombuffer(b"".join(batch.column("nodes").to_pylist()), np.uint8).reshape(-1, KEPT_BYTES)
            node = np.zeros((len(raw), 8), np.uint8)
            node[:, :KEPT_BYTES] = raw
            node = node.view("<u8").ravel()
            row = np.repeat(np.arange(len(size)), size)
            place = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            prefix = batch.column("key").to_numpy()[row]
            met = np.zeros(len(node), bool)
            if len(node):
                with np.errstate(over="ignore"):
                    both = mix(node + mix(prefix.view(np.uint64)))
                _, first, which = np.unique(both, return_index=True, return_inverse=True)
                met = first[which] != np.arange(len(node))
                if held_prefix == prefix[0]:
                    here = prefix == held_prefix
                    met[here] |= np.isin(node[here], held)
                mine = np.unique(node[prefix == prefix[-1]])
                held = np.union1d(held, mine) if held_prefix == prefix[-1] else mine
                held_prefix = prefix[-1]
            old = np.flatnonzero(n_old > 0)
            hit = np.flatnonzero(met)
            s, n = _runs(place[hit], row[hit])
            rows = np.concatenate([old, row[hit][s]])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take).cast(to.field(0).type), batch.column("k").take(take), pa.array(np.concatenate([start[old], place[hit][s]]), pa.int32()), pa.array(np.concatenate([n_old[old], n]), pa.int32())], schema=to)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """doc_id, k, text, and whether an id repeats; k tells texts of one id apart and is 0 throughout if none does."""
    some = docs.groupBy(id_col).count().where("count > 1").limit(1).count()
    k = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if some else F.lit(0).cast("bigint")
    return docs.select(F.col(id_col).alias("doc_id"), k.alias("k"), F.col(text_col).alias("text")), bool(some)


def repeats(keyed: DataFrame, width: int = WIDTH, group_windows: int = 1 << 22) -> DataFrame:
    """doc_id, k, start, n: n windows from the start-th word on have an earlier equal. keyed: as from _keyed."""
    counts = histogram.total(keyed.select("text").mapInArrow(_sizes(width), histogram.SCHEMA), 2)
    most = max(group_windows, 8 * int(counts.sum()) // len(counts))
    large = keyed.sparkSession.sparkContext.broadcast(np.packbits(counts > most).tobytes())
    head = id_field(keyed, "doc_id")
    long, int_ = T.StructField("k", T.LongType()), lambda x: T.StructField(x, T.IntegerType())
    first = T.StructType([T.StructField("key", T.LongType()), head, long, int_("start"), int_("n"), T.StructField("nodes", T.BinaryType())])
    found = keyed.mapInArrow(_suffixes(width, first, large), first)
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "k", "start")
    return found.mapInArrow(_met_before(last := T.StructType([head, long, int_("start"), int_("n")])), last)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = False, group_windows: int = 1 << 22) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and with_text the kept words as text."""
    keyed, some = _keyed(docs, id_col, text_col)
    ranges = repeats(keyed.dropDuplicates(["doc_id", "k"]) if some else keyed, width, group_windows).groupBy("doc_id", "k").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    head = id_field(keyed, "doc_id")
    packed = T.StructType([head, T.StructField("k", T.LongType()), T.StructField("size", T.LongType()), T.StructField("z", T.BinaryType())])
    d = keyed.mapInArrow(_packed(packed), packed)
    r = ranges.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"), "ranges")
    both = d.join(r, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k")), "left").select("doc_id", "size", "z", "ranges")
    fields = [head, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    result = T.StructType([*fields, T.StructField("kept", T.StringType())] if with_text else fields)
    return both.mapInArrow(_kept(width, result, with_text), result)


def _packed(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, codec = to_arrow_schema(schema), pa.Codec("zstd", 1)
        for batch in batches:
            for piece in pieces(batch):
                texts = [(x or "").encode("utf-8", "surrogatepass") for x in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(to.field(0).type), piece.column("k"), pa.array(map(len, texts), pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in texts], to.field(3).type)], schema=to)

    return run


_TO_SPACE = bytes(32 if c in SPACE else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return [x for x in text.translate(_TO_SPACE).split(b" ") if x]


def _kept(width: int, schema: T.StructType, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, codec = to_arrow_schema(schema), pa.Codec("zstd", 1)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows = []
                for size, z, ranges in zip(part.column("size").to_pylist(), part.column("z").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                    words = words_of(codec.decompress(z, size, asbytes=True)) if size else []
                    keep, at, removed = [], 0, 0
                    for start, end in sorted((r["start"], r["start"] + r["n"] + width - 1) for r in ranges or ()):
                        if start > at:
                            keep += words[at:start]
                        removed += max(0, end - max(at, start))
                        at = max(at, end)
                    keep += words[at:]
                    text = b" ".join(keep)
                    rows.append((len(words), removed, hashlib.sha256(text).hexdigest(), *([text.decode("utf-8", "surrogatepass")] if with_text else [])))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(to)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(to.field(0).type), *columns], schema=to)

    return run
