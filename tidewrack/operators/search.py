"""Inverted indexes over stored documents: ranked full-text search by words, and substring search by runs of three characters.

An index is a table of blocks of postings (term, part, keys, tfs, lengths) in
buckets by term and part. A task makes blocks of some megabytes of texts at a
time and sends those of a bucket together, as one compressed Arrow stream; behind
the shuffle blocks of one term are joined to some of 256 postings at most, as Spark
reads 4096 rows of lists at a time. In a file blocks are sorted by term, in
Parquet's second format, so keys of a block are packed as deltas and terms by
their common beginnings. A search reads the buckets
of its terms and nothing else. part is a hash of the key, so that the postings of
a term that nearly all documents have are spread over tasks. Under a null term
stands each document of the segment with its length.

Changed documents become a new segment: their postings, and a list of their keys
that makes postings of older segments dead. compact() writes one segment of what
is alive. All of an index changes in one transaction of its store.

Defined results: a null key isn't indexed; a null or empty text has no terms and
matches nothing; of rows with one key the first by text counts; extra columns
don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import BUCKET, Store, Transaction, bucket_of
from .tables import first_by, upsert

WORD_BREAK = r"[^\p{L}\p{N}]+"
GRAM = 3
K1, B = 1.2, 0.75
PIECE, PIECE_ROWS = 4 << 20, 1 << 16
BLOCK = 256
_PACKED = {"parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def runs_of(text: str) -> list[str]:
    """All runs of three characters, once each."""
    return list(dict.fromkeys(text[i : i + GRAM] for i in range(len(text) - GRAM + 1)))


def literal_runs(pattern: str) -> list[str]:
    """What a LIKE pattern says in full between its wildcards; \\ makes the next character plain."""
    runs, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            runs[-1] += pattern[at]
        elif c in "%_":
            runs.append("")
        else:
            runs[-1] += c
        at += 1
    return [r for r in runs if r]


def _pieces(batches: Iterator[pa.RecordBatch], column: str | None, most: int = PIECE, rows: int = PIECE_ROWS) -> Iterator[pa.Table]:
    """Batches joined and cut to tables of about most words or bytes of a column, and so many rows at most; a longer document stands whole."""
    held, size, n = [], 0, 0
    for batch in batches:
        if column is None:
            sizes = np.ones(batch.num_rows, np.int64)
        else:
            x = batch.column(column)
            sizes = (pc.list_value_length(x) if pa.types.is_list(x.type) else pc.binary_length(x)).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start, done = np.cumsum(sizes), 0, 0
        while start < batch.num_rows:
            end = min(batch.num_rows, start + rows - n, int(np.searchsorted(ends, done + most - size)) + 1)
            held.append(batch.slice(start, end - start))
            size, n = size + int(ends[end - 1]) - done, n + end - start
            start, done = end, int(ends[end - 1])
            if size >= most or n >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, n = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _word_postings(words: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words by number; by word, then document, each posting's word, document and count; the number of words of each document."""
    n, lengths = len(words), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    at, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
    code, doc = np.divmod(at, n)
    return coded.dictionary, code, doc, tf, lengths


def _gram_postings(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As _word_postings, of runs of three characters, each counted once in a document."""
    n, sizes = len(texts), pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    c = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    letters = np.flatnonzero(np.bincount(c, minlength=1))
    width = len(letters)
    number = np.zeros(int(c.max(initial=0)) + 1, np.int64)
    number[letters] = np.arange(width)
    x, doc = number[c], np.repeat(np.arange(n), sizes)
    runs = x[:-2] * width  # in place from here on, as each of these arrays is twice the text as UTF-32
    runs += x[1:-1]
    runs *= width
    runs += x[2:]
    del c, x
    own = doc[: 1 - GRAM] == doc[GRAM - 1 :]
    if width**3 * n < 1 << 63:
        runs *= n
        runs += doc[: 1 - GRAM]
        at = runs[own]
        del runs, own, doc
        at.sort()
        code, doc = np.divmod(at[_begins(at)], n)
        starts = _begins(code)
        found, code = code[starts], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
    else:
        found, code = np.unique(runs[own], return_inverse=True)
        code, doc = np.divmod(np.unique(code * n + doc[: 1 - GRAM][own]), n)
    said = letters[np.stack([found // width**2, found // width % width, found % width], 1)].astype("<u4").tobytes().decode("utf-32-le") if len(found) else ""
    return pa.array([said[i : i + GRAM] for i in range(0, len(said), GRAM)], pa.string()), code, doc, np.ones(len(code), np.int64), np.bincount(doc, minlength=n)


def _begins(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _blocks(starts: np.ndarray, term: pa.Array, part: np.ndarray, *values: pa.Array) -> pa.Table:
    """Blocks of postings that begin at starts, of keys, counts and lengths."""
    offsets = pa.array(np.append(starts, len(values[0])), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in values]
    return pa.table([term.cast(pa.string()), pa.array(part, pa.int32()), *lists], ["term", "part", "keys", "tfs", "lengths"])


def _bucket(term: str | None, part: int, buckets: int) -> int:
    return zlib.crc32(f"{part} {term or ''}".encode()) % buckets


def _sent(blocks: pa.Table, buckets: int) -> pa.RecordBatch:
    """Blocks as one compressed stream for each bucket."""
    to = np.fromiter((_bucket(t, p, buckets) for t, p in zip(blocks["term"].to_pylist(), blocks["part"].to_pylist(), strict=True)), np.int32, len(blocks))
    order = np.argsort(to, kind="stable")
    blocks, starts = blocks.take(order), _begins(to[order])
    streams = []
    for a, b in zip(starts, [*starts[1:], len(blocks)], strict=True):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, blocks.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(blocks.take(np.arange(a, b)).combine_chunks())
        streams.append(out.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(to[order[starts]], pa.int32()), pa.array(streams, pa.binary())], [BUCKET, "sent"])


def _joined(blocks: pa.Table) -> pa.Table:
    """Blocks of one term and part as one, or as several of BLOCK postings at most."""
    coded, part = _one(blocks["term"]).dictionary_encode(), blocks["part"].to_numpy().astype(np.int64)
    at = (pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1) * (part.max() + 1) + part
    order = np.argsort(at, kind="stable")
    starts = _begins(at[order])
    blocks = blocks.take(order)
    lists = [_one(blocks[c]) for c in ("keys", "tfs", "lengths")]
    ends = np.cumsum(np.append(0, pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False)))
    cuts = -(-np.diff(np.append(ends[starts], ends[-1])) // BLOCK)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    starts = np.repeat(starts, cuts)
    joined = _blocks(ends[starts] + nth * BLOCK, _one(blocks["term"]).take(pa.array(starts)), part[order[starts]], *[x.flatten() for x in lists])
    return joined.append_column(BUCKET, _one(blocks[BUCKET]).take(pa.array(starts)))


class Index:
    """An index named so in a store, of documents with one key column. kind: terms are words or, as grams, runs of three characters."""

    def __init__(self, store: Store, name: str, key: str = "url", kind: str = "words", buckets: int = 64, parts: int = 4):
        self.store, self.name, self.key, self.buckets, self.parts = store, name, key, buckets, parts
        if kind not in ("words", "grams"):
            raise ValueError(f"no such kind of index: {kind}")
        self.counted = kind == "words"

    # ---- segments ----

    def _segments(self, state: dict) -> list[int]:
        return sorted(int(t.rsplit(".", 1)[1]) for t in state["tables"] if t.startswith(f"{self.name}.postings."))

    def _schema(self, docs: DataFrame) -> T.StructType:
        many = lambda kind: T.ArrayType(kind, True)
        fields = {"term": T.StringType(), "part": T.IntegerType(), "keys": many(docs.schema[self.key].dataType), "tfs": many(T.IntegerType()), "lengths": many(T.IntegerType())}
        return T.StructType([T.StructField(k, x, True) for k, x in fields.items()])

    def _of_texts(self, docs: DataFrame, text: str) -> DataFrame:
        """Blocks of documents with different keys, to be sent, and one of a null term for each part."""
        said = F.coalesce(F.col(text), F.lit(""))
        d = docs.select(F.col(self.key).alias("key"), F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int").alias("part"), (words(said) if self.counted else F.lower(said)).alias("said"))
        parts, counted, buckets = self.parts, self.counted, self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in _pieces(batches, "said"):
                piece = piece.take(np.argsort(piece["part"].to_numpy(), kind="stable"))  # a term's documents in order lie by part
                n, part, key = len(piece), piece["part"].to_numpy(), _one(piece["key"])
                names, code, doc, tf, lengths = (_word_postings if counted else _gram_postings)(_one(piece["said"]))
                starts, own = _begins(code * parts + part[doc]), _begins(part)
                found = _blocks(starts, names.take(pa.array(code[starts])), part[doc[starts]], key.take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(lengths[doc], pa.int32()))
                every = _blocks(own, pa.nulls(len(own)), part[own], key, pa.array(np.zeros(n), pa.int32()), pa.array(lengths, pa.int32()))
                yield _sent(pa.concat_tables([found, every]).combine_chunks(), buckets)

        return d.mapInArrow(run, f"{BUCKET} int, sent binary")

    def _of_singles(self, rows: DataFrame) -> DataFrame:
        """Blocks of single postings, to be sent."""
        parts, buckets = self.parts, self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in _pieces(batches, None, rows=PIECE):
                coded = _one(piece["term"]).dictionary_encode()
                at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * parts + piece["part"].to_numpy()
                order = np.argsort(at, kind="stable")
                starts = _begins(at[order])
                code, part = np.divmod(at[order[starts]], parts)
                yield _sent(_blocks(starts, coded.dictionary.take(pa.array(code)), part, *[_one(piece[c]).take(pa.array(order)) for c in ("key", "tf", "length")]), buckets)

        return rows.select("term", "part", F.col(self.key).alias("key"), "tf", "length").mapInArrow(run, f"{BUCKET} int, sent binary")

    def _received(self, sent: DataFrame, schema: T.StructType) -> DataFrame:
        """The blocks that were sent, with their bucket; blocks of one term are joined as far as a task holds them together."""
        schema = T.StructType([*schema, T.StructField(BUCKET, T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            to, held, size = to_arrow_schema(schema), [], 0

            def joined() -> Iterator[pa.RecordBatch]:
                every = pa.concat_tables(held)
                held.clear()
                t = _joined(every)
                del every
                for a in range(0, len(t), PIECE_ROWS):
                    yield pa.RecordBatch.from_arrays([_one(c).cast(k.type) for c, k in zip(t.slice(a, PIECE_ROWS).columns, to, strict=True)], schema=to)

            for batch in batches:
                for bucket, stream in zip(batch.column(BUCKET), batch.column("sent"), strict=True):
                    blocks = pa.ipc.open_stream(stream.as_buffer()).read_all()
                    held.append(blocks.append_column(BUCKET, pa.array(np.full(len(blocks), bucket.as_py()), pa.int32())))
                    size += pc.sum(pc.list_value_length(held[-1]["keys"])).as_py()
                    if size >= PIECE:
                        yield from joined()
                        size = 0
            if held:
                yield from joined()

        return sent.mapInArrow(run, schema)

    def _singles(self, blocks: DataFrame) -> DataFrame:
        rows = blocks.select("term", "part", F.inline(F.arrays_zip("keys", "tfs", "lengths")))
        return rows.select("term", "part", F.col("keys").alias(self.key), F.col("tfs").alias("tf"), F.col("lengths").alias("length"))

    def _segment(self, tx: Transaction, n: int, sent: DataFrame, schema: T.StructType) -> None:
        table = f"{self.name}.postings.{n}"
        tx.create(table, schema, ["term", "part"], self.buckets, (), _PACKED)
        tx.put(table, sent, lambda rows: self._received(rows, schema))

    def _dead(self, tx: Transaction, n: int, keys: DataFrame) -> None:
        tx.create(f"{self.name}.dead.{n}", keys.schema, [], 1, (), _PACKED)
        tx.put(f"{self.name}.dead.{n}", keys)

    def refresh(self, tx: Transaction, docs: DataFrame, text: str = "text", deleted: DataFrame | None = None) -> None:
        """Index documents (key, text) that are new or have changed, and forget deleted ones (key)."""
        docs = first_by(docs.where(F.col(self.key).isNotNull()), [self.key], [F.asc_nulls_last(text)]).select(self.key, text)
        n = max([0, *self._segments(tx.state)]) + 1
        self._segment(tx, n, self._of_texts(docs, text), self._schema(docs))
        # What else there is to know of the documents stands in the segment, so they are read and taken apart once.
        own = self._singles(tx.read(f"{self.name}.postings.{n}", self._buckets_of([None])).where("term IS NULL"))
        sizes = own.select(self.key, "length", F.lit(True).alias("live"))
        if deleted is not None:
            only = deleted.where(F.col(self.key).isNotNull()).select(self.key).distinct().join(sizes.select(self.key), self.key, "left_anti")
            sizes = sizes.unionByName(only.select(self.key, F.lit(0).alias("length"), F.lit(False).alias("live")))
        sizes = tx.stage(f"{self.name}.sizes", sizes)
        lengths, total = f"{self.name}.lengths", f"{self.name}.total"
        tx.create(lengths, docs.select(self.key, F.lit(0).alias("length")).schema, [self.key], self.buckets)
        tx.create(total, "n bigint, length bigint")
        # The totals follow from what was there of the changed keys and what is there now.
        was = tx.read(lengths, tx.touched(lengths, sizes)).join(sizes.select(self.key), self.key, "left_semi")
        one = lambda rows, sign: rows.agg((F.count("*") * sign).alias("n"), (F.coalesce(F.sum("length"), F.lit(0)) * sign).alias("length"))
        sums = tx.read(total).unionByName(one(was, -1)).unionByName(one(sizes.where("live"), 1))
        tx.put(total, sums.agg(F.sum("n").alias("n"), F.sum("length").alias("length")))
        tx.merge(lengths, sizes, lambda old, new: upsert(old, new.where("live").select(self.key, "length"), [self.key]).join(new.where("NOT live").select(self.key), self.key, "left_anti"))
        self._dead(tx, n, sizes.select(self.key))

    def compact(self, tx: Transaction) -> None:
        """One segment of all live postings."""
        segments = self._segments(tx.state)
        if len(segments) < 2:
            return
        live = self._live(tx.state, None)
        self._segment(tx, segments[-1] + 1, self._of_singles(live), self._schema(live))
        self._dead(tx, segments[-1] + 1, live.select(self.key).limit(0))
        for n in segments:
            tx.drop(f"{self.name}.postings.{n}")
            tx.drop(f"{self.name}.dead.{n}")

    # ---- searches ----

    def _buckets_of(self, terms: list[str | None]) -> set[int]:
        return {_bucket(t, part, self.buckets) for t in terms for part in range(self.parts)}

    def _live(self, state: dict, terms: list[str] | None) -> DataFrame:
        """Postings that no later segment makes dead, of all terms or of some, read from these terms' buckets."""
        segments, buckets = self._segments(state), None
        if terms is not None:
            buckets = self._buckets_of(terms)
        found = []
        for n in segments:
            rows = self.store._frame(state, f"{self.name}.postings.{n}", buckets)
            rows = self._singles(rows.where(F.col("term").isin(terms) if terms is not None else F.col("term").isNotNull()))
            later = [self.store._frame(state, f"{self.name}.dead.{m}") for m in segments if m > n]
            found.append(rows.join(reduce(DataFrame.unionByName, later), self.key, "left_anti").select(*rows.columns) if later else rows)
        return reduce(DataFrame.unionByName, found)

    def _asked(self, query: str) -> list[str]:
        said = F.array_distinct(words(F.lit(query))) if self.counted else F.lower(F.lit(query))
        said = self.store.spark.range(1).select(said).first()[0]
        return list(said) if self.counted else runs_of(said)

    def match(self, query: str, version: int | None = None) -> DataFrame:
        """Keys of the documents that have every term of the query; a query without terms matches none."""
        state, terms = self.store.manifest(version or self.store.head()), self._asked(query)
        return self._with_all(state, terms)

    def _with_all(self, state: dict, terms: list[str]) -> DataFrame:
        live = self._live(state, terms).groupBy(self.key).agg(F.count("*").alias("_n"))
        return live.where(F.col("_n") == len(terms)).where(F.lit(bool(terms))).select(self.key)

    def search(self, query: str, most: int = 10, every: bool = False, version: int | None = None) -> DataFrame:
        """key and score of the first documents by BM25, ties by key; every: only documents with all terms."""
        state, terms = self.store.manifest(version or self.store.head()), self._asked(query)
        live = self._live(state, terms)
        n, length = self.store._frame(state, f"{self.name}.total").first()
        mean = max(length, 1) / max(n, 1)
        idf = live.groupBy("term").agg(F.log(1 + (n - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("_idf"))
        weight = F.col("_idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
        scored = live.join(F.broadcast(idf), "term").groupBy(self.key).agg(F.sum(weight).alias("score"), F.count("*").alias("_n"))  # a row for each term asked for
        scored = scored.where(F.col("_n") == len(terms)) if every else scored
        return scored.orderBy(F.desc("score"), self.key).limit(most).select(self.key, "score")

    def ilike(self, pattern: str, table: str, text: str = "text", version: int | None = None) -> DataFrame:
        """The rows of a table with this key whose text is ILIKE pattern: those with all runs of three characters of its plain parts, read from their buckets and verified.

        A pattern with no plain part of three characters scans the table.
        """
        state = self.store.manifest(version or self.store.head())
        low = self.store.spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
        asked = sorted({x for r in literal_runs(low) for x in runs_of(r)})
        if not asked:
            return self.store._frame(state, table).where(F.col(text).ilike(pattern))
        keys, t = self._with_all(state, asked), state["tables"][table]
        buckets = [r[0] for r in keys.select(bucket_of([self.key], t["buckets"])).distinct().collect()]
        return self.store._frame(state, table, buckets).join(keys, self.key, "left_semi").where(F.col(text).ilike(pattern))
