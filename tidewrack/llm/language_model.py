"""Scoring with an interpolated modified Kneser-Ney bigram model.

Words are 64-bit fingerprints. Each batch of training texts counts its own
bigrams; counts are packed, sent to the shard of their first word, merged
there, and written as sorted arrays to the shared folder. A first word that
fills much of a shard, as "the" or the start of a text does, is split over
several by its second words: how many follows from a histogram of first words
over all tokens. Each shard sends on, for every word, what it knows of it as a
second word (how often and after how many different words it came) and as a
first word (how often, and how many bigrams of counts 1, 2 and more it has): the
next shards, by that word, add these up and write the unigram arrays. Only sums
come to the driver. Workers memory-map the arrays, or hold those used last if
the store isn't a file system here, and look up the sorted, distinct keys of a
batch.

The order is two: with three, the arrays and their shuffle would take over four
times the input. A shard of about shard_bytes of text bounds a task's memory.
Files are renamed into place when complete, so a task may run again.

Defined results: a null or empty text is the end token alone. Repeated rows,
and rows with a null or repeated id, count, and are scored, as often as they
come. With nothing to learn from, every token has probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import histogram
from .batches import id_field, pieces
from .shared import shared_path
from .words import mix, split

_BATCH = 8 << 20
START, STOP = np.uint64(0x5354415254), np.uint64(0x53544F50)
_CLIP = 255
HEADS = ("total", "n1", "n2", "n3")
#: Maps can outlive their file descriptors from Python 3.13 on; before that each open array takes one.
_FREE = {"trackfd": False} if sys.version_info >= (3, 13) else {}
MAX_OPEN = 3000 if _FREE else 50
MAX_HELD = 256 << 20
_OPEN: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to folder/name.<key>, each complete before it has its name."""
    files, at = _filesystem(folder)
    files.create_dir(at, recursive=True)
    for key, x in arrays.items():
        part = f"{at}/.{name}.{key}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            out.write(np.ascontiguousarray(x).tobytes())
        files.move(part, f"{at}/{name}.{key}")


def open_arrays(folder: str, name: str, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """Memory-map folder/name.<key>, or read it from a store that is no file system here; empty arrays if it was never written.

    At most MAX_OPEN shards stay mapped, and MAX_HELD bytes are held, those used last.
    """
    key = f"{folder}/{name}"
    if key in _OPEN:
        _OPEN.move_to_end(key)
        return _OPEN[key]
    files, at = _filesystem(folder)
    paths = [f"{at}/{name}.{k}" for k in kinds]
    sizes = [f.size or 0 for f in files.get_file_info(paths)]
    out = {}
    for (k, kind), path, size in zip(kinds.items(), paths, sizes, strict=True):
        if not size:
            out[k] = np.zeros(0, kind)
        elif files.type_name == "local":
            with open(path, "rb") as f:
                out[k] = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_FREE), kind)
        else:
            with files.open_input_file(path) as f:
                out[k] = np.frombuffer(f.read(), kind)
    _OPEN[key] = out
    held = 0 if files.type_name == "local" else sum(x.nbytes for a in _OPEN.values() for x in a.values())
    while len(_OPEN) > MAX_OPEN or held > MAX_HELD and len(_OPEN) > 1:
        held -= sum(x.nbytes for x in _OPEN.popitem(last=False)[1].values())
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word and word before, for every token: the words of each text and one end."""
    w = split(texts, lower=True)
    h = w.hashes()
    n = w.counts() + 1
    last = np.cumsum(n) - 1
    word = np.full(int(n.sum()), STOP, np.uint64)
    inside = np.ones(len(word), bool)
    inside[last] = False
    word[inside] = h
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[last - n + 1] = START
    return np.repeat(np.arange(w.n_docs), n), word, before


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(v * np.uint64(0x9E3779B97F4A7C15) + mix(w))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


class Shards:
    """Where bigrams and words go. split: for each cell of the histogram of first words, over how many shards they are split."""

    def __init__(self, n: int, split: np.ndarray):
        self.n, self.split = n, split

    @classmethod
    def of(cls, n: int, counts: np.ndarray) -> Shards:
        """A cell with more than half of a shard's share is split."""
        share = max(1, int(counts.sum()) // (2 * n))
        return cls(n, np.minimum(n, -(-counts // share)).clip(1).astype(np.uint32))

    def word(self, w: np.ndarray) -> np.ndarray:
        return _shard(w, self.n)

    def pair(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        over = self.split[histogram.cells(v)]
        part = (mix(w ^ np.uint64(0x5A5A5A5A)) >> np.uint64(33)) % over.astype(np.uint64)
        return (_shard(v, self.n) + part.astype(np.int64)) % self.n


_COUNTED = "shard int, v binary, r binary, w binary, c binary"
_BY_WORD = "shard int, w binary, t binary, c binary, v binary, o binary, n1 binary, n2 binary, n3 binary, stats array<bigint>"


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = histogram.empty()
    for batch in batches:
        for piece in pieces(batch, most=_BATCH):
            histogram.add(counts, histogram.cells(tokens(piece.column("text"))[2]))
    yield histogram.packed(counts)


def _count(shards):
    """Packed bigram counts of each batch: distinct first words, how many bigrams each has, second words, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, most=_BATCH):
                _, w, v = tokens(piece.column("text"))
                key = _pair(v, w)
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                v, w, count = v[first], w[first], count.astype(np.uint32)
                s = shards.value.pair(v, w)
                order = np.lexsort((w, v, s))
                v, w, count, s = v[order], w[order], count[order], s[order]
                cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
                out = []
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    at = np.flatnonzero(np.r_[True, v[a + 1 : b] != v[a : b - 1]])
                    out.append((int(s[a]), v[a:b][at].tobytes(), np.diff(np.r_[at, b - a]).astype(np.uint32).tobytes(), w[a:b].tobytes(), count[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["shard", "v", "r", "w", "c"])

    return run


def _by_shard(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Rows sorted by shard, a shard at a time."""
    now, held = None, []
    for batch in batches:
        for shard, *row in zip(*(batch.column(x).to_pylist() for x in ("shard", *names)), strict=True):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held.append(row)
    if held:
        yield now, held


def _joined(rows: list[list], i: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[i] for r in rows), kind)


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()


def _bigrams(folder: str, shards):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches, ("v", "r", "w", "c")):
            v = np.repeat(_joined(rows, 0, np.uint64), _joined(rows, 1, np.uint32))
            w, c = _joined(rows, 2, np.uint64), _joined(rows, 3, np.uint32)
            rows.clear()
            order = np.lexsort((w, v))
            v, w, c = v[order], w[order], c[order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
            c = np.add.reduceat(c, first)
            v, w = v[first], w[first]
            at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            per = lambda x: np.add.reduceat(x.astype(np.int64), at).astype(np.uint32)  # noqa: B023, E731
            key = _pair(v, w)
            order = np.argsort(key)
            big = order[c[order] >= _CLIP]
            write_arrays(folder, f"b{shard}", {"key": key[order], "count": np.minimum(c, _CLIP)[order].astype(np.uint8), "big": key[big], "bigcount": c[big].astype(np.uint64)})
            stats = [0, *_counts_of_counts(c), 0, 0, 0]
            heads = [v[at], np.add.reduceat(c, at).astype(np.uint64), per(c == 1), per(c == 2), per(c > 2)]
            order = np.argsort(w, kind="stable")
            w, c = w[order], c[order]
            at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            tails = [w[at], np.diff(np.r_[at, len(w)]).astype(np.uint32), np.add.reduceat(c, at).astype(np.uint64)]
            out: dict[int, list] = {}
            for first, arrays in ((0, tails), (3, heads)):
                s = shards.value.word(arrays[0])
                order = np.argsort(s, kind="stable")
                s, arrays = s[order], [x[order] for x in arrays]
                cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    out.setdefault(int(s[a]), [b""] * 8)[first : first + len(arrays)] = [x[a:b].tobytes() for x in arrays]
            rows = [(k, *x, stats if not i else None) for i, (k, x) in enumerate(out.items())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 8, pa.list_(pa.int64())), strict=True)], names=["shard", "w", "t", "c", "v", "o", "n1", "n2", "n3", "stats"])

    return run


def _added(words: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct words in order, and the sums of their values."""
    order = np.argsort(words, kind="stable")
    words = words[order]
    at = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, np.int64)
    return [words[at], *(np.add.reduceat(x[order].astype(np.int64), at) if len(at) else x.astype(np.int64) for x in values)]


def _unigrams(folder: str):
    """Writes the unigram arrays; gives rows of counts of counts: kind 0 of bigrams, 1 of words by how many words they follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for shard, rows in _by_shard(batches, ("w", "t", "c", "v", "o", "n1", "n2", "n3", "stats")):
            out += [r[8] for r in rows if r[8]]
            tails = _added(_joined(rows, 0, np.uint64), _joined(rows, 1, np.uint32), _joined(rows, 2, np.uint64))
            heads = _added(_joined(rows, 3, np.uint64), _joined(rows, 4, np.uint64), *(_joined(rows, i, np.uint32) for i in (5, 6, 7)))
            rows.clear()
            every = np.union1d(tails[0], heads[0])
            arrays = {"w": every}
            for names, part in ((("types", "count"), tails), (HEADS, heads)):
                at = np.searchsorted(every, part[0])
                for name, x in zip(names, part[1:], strict=True):
                    arrays[name] = np.zeros(len(every), "<u8")
                    arrays[name][at] = x
            write_arrays(folder, f"u{shard}", arrays)
            out.append([1, *_counts_of_counts(tails[1]), len(tails[0]), int(tails[1].sum()), int(tails[2].sum())])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], names=["stats"])

    return run


def discounts(n: list[int]) -> list[float]:
    """The modified Kneser-Ney discounts for counts of 1, 2 and over 2; halves where a count of counts is 0."""
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]


class Model:
    """What workers need to open the arrays, and the numbers that hold for all of them. shards: a broadcast of Shards."""

    def __init__(self, folder: str, shards, bigram: list[int], word: list[int], vocabulary: int, types: int, total: int):
        self.folder, self.shards, self.vocabulary, self.types, self.total = folder, shards, vocabulary, types, total
        self.bigram, self.word = discounts(bigram), discounts(word)
        n1, n2 = word[0], word[1]
        self.spare = (self.word[0] * n1 + self.word[1] * n2 + self.word[2] * (vocabulary - n1 - n2)) / types if types else 1.0

    def _discount(self, d: list[float], c: np.ndarray) -> np.ndarray:
        return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]

    def unigrams(self, words: np.ndarray) -> dict[str, np.ndarray]:
        """Of distinct words: counts, of how many words they follow, and as first words counts and bigrams of counts 1, 2 and more."""
        kinds = {k: "<u8" for k in ("w", "types", "count", *HEADS)}
        out = {k: np.zeros(len(words)) for k in kinds if k != "w"}
        for shard, at in _groups(self.shards.value.word(words), words):
            x = open_arrays(self.folder, f"u{shard}", kinds)
            i, ok = _found(x["w"], words[at])
            for k in out:
                out[k][at[ok]] = x[k][i[ok]]
        return out

    def pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of distinct bigrams."""
        c, key = np.zeros(len(v)), _pair(v, w)
        for shard, at in _groups(self.shards.value.pair(v, w), key):
            x = open_arrays(self.folder, f"b{shard}", {"key": "<u8", "count": "u1", "big": "<u8", "bigcount": "<u8"})
            for keys, counts in ((x["key"], x["count"]), (x["big"], x["bigcount"])):
                k, ok = _found(keys, key[at])
                c[at[ok]] = counts[k[ok]]
        return c

    def score(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text: tokens, known tokens, base score and log10 probability."""
        doc, w, v = tokens(texts)
        n = len(texts)
        words, back = np.unique(np.concatenate([w, [START]]), return_inverse=True)
        start, back = back[-1], back[:-1]
        x = self.unigrams(words)
        base = np.log10((x["count"] + 0.1) / (self.total + 0.1 * (self.vocabulary + 1)))
        lower = np.maximum(x["types"] - self._discount(self.word, x["types"]), 0) / max(self.types, 1) + self.spare / (self.vocabulary + 1)
        # A token's first word is the token before it, or the start.
        before = np.r_[start, back[:-1]]
        before[v == START] = start
        _, first, pair_back = np.unique(_pair(v, w), return_index=True, return_inverse=True)
        c, low, head = self.pairs(v[first], w[first]), lower[back[first]], before[first]
        total = np.maximum(x["total"][head], 1)
        spare = sum(d * x[k][head] for d, k in zip(self.bigram, HEADS[1:], strict=True)) / total
        p = np.where(x["total"][head] > 0, np.maximum(c - self._discount(self.bigram, c), 0) / total + spare * low, low)
        add = lambda x: np.bincount(doc, weights=x, minlength=n)
        return [np.bincount(doc, minlength=n), add(x["count"][back] > 0).astype(np.int64), add(base[back]), add(np.log10(p)[pair_back])]


def _groups(shard: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.lexsort((key, shard))
    s = shard[order]
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True]) if len(s) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(s[a]), order[a:b]


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return i, (table[i] == keys if len(table) else np.zeros(len(keys), bool))


def train(docs: DataFrame, text_col: str = "text", shard_bytes: int = 16 << 20) -> Model:
    """Count all rows of docs and write the model to a new folder in the shared one."""
    spark = docs.sparkSession
    folder = shared_path(spark, "language-model")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(4, -(-size // shard_bytes))
    texts = docs.select(F.col(text_col).alias("text"))
    shards = spark.sparkContext.broadcast(Shards.of(n, histogram.total(texts.mapInArrow(_first_words, histogram.SCHEMA))))
    # A task has one shard; by hash of the shard, some would have several.
    words = texts.mapInArrow(_count(shards), _COUNTED).repartitionById(n, "shard").sortWithinPartitions("shard").mapInArrow(_bigrams(folder, shards), _BY_WORD)
    stats = words.repartitionById(n, "shard").sortWithinPartitions("shard").mapInArrow(_unigrams(folder), "stats array<bigint>")
    sums = {r["kind"]: r for r in stats.groupBy(F.col("stats")[0].alias("kind")).agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(1, 8)]).collect()}
    total = lambda kind, i: sums[kind][f"s{i}"] if kind in sums else 0
    return Model(folder, shards, [total(0, i) for i in range(1, 5)], [total(1, i) for i in range(1, 5)], total(1, 5), total(1, 6), total(1, 7))


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row; learn says which rows to learn from."""
    model = train(docs.where(learn), text_col, shard_bytes)
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([id_field(docs, id_col), *(T.StructField(x, k) for x, k in (("n_tokens", long), ("n_known", long), ("train_tokens", long), ("base_score", double), ("score", double)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        for batch in batches:
            for piece in pieces(batch, most=_BATCH):
                n, known, base, full = model.score(piece.column("text"))
                arrays = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.total), pa.int64()), pa.array(base), pa.array(full)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(to.field(0).type), *arrays], schema=to)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
