"""Phrase collocations from suffix arrays of word ids.

A shard is a batch of texts. Its words become ids, and the suffixes of its
pieces (what stands between marks of punctuation) are sorted by their first n
words with prefix doubling. Neighbours in that order whose common prefix (LCP)
reaches n words make an interval, which is an n-gram with its count; Spark adds
up the counts of all shards by language and phrase.

Phrases are counted level by level. A phrase that occurs often enough has parts
that do, so at level n a suffix stays in the array only if both its (n-1)-grams
can be frequent, and of the very many rare n-grams few are ever sent. What can
be frequent is told by a Bloom filter of the level before: 16 bits a key and two
of them set, at most 2^27 bits (16 MiB). It lets all frequent phrases pass; with
more keys than it is made for it lets more of the others pass too, which costs
time and changes no count. Counts themselves are of whole phrases, never of
hashes.

Defined results: a null language is "und", a null or empty text has no words.
Every row counts, repeated ones too; ids and extra columns don't matter. Without
frequent phrases there are no rows. Scores are whole numbers from decimals of 38
digits, exact for counts below 10^15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import pieces
from .shared import discard, stored
from .words import _table, mix, split

MAX_WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2000
SHARD_BYTES = 2 << 20
FILTER_BITS, PARTS, RANK_PARTS = 27, 64, 16
BREAKS = b".,;:!?" + bytes(range(0x0A, 0x0E))
COUNTED = "lang string, phrase string, count bigint"
_U = np.uint64


class Shard:
    """The words of a batch of texts: ids, pieces and languages."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        w = split(texts, lower=True, space=BREAKS + b" \t")
        breaks = np.searchsorted(np.flatnonzero(_table(BREAKS)[w.data]), w.start)
        self.n = len(w.start)
        new = np.ones(self.n, bool)
        new[1:] = (np.diff(breaks) != 0) | (np.diff(w.doc) != 0)
        self.piece = np.cumsum(new)
        size = w.end - w.start
        # Bytes of words are those between as many starts as ends.
        step = np.zeros(len(w.data) + 1, np.int8)
        step[w.start] += 1
        step[w.end] -= 1
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(w.data[np.cumsum(step[:-1], dtype=np.int8).view(bool)])]).dictionary_encode()
        del step
        self.words, self.code = words.dictionary, words.indices.to_numpy().astype(np.int64)
        known = langs.fill_null("und").dictionary_encode()
        self.langs, self.lang = known.dictionary, known.indices.to_numpy().astype(np.int64)[w.doc]
        self.ids = self.lang * len(self.words) + self.code

    def hashes(self, n: int) -> np.ndarray:
        """Of the n words from each word on, whether or not they are of one piece."""
        word = _word_hashes(self.words)[self.code]
        return _combined([word[k : self.n - n + 1 + k] for k in range(n)], _lang_hashes(self.langs)[self.lang[: max(self.n - n + 1, 0)]])

    def grams(self, n: int, known: Bloom | None) -> pa.RecordBatch:
        """lang, phrase, count of the n-grams whose (n-1)-grams are known."""
        last = max(self.n - n + 1, 0)
        inside = self.piece[:last] == self.piece[n - 1 :]
        if known:
            may = known.has(self.hashes(n - 1))
            inside &= may[:last] & may[1 : last + 1]
        order, same = suffix_array(self.ids, self.piece, n, np.flatnonzero(inside))
        start = np.flatnonzero(~same)
        first, count = order[start], np.diff(np.append(start, len(order)))
        words = [self.words.take(pa.array(self.code[first + k])).cast(pa.large_string()) for k in range(n)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[first])).cast(pa.string()), phrase.cast(pa.string()), pa.array(count, pa.int64())], names=["lang", "phrase", "count"])

    def totals(self) -> pa.RecordBatch:
        """The number of words of each language, with no phrase."""
        count = np.bincount(self.lang, minlength=len(self.langs))
        return pa.RecordBatch.from_arrays([self.langs.cast(pa.string()), pa.nulls(len(count), pa.string()), pa.array(count, pa.int64())], names=["lang", "phrase", "count"])


def suffix_array(ids: np.ndarray, piece: np.ndarray, depth: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at at, sorted by their first depth words within their piece, and whether each shares all of these with the one before.

    Ranks by d words and, from e <= d words ahead, by d words again make ranks by d + e words.
    """
    rank, d = ids, 1
    while d < depth:
        e = min(d, depth - d)
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-e] = np.where(piece[e:] == piece[:-e], rank[e:] + 1, 0)
        if len(rank) and int(rank.max()) >= 1 << 31:
            rank = np.unique(rank, return_inverse=True)[1]
            continue
        key = rank * (int(rank.max(initial=0)) + 2) + ahead
        d += e
        if d == depth:
            rank = key
            break
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = np.diff(key[order]) != 0
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new) - 1
    key = rank[at]
    order = np.argsort(key)
    same = np.zeros(len(key), bool)
    same[1:] = np.diff(key[order]) == 0
    return at[order], same


# ---- what can be frequent ----


def _word_hashes(words: pa.Array) -> np.ndarray:
    return split(words, space=b" ").hashes()


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.to_pylist()], _U)


def _combined(words: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(reduce(lambda h, w: h * _U(0x9E3779B97F4A7C15) + w, words, lang))


class Bloom:
    """A filter of hashes in 2^bits bits."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    @staticmethod
    def cells(h: np.ndarray, bits: int) -> np.ndarray:
        return np.concatenate([h >> _U(64 - bits), mix(h) >> _U(64 - bits)]).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.cells(h, self.bits)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).reshape(2, -1).all(axis=0)


def _cells(bits: int, n: int):
    """Of phrases of n words, the part of the filter and the bit in it that each sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = split(batch.column("phrase"), space=b" ").hashes().reshape(-1, n)
                langs = batch.column("lang").dictionary_encode()
                h = _combined(list(words.T), _lang_hashes(langs.dictionary)[langs.indices.to_numpy()])
                at = np.unique(Bloom.cells(h, bits))
                size = (1 << bits) // PARTS
                yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32))], names=["part", "bit"])

    return run


def _parts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = batch.column("part").to_numpy(), batch.column("bit").to_numpy()
            for p in np.unique(part).tolist():
                found.setdefault(p, np.zeros((1 << bits) // PARTS, bool))[bit[part == p]] = True
        if found:
            packed = [pa.Codec("zstd", 1).compress(np.packbits(x, bitorder="little").tobytes(), asbytes=True) for x in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(packed, pa.binary())], names=["part", "data"])

    return run


def bloom(phrases: DataFrame, n: int, most_bits: int = FILTER_BITS) -> Bloom:
    """The filter of phrases (lang, phrase) of n words; its size follows their number, up to most_bits. The driver gets no more than its bits."""
    bits = min(most_bits, max(16, (16 * phrases.count()).bit_length()))
    rows = phrases.select("lang", "phrase").mapInArrow(_cells(bits, n), "part int, bit int").repartition(PARTS, "part").mapInArrow(_parts(bits), "part int, data binary").collect()
    size = (1 << bits) // PARTS // 8
    data = np.zeros(PARTS * size, np.uint8)
    for r in rows:
        data[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(pa.Codec("zstd", 1).decompress(r["data"], size, asbytes=True), np.uint8)
    return Bloom(bits, data)


# ---- counts ----


def _count(n: int, known, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = Bloom(known.value[0], np.frombuffer(known.value[1], np.uint8)) if known else None
        for batch in batches:
            for piece in pieces(batch, most=shard_bytes):
                shard = Shard(piece.column("text"), piece.column("lang"))
                yield shard.grams(n, may)
                if n == 1:
                    yield shard.totals()

    return run


def counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS) -> list[DataFrame]:
    """For each length from one word on, a stored table of lang, phrase and count for the phrases that occur at least so often; that of words has each language's total too, with a null phrase."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sc, levels, known = docs.sparkSession.sparkContext, [], None
    for n in range(1, max_words + 1):
        found = texts.mapInArrow(_count(n, known, shard_bytes), COUNTED).groupBy("lang", "phrase").agg(F.sum("count").alias("count"))
        levels.append(stored(found.where(F.col("phrase").isNull() | (F.col("count") >= least)), f"phrases{n}"))
        if n < max_words:
            f = bloom(levels[-1].where("phrase IS NOT NULL"), n, filter_bits)
            known = sc.broadcast((f.bits, f.data.tobytes()))
    return levels


def _scored(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the phrases of two words or more, by their lowest-scoring cut."""
    grams = reduce(DataFrame.unionByName, [x.where("phrase IS NOT NULL").withColumn("words", F.lit(k + 1)) for k, x in enumerate(levels)])
    word = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(word, a, n), " ")
    cuts = grams.where("words > 1").withColumnRenamed("count", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"_left": part(1, F.col("k")), "_right": part(F.col("k") + 1, F.col("words") - F.col("k"))})
    of = lambda side, name: grams.select("lang", F.col("phrase").alias(side), F.col("count").alias(name))
    both = cuts.join(of("_left", "l"), ["lang", "_left"]).join(of("_right", "r"), ["lang", "_right"])
    exact = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    both = both.withColumn("score", F.expr(f"CAST(1000000 AS DECIMAL(7, 0)) * {exact('a')} * {exact('a')} div ({exact('l')} * {exact('r')})"))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "b.words", "b.a", "b.l", "b.r", "b.score")


def _inside(candidates: DataFrame, max_words: int) -> DataFrame:
    """lang, phrase, over: the phrases of two words or more inside longer candidates, with the longer one's largest count."""
    word = F.split("phrase", " ")
    shorter = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda a: F.array_join(F.slice(word, a, n), " "))))
    return candidates.where("words > 2").select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))


def mine(
    docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, share: int = SHARE, top: int | None = TOP,
    text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score (top None: all), without those that stand for share percent and more in a longer one."""
    levels = counts(docs, max_words, least, text_col, lang_col, shard_bytes, filter_bits)
    scored = _scored(levels)
    left = scored.join(_inside(scored, max_words), ["lang", "phrase"], "left").where(F.expr(f"over IS NULL OR 100 * over < {int(share)} * a"))
    total = levels[0].where("phrase IS NULL").select("lang", F.col("count").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # What is ranked by language is the first of each of so many parts, however many tasks there are.
        left = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
        left = left.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= top).drop("_part", "_r")
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= top) if top is not None else ranked
    done = stored(ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    for x in levels:
        discard(x)
    return done
