"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features: in each turn a shallow tree over one
feature's bins is fitted to the gradient and added to that feature's lookup
table. Then the pairs with most left to explain get tables of their own in the
same way. Scoring looks up bins and adds, for many documents at once.

The model is fitted on the driver from the features of at most max_rows
labelled rows, those with the least hash of their id and text; every document is
scored on its whole text, a very long one too. Defined results: a null or empty
text has the features of no words and is scored as such. Labels that are null or
whose document is missing are not learnt from; a document with several labels
counts once for each, and so does each document of a repeated id. Rows with a
null or repeated id are scored each by itself, and have no say in the scores of
others; equal texts have equal scores. Without labels every score is 0.5, and
with one class it is near that class. Of equally good cuts the first is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_texts
from .words import split, windows

FEATURES = ("log_words", "word_length", "upper", "digit", "space", "mark", "symbol", "non_ascii", "line_length", "distinct", "top_word", "same_next", "repeated_span", "symbol_ends", "short_words", "long_words")
_KIND = np.full(256, 6, np.int64)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[[0x20, 9, 10, 11, 12, 13]] = 3
_KIND[list(b".,;:!?'\"()-")] = 4
_KIND[128:] = 5


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(key)])


def features(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text, from the whole of it."""
    column = pa.array([x.encode("utf-8", "replace") for x in texts], pa.large_binary())
    w = split(column)
    n = np.maximum(w.counts(), 1)
    out = np.zeros((len(texts), len(FEATURES)))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), sizes)
    kinds = np.bincount(doc * 7 + _KIND[w.data], minlength=7 * len(texts)).reshape(-1, 7)
    lines = np.bincount(doc[w.data == 10], minlength=len(texts)) + 1
    total = np.maximum(sizes, 1)
    out[:, 0] = np.log1p(w.counts())
    length = w.end - w.start
    per = lambda x: np.bincount(w.doc, weights=x, minlength=len(texts)) / n
    out[:, 1] = per(length)
    for k, c in ((2, 1), (3, 2), (4, 3), (5, 4), (6, 6), (7, 5)):
        out[:, k] = kinds[:, c] / total
    out[:, 8] = np.log1p(sizes / lines)
    h = w.hashes()
    order = np.lexsort((h, w.doc))
    hs, ds = h[order], w.doc[order]
    if len(hs):
        start = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])])
        count = np.diff(np.r_[start, len(hs)])
        out[:, 9] = np.bincount(ds[start], minlength=len(texts)) / n
        top = np.zeros(len(texts))
        np.maximum.at(top, ds[start], count)
        out[:, 10] = top / n
        same = np.r_[(h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1]), False]
        out[:, 11] = per(same)
        out[:, 13] = per(_KIND[w.data[w.end - 1]] == 6)
        out[:, 14] = per(length <= 2)
        out[:, 15] = per(length >= 12)
    if len(h) >= 8:
        g = windows(h, 8)
        inside = w.doc[: len(g)] == w.doc[7:]
        g, gd = g[inside], w.doc[: len(inside)][inside]
        order = np.lexsort((g, gd))
        g, gd = g[order], gd[order]
        if len(g):
            again = np.r_[False, (g[1:] == g[:-1]) & (gd[1:] == gd[:-1])]
            out[:, 12] = np.bincount(gd, weights=again, minlength=len(texts)) / n
    return out


class Model:
    """Lookup tables for features and for pairs of them."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 80, pairs: int = 6, rate: float = 0.15, leaf: float = 1.0):
        self.bins, self.pair_bins, self.rounds, self.n_pairs, self.rate, self.leaf = bins, pair_bins, rounds, pairs, rate, leaf
        self.start, self.edges, self.tables, self.pair_edges, self.pairs = 0.0, [], [], [], {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        if not len(y):
            return self
        mean = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(mean / (1 - mean)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        self.pair_edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.pair_bins + 1)[1:-1])) for c in x.T]
        at = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            for j, b in enumerate(at):
                step = self.rate * self._tree(b, y, f, len(self.tables[j]))
                self.tables[j] += step
                f += step[b]
        coarse = [np.searchsorted(e, c, side="right") for e, c in zip(self.pair_edges, x.T, strict=True)]
        width = self.pair_bins
        gain = {}
        for i in range(x.shape[1]):
            for j in range(i):
                g, h = self._sums(coarse[i] * width + coarse[j], y, f, width * width)
                gain[i, j] = float((g * g / (h + self.leaf)).sum())
        self.pairs = {p: np.zeros(width * width) for p in sorted(gain, key=lambda p: (-gain[p], p))[: self.n_pairs]}
        for _ in range(self.rounds // 2):
            for (i, j), table in self.pairs.items():
                cell = coarse[i] * width + coarse[j]
                g, h = self._sums(cell, y, f, width * width)
                step = self.rate * self._quarters((g.reshape(width, width), h.reshape(width, width))).ravel()
                table += step
                f += step[cell]
        return self

    def _sums(self, b: np.ndarray, y: np.ndarray, f: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return np.bincount(b, weights=y - p, minlength=n), np.bincount(b, weights=p * (1 - p), minlength=n)

    def _cut(self, g: np.ndarray, h: np.ndarray) -> int:
        """Where to split a row of bins in two for most gain."""
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a * a / (b + self.leaf) + (g.sum() - a) ** 2 / (h.sum() - b + self.leaf)
        return int(gain.argmax()) + 1

    def _tree(self, b: np.ndarray, y: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        """A tree of depth two over n bins: what each bin adds."""
        g, h = self._sums(b, y, f, n)
        cuts = {0, n}
        for _ in range(2):
            for a, z in zip(sorted(cuts)[:-1], sorted(cuts)[1:], strict=True):
                if z - a > 1:
                    cuts.add(a + self._cut(g[a:z], h[a:z]))
        out = np.zeros(n)
        for a, z in zip(sorted(cuts)[:-1], sorted(cuts)[1:], strict=True):
            out[a:z] = g[a:z].sum() / (h[a:z].sum() + self.leaf)
        return out

    def _quarters(self, sums: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """A tree that splits one feature of a pair and then, on either side, the other."""
        g, h = sums
        out = np.zeros(g.shape)
        row = self._cut(g.sum(axis=1), h.sum(axis=1))
        for part in (slice(0, row), slice(row, None)):
            column = self._cut(g[part].sum(axis=0), h[part].sum(axis=0))
            for side in (slice(0, column), slice(column, None)):
                out[part, side] = g[part, side].sum() / (h[part, side].sum() + self.leaf)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=False):
            f += t[np.searchsorted(e, c, side="right")]
        for (i, j), t in self.pairs.items():
            f += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right") * self.pair_bins + np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-f))


_FEATURES = [T.StructField("x", T.ArrayType(T.DoubleType()))]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Model:
    """Fit on at most max_rows labelled rows, whose features (16 numbers each) come to the driver."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    # Documents of repeated ids can make them more again.
    row = F.struct(F.xxhash64("_id", "text").alias("h"), F.col("_id").cast("string").alias("i"), "_y")
    rows = map_texts(rows.select(row.alias("_row"), "text"), "_row", "text", lambda: lambda texts: [features(texts).tolist()], _FEATURES)
    got = rows.orderBy("doc_id", "x").limit(max_rows).collect()
    y = np.array([r["doc_id"]["_y"] for r in got])
    return Model().fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    return map_texts(docs, id_col, text_col, lambda: lambda texts: [model.score(features(texts)).tolist()], [T.StructField("score", T.DoubleType())])


def held_out(id_: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
