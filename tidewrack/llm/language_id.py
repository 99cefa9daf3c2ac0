"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that depends on its code point
and the seed alone; everything that isn't a letter counts as one more letter,
the gap. A trigram's vector is the product of its letters' vectors, the first
rotated by two places and the second by one. A text bundles (adds) its
trigrams, a language the unit vectors of its texts. Prototypes are centred on
their mean, which all languages share. A text gets the language whose prototype
has the highest cosine with it.

Only dims numbers a language come to the driver, and no language is left out.
Memory is bounded: a text is read whole, but in stretches. Defined results: a null text, or one without letters, is "und" with
score 0, as is every text if there is nothing to learn from. Ties go to the
smaller name. Rows without a lang are predicted but not learnt from. Repeated
rows are learnt from as often as they come; rows with a null or repeated id are
predicted each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_texts, pieces

_LETTERS: list[np.ndarray] = []
_VECTORS: dict[tuple[int, int, int], np.ndarray] = {}
UNIT = 1 << 20
STRETCH, PART, CELLS = 1 << 19, 1 << 13, 1 << 23


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letter_vector(code: int, dims: int, seed: int) -> np.ndarray:
    key = (code, dims, seed)
    if key not in _VECTORS:
        if len(_VECTORS) > 20_000:
            _VECTORS.clear()
        _VECTORS[key] = np.random.default_rng([seed, code]).integers(0, 2, dims).astype(np.int8) * 2 - 1
    return _VECTORS[key]


def _codes(text: str) -> np.ndarray:
    """Code points of the letters of a lowered text, 0 for all else."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_is_letter()[codes], codes, 0)


def bundles(texts: list[str], dims: int, seed: int) -> np.ndarray:
    """A row for each text: the sum of its trigrams' vectors; zeros if it has no letter.

    Texts are joined, and long ones cut, into stretches of about STRETCH letters;
    in each, PART kinds of trigrams have their vectors at a time.
    """
    out = np.zeros((len(texts), dims), np.float32)
    gap = np.zeros(1, np.uint32)
    some: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    size = 0

    def add() -> None:
        if some:
            _add(out, np.concatenate([*some, gap, gap]), np.concatenate(rows), dims, seed)
        some.clear()
        rows.clear()

    for i, text in enumerate(texts):
        # A gap before a text and one after it; two gaps in a row are no trigram with a letter.
        codes = np.concatenate([gap, gap, _codes(text), gap, gap])
        for a in range(0, max(1, len(codes) - 2), STRETCH):
            part = codes[a : a + STRETCH + 2]
            some.append(part)
            rows.append(np.full(len(part), i if len(part) else -1))
            # The trigrams over the border of two stretches belong to neither.
            rows[-1][-2:] = -1
            size += len(part)
            if size >= STRETCH:
                add()
                size = 0
    add()
    return out


def _add(out: np.ndarray, codes: np.ndarray, doc: np.ndarray, dims: int, seed: int) -> None:
    """Add to each row of out the vectors of the trigrams that start at its places; doc is -1 at places that count for none."""
    seen = np.bincount(codes)
    present = np.flatnonzero(seen)
    small = (np.cumsum(seen > 0) - 1)[codes]
    k = len(present)
    tri = ((small[:-2] * k + small[1:-1]) * k + small[2:])[: len(doc)]
    use = ((codes[:-2] | codes[1:-1] | codes[2:])[: len(doc)] > 0) & (doc >= 0)
    tri, doc = tri[use], doc[use]
    if not len(tri):
        return
    if k**3 <= 1 << 24:
        seen = np.bincount(tri, minlength=k**3) > 0
        kinds, at = np.flatnonzero(seen), (np.cumsum(seen) - 1)[tri]
    else:
        kinds, at = np.unique(tri, return_inverse=True)
    letters = np.stack([letter_vector(int(c), dims, seed) for c in present])
    docs, doc = np.unique(doc, return_inverse=True)
    step = max(1, min(PART, CELLS // len(docs)))
    if len(kinds) > step:
        order = np.argsort(at, kind="stable")
        at, doc = at[order], doc[order]
    for a in range(0, len(kinds), step):
        part = kinds[a : a + step]
        x, y = np.searchsorted(at, [a, a + step]) if len(kinds) > step else (0, len(at))
        vectors = (np.roll(letters[part // (k * k)], 2, axis=1) * np.roll(letters[part // k % k], 1, axis=1) * letters[part % k]).astype(np.float32)
        counts = np.bincount(doc[x:y] * len(part) + (at[x:y] - a), minlength=len(docs) * len(part)).reshape(len(docs), len(part))
        out[docs] += counts.astype(np.float32) @ vectors


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 512, seed: int = 7) -> dict[str, list[float]]:
    """Centred prototypes. Each task adds up its texts in whole numbers, so the sums don't depend on their order."""
    d = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch):
                b = bundles([x or "" for x in piece.column("text").to_pylist()], dims, seed)
                norm = np.linalg.norm(b, axis=1, keepdims=True)
                units = np.rint(b / np.where(norm > 0, norm, 1) * UNIT).astype(np.int64)
                langs = np.array(piece.column("lang").to_pylist(), object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + units[langs == lang].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "sums"])

    parts = d.mapInArrow(run, "lang string, sums array<bigint>")
    whole = parts.select("lang", F.posexplode("sums").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    lists = whole.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v"))
    found = {r["lang"]: np.array([x["v"] for x in r["v"]], np.float64) for r in sorted(lists.collect(), key=lambda r: r["lang"])}
    found = {k: v / np.linalg.norm(v) for k, v in found.items() if np.linalg.norm(v) > 0}
    middle = sum(found.values()) / len(found) if len(found) > 1 else 0.0
    return {k: ((v - middle) / (np.linalg.norm(v - middle) or 1.0)).tolist() for k, v in found.items()}


def predict(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = 512, seed: int = 7) -> DataFrame:
    """doc_id, lang_pred, score for every row; learn says which rows to learn from."""
    known = prototypes(docs.where(learn), text_col, lang_col, dims, seed)
    names = sorted(known)

    def make():
        matrix = np.array([known[n] for n in names], np.float32).reshape(len(names), dims)

        def f(texts: list[str]) -> list[list]:
            b = bundles(texts, dims, seed)
            norm = np.linalg.norm(b, axis=1)
            if not names:
                return [["und"] * len(texts), [0.0] * len(texts)]
            near = (b @ matrix.T) / np.where(norm > 0, norm, 1)[:, None]
            best = near.argmax(axis=1)
            some = [any(map(str.isalpha, x)) for x in texts]
            lang = [names[i] if s else "und" for i, s in zip(best, some, strict=True)]
            score = [float(min(1.0, max(0.0, x))) if s else 0.0 for x, s in zip(near.max(axis=1), some, strict=True)]
            return [lang, score]

        return f

    return map_texts(docs, id_col, text_col, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
