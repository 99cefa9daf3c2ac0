"""Vectorised word kernel shared by the operators of this subpackage.

A batch of texts is read straight from its Arrow buffers and handled as one
byte array, so a million short texts cost as few NumPy calls as one long text.
Words are maximal runs of bytes outside a white-space set; all sets used here
are ASCII, so UTF-8 sequences are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = bytes([0x20, *range(0x09, 0x0E)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 12
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(_U, copy=True)
        x += _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, base, _U), dtype=_U)]) if n > 1 else np.ones(1, _U)


_BYTE = mix(np.arange(256, dtype=_U) + _U(1))
_POW = _powers(_BASE | _U(1), _STEP)
with np.errstate(over="ignore"):
    _HIGH = _powers(_POW[-1] * (_BASE | _U(1)), _STEP)


@dataclass
class Words:
    """Words of a batch: doc is the row in the batch, start and end are byte offsets into data."""

    n_docs: int
    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # per document, index of its first word; one more entry at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def position(self) -> np.ndarray:
        """Index of each word within its document."""
        return np.arange(len(self.doc)) - self.first[self.doc]

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint for each word."""
        if not len(self.start):
            return np.zeros(0, _U)
        length = self.end - self.start
        ends = np.cumsum(length)
        inner = np.arange(ends[-1]) - np.repeat(ends - length, length)
        with np.errstate(over="ignore"):
            value = _BYTE[self.data[np.repeat(self.start, length) + inner]]
            if length.max() <= _STEP:
                value *= _POW[inner]
            else:
                value *= _POW[inner & (_STEP - 1)] * _HIGH[(inner >> 12) & (_STEP - 1)]
            return mix(np.add.reduceat(value, ends - length) + length.astype(_U))


def _table(space: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(space)] = True
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split(texts: pa.Array, lower: bool = False, space: bytes = SPACE) -> Words:
    """Find the words of a string array; nulls count as empty. lower: A-Z become a-z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    _, offsets, raw = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if offsets and n else np.zeros(n + 1, np.int64)
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if lower:
        data = _LOWER[data]
    inside = ~_table(space)[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cuts = at[:-1][at[:-1] < len(data)]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = at[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(at, start, side="right") - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    return Words(n, data, doc, start, end, first)


def windows(hashes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A fingerprint for every run of width consecutive words, whatever its document."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        step = mix(np.array([seed], _U))[0] | _U(1)
        out = np.zeros(n, _U)
        for k in range(width):
            out = out * step + hashes[k : k + n]
    return mix(out)
