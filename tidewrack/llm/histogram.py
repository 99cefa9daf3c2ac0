"""Counts over all rows for a fixed number of cells that hashes fall in: what is frequent, in memory that doesn't grow.

Each task adds up its own histogram and gives it as a few compressed rows; their
sum, 8 bytes a cell, comes to the driver. Nothing counted is left out: two
hashes in one cell count for each other. Defined results: without rows all
counts are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, PARTS = 20, 64
SCHEMA = "cell int, counts binary"


def cells(hashes: np.ndarray, of_bits: int = 64) -> np.ndarray:
    """The cell of each hash of so many bits: its highest ones."""
    return (hashes >> np.uint64(of_bits - BITS)).astype(np.int64)


def empty(n: int = 1) -> np.ndarray:
    """n histograms, one after another."""
    return np.zeros(n << BITS, np.int64)


def add(counts: np.ndarray, at: np.ndarray) -> None:
    counts += np.bincount(at, minlength=len(counts))


def packed(counts: np.ndarray) -> pa.RecordBatch:
    codec = pa.Codec("zstd", 1)
    rows = [codec.compress(x.tobytes(), asbytes=True) for x in counts.reshape(-1, (1 << BITS) // PARTS)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["cell", "counts"])


def _summed(batches):
    codec, per = pa.Codec("zstd", 1), (1 << BITS) // PARTS
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, z in zip(batch.column("cell").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[cell] = sums.get(cell, 0) + np.frombuffer(codec.decompress(z, 8 * per, asbytes=True), np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["cell", "counts"])


def total(rows: DataFrame, n: int = 1) -> np.ndarray:
    """The sum of the tasks' n histograms, of rows as packed() gives them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.where(F.col("cell").isNotNull()).select("cell", "counts").repartition(min(parts, PARTS), "cell").mapInArrow(_summed, SCHEMA).collect()
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(sums, key=lambda r: r["cell"])]) if sums else empty(n)
