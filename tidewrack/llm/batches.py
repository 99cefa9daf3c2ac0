"""Running a function over whole texts, in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 2 << 20


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most so many rows whose texts have about most bytes; a longer text stands alone and whole."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for x in range(a, b, rows):
            yield batch.slice(x, min(rows, b - x))


def id_field(docs: DataFrame, id_col: str, name: str = "doc_id") -> T.StructField:
    return T.StructField(name, docs.schema[id_col].dataType, True)


def map_texts(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable], fields: list[T.StructField], extra: tuple[str, ...] = ()) -> DataFrame:
    """For each document, id and what a function made once in each task returns: lists or arrays, one for each field.

    The function gets the list of texts, null as "", and the extra columns as lists.
    """
    schema = T.StructType([id_field(docs, id_col), *fields])
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(x) for x in extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        f = make()
        for batch in batches:
            for piece in pieces(batch):
                got = f([x or "" for x in piece.column("text").to_pylist()], *[piece.column(x).to_pylist() for x in extra])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(to.field(0).type), *[pa.array(x, k.type) for x, k in zip(got, list(to)[1:], strict=True)]], schema=to)

    return d.mapInArrow(run, schema)
