"""Pages of a long feed by cursor instead of offset.

A feed is written in its own order, newest first, into files that each hold a
range of it; a small index says the first row, the last row and the number of
rows of each file. A page begins behind a cursor, the (time, key) of the last
row seen, so it reads the file that the cursor is in and as many of the next
ones as the page needs, however deep in the feed it is. Rows that are added
later don't shift pages.

Defined results: rows without a time come last, ordered by key like rows of one
time; keys tell rows apart and aren't null; without a cursor the feed begins at
its top; behind the last row a page is empty.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Cursor = tuple[dt.datetime | None, object]


class Feed:
    """A feed in a folder that driver and executors share; the index has a row for each file and is read where it is needed."""

    def __init__(self, spark: SparkSession, folder: str, time: str = "published_at", key: str = "url"):
        self.spark, self.folder, self.time, self.key = spark, folder.rstrip("/"), time, key

    def _order(self) -> list[Column]:
        return [F.desc_nulls_last(self.time), F.asc(self.key)]

    def write(self, rows: DataFrame, files: int) -> None:
        """Write the feed into about so many files: some 128 MB each are good."""
        rows.repartitionByRange(files, *self._order()).sortWithinPartitions(*self._order()).write.parquet(f"{self.folder}/rows")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/rows").select(self.time, self.key, F.col("_metadata.file_path").alias("_file"))
        # Newest first: the time's distance from the end of time, then the key.
        place = F.struct(F.col(self.time).isNull().alias("undated"), (-F.unix_micros(F.coalesce(F.col(self.time).cast("timestamp"), F.timestamp_micros(F.lit(0))))).alias("back"), F.col(self.key).alias("key"))
        index = written.groupBy("_file").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
        index.coalesce(1).write.parquet(f"{self.folder}/index")
        self.spark.createDataFrame([(rows.schema.json(),)], "schema string").coalesce(1).write.text(f"{self.folder}/schema")

    def _behind(self, after: Cursor) -> Column:
        time, key = after
        later = F.col(self.key) > F.lit(key)
        if time is None:
            return F.col(self.time).isNull() & later
        at = F.lit(time)
        return F.col(self.time).isNull() | (F.col(self.time) < at) | ((F.col(self.time) == at) & later)

    def page(self, after: Cursor | None = None, size: int = 24) -> DataFrame:
        """The size rows behind a cursor, in order."""
        schema = T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.folder}/schema").first()[0]))
        index = self.spark.read.parquet(f"{self.folder}/index")
        if after is not None:
            time, key = after
            back = F.lit(0).cast("bigint") if time is None else -F.unix_micros(F.lit(time).cast("timestamp"))
            at = F.struct(F.lit(time is None).alias("undated"), back.alias("back"), F.lit(key).alias("key"))
            index = index.where(F.col("last") > at)
        # One file may begin before the cursor; what is behind it in that file is not counted, so one more file than needed can be read.
        files, have = [], 0
        for k, r in enumerate(index.orderBy("last").select("_file", "n").limit(size + 1).toLocalIterator()):
            files.append(r["_file"])
            have += r["n"] if k or after is None else 0
            if have >= size:
                break
        rows = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        rows = rows.where(self._behind(after)) if after is not None else rows
        return rows.orderBy(*self._order()).limit(size)

    def cursor(self, page: DataFrame) -> Cursor | None:
        """The cursor behind a page, None behind an empty one."""
        last = page.orderBy(F.asc_nulls_first(self.time), F.desc(self.key)).select(self.time, self.key).first()
        return tuple(last) if last else None
