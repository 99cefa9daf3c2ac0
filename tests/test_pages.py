"""Pages of a feed, whatever its length."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tidewrack.plans import stored


def saved(spark, path, n):
    at = F.timestamp_add("MINUTE", (F.col("id") % 97).cast("int"), F.lit(dt.datetime(2024, 1, 1)))
    spark.range(n).select(F.col("id").alias("event_id"), at.alias("ts")).write.parquet(str(path / "events.parquet"))
    return str(path)


@pytest.mark.parametrize("n", [5, 300, 2000])
def test_pages_of_short_and_long_feeds(spark, tmp_path, monkeypatch, n):
    skipped, offset = [], DataFrame.offset
    monkeypatch.setattr(DataFrame, "offset", lambda self, k: skipped.append(k) or offset(self, k))
    got = [(r.page, r.event_id) for r in stored.feed_pages(spark, saved(spark, tmp_path, n)).collect()]
    order = sorted(range(n), key=lambda i: (i % 50 == 0, -(i % 97) if i % 50 else 0, i))
    assert sorted(got) == sorted([(k, i) for k in (0, 1, 30) for i in order[24 * k : 24 * k + 24]] + [(98, i) for i in order[-10:]])
    assert max(skipped) <= 720, "rows that an offset skips go to the driver"
