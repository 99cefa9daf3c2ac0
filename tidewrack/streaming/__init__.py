"""Structured Streaming: feeds merged batch by batch, items that weren't seen before, and the work queue's attempts.

State is kept by key in the checkpoint and goes at an age limit, so it doesn't
grow with the past, and a query that stops goes on where it was.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.ingest import gate, ingest, merge, to_rows
from ..operators.store import Store
from ..sources.feeds import parse_feeds

FEED_SCHEMA = "source_id int, fetched_at timestamp, xml string"


def ingest_stream(spark: SparkSession, landing: str, sources: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None, now: Callable[[], dt.datetime] | None = None, days: int = 14):
    """A query that merges each new file of feeds into the store's articles.

    A batch goes through the same steps as ingest(), the age limit too. now gives
    the time of a batch; by default it is the latest fetched_at in it, so a
    repeated batch gives the same rows. Only the buckets of articles that have new
    rows are written, and a batch is published with its number, so that one that
    comes again after a stop is not merged twice. A batch without new rows writes
    nothing.
    """
    feeds = spark.readStream.schema(FEED_SCHEMA).parquet(landing)

    def batch(df: DataFrame, number: int) -> None:
        at = now() if now else df.agg(F.max("fetched_at")).first()[0]
        if at is None:
            return
        rows = ingest(df, sources, at, days)
        if not rows.isEmpty():
            store.run(f"stream {checkpoint}", str(number), lambda tx: tx.merge("articles", rows, lambda old, new: merge(old, new, F.lit(at).cast("timestamp"))))

    return feeds.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counts_stream(events: DataFrame, time: str = "ts", by: str = "event_type", late: str = "14 days", width: str = "1 day") -> DataFrame:
    """Counts in tumbling windows, of rows up to late behind."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def new_items(feeds: DataFrame, sources: DataFrame, days: int = 14, **vocabulary) -> DataFrame:
    """Article rows of a stream of feeds (source_id, fetched_at, xml), each canonical url once within so many days of when it was fetched.

    An item too old for its fetch goes, as in ingest(); urls that were seen are
    state with a timer, and a url that comes again after the limit counts anew.
    """
    limit = f"{days} days"
    items = parse_feeds(feeds).withWatermark("fetched_at", limit)
    items = items.where(F.col("published_at").isNull() | (F.col("published_at") >= F.col("fetched_at") - F.expr(f"INTERVAL {days} DAYS")))
    items = gate(items, sources, **({"terms": vocabulary["terms"]} if "terms" in vocabulary else {})).withColumn("url", U.canonical_url(F.col("url")))
    first = items.dropDuplicatesWithinWatermark(["url"])
    return to_rows(first, **({"themes": vocabulary["themes"]} if "themes" in vocabulary else {}))


ATTEMPTS = "url string, attempt int, due timestamp, event string"


def attempts(events: DataFrame, first_wait: dt.timedelta = dt.timedelta(hours=1), longest_wait: dt.timedelta = dt.timedelta(days=1), days: int = 14) -> DataFrame:
    """What a work queue does about events (url, at, kind: "new", "failed" or "done"): url, attempt, due, event.

    A new url is due at once ("try", attempt 1). After a failure it is due again
    ("try", the next attempt) after a wait that doubles up to the longest; done
    ("done") ends it. A url whose state is so many days old without an end is
    given up ("gave up") once the watermark says so, and its state goes. Events
    of a url that isn't in the queue are dropped, but for "new"; a repeated "new"
    is none. Of events of one time, new comes before failed and done.
    """
    ranks = {"new": 0, "failed": 1, "done": 2}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (url,), out = key, []
        if state.hasTimedOut:
            began, n = state.get
            state.remove()
            yield pd.DataFrame([(url, n, pd.NaT, "gave up")], columns=["url", "attempt", "due", "event"]).astype({"due": "datetime64[ns]"})
            return
        rows = pd.concat(list(frames))
        rows = rows[rows["kind"].isin(list(ranks))].assign(rank=lambda d: d["kind"].map(ranks)).sort_values(["at", "rank"])
        held = state.get if state.exists else None
        for at, kind in zip(rows["at"], rows["kind"], strict=True):
            if kind == "new" and held is None:
                held = (int(at.timestamp() * 1000), 1)
                out.append((url, 1, at, "try"))
            elif kind == "failed" and held is not None:
                wait = min(first_wait * 2 ** min(held[1] - 1, 30), longest_wait)
                held = (held[0], held[1] + 1)
                out.append((url, held[1], at + wait, "try"))
            elif kind == "done" and held is not None:
                out.append((url, held[1], at, "done"))
                held = None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
            state.setTimeoutTimestamp(max(held[0] + days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["url", "attempt", "due", "event"]).astype({"due": "datetime64[ns]"})

    timed = events.where("url IS NOT NULL AND at IS NOT NULL").withWatermark("at", "1 hour")
    return timed.groupBy("url").applyInPandasWithState(step, ATTEMPTS, "began bigint, attempt int", "append", "EventTimeTimeout")
