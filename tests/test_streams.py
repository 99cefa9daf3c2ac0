import datetime as dt

from pyspark.sql import functions as F

from tidewrack.streaming import attempts, new_items

T0 = dt.datetime(2025, 6, 10)
SOURCES = "id int, name string, country string, scope string, lang string, specialist boolean, website string"


def run(df, folder, sink):
    """Everything there is now, then stop; a later call goes on from the checkpoint."""
    df.writeStream.format("parquet").option("path", f"{folder}/{sink}").option("checkpointLocation", f"{folder}/{sink}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_items_are_new_once_over_restarts(spark, tmp_path):
    folder = str(tmp_path)
    schema = "source_id int, fetched_at timestamp, xml string"
    sources = spark.createDataFrame([(1, "A", None, "global", "en", True, "https://a.example")], SOURCES)
    item = lambda *ids: "<rss>" + "".join(f"<item><title>t{i}</title><link>https://example.com/{i}?utm_source=x</link></item>" for i in ids) + "</rss>"
    at = lambda days: T0 + dt.timedelta(days=days)

    def step(*rows):
        land(spark, folder, [(1, t, x) for t, x in rows], schema)
        run(new_items(spark.readStream.schema(schema).parquet(f"{folder}/in"), sources), folder, "out")
        return sorted(r.url.rsplit("/", 1)[1] for r in spark.read.parquet(f"{folder}/out").collect())

    assert step((at(0), item(1, 2)), (at(0), item(2, 3))) == ["1", "2", "3"]
    assert step((at(1), item(1, 4))) == ["1", "2", "3", "4"]
    assert step((at(40), item(5))) == ["1", "2", "3", "4", "5"]
    # By now the state of 1 and 4 has gone, and 5 is still known.
    assert step((at(41), item(1, 5))) == ["1", "1", "2", "3", "4", "5"]


def test_attempts_back_off_over_restarts(spark, tmp_path):
    folder, schema = str(tmp_path), "url string, at timestamp, kind string"
    at = lambda hours: T0 + dt.timedelta(hours=hours)

    def step(*rows):
        land(spark, folder, rows, schema)
        run(attempts(spark.readStream.schema(schema).parquet(f"{folder}/in"), days=14), folder, "out")
        return {(r.url, r.attempt, r.due, r.event) for r in spark.read.parquet(f"{folder}/out").collect()}

    one = step(("a", at(0), "new"), ("a", at(1), "failed"), ("b", at(0), "new"), ("c", at(0), "failed"), (None, at(0), "new"), ("d", at(0), "odd"))
    assert one == {("a", 1, at(0), "try"), ("a", 2, at(2), "try"), ("b", 1, at(0), "try")}
    two = step(("a", at(3), "failed"), ("b", at(3), "new"), ("b", at(4), "done"), ("b", at(5), "failed")) - one
    assert two == {("a", 3, at(5), "try"), ("b", 1, at(4), "done")}
    three = step(*[("a", at(10 + k), "failed") for k in range(8)]) - one - two
    assert max(r[2] - at(17) for r in three) == dt.timedelta(days=1) and max(r[1] for r in three) == 11
    # Fifteen days on the url is given up, and counts as new if it comes again.
    assert ("a", 11, None, "gave up") in step(("x", at(24 * 16), "new"))
    late = at(24 * 16 + 1)
    four = step(("x", late, "done"), ("a", late, "failed"), ("a", late, "new")) - one - two - three
    assert {r for r in four if r[0] == "a"} == {("a", 11, None, "gave up"), ("a", 1, late, "try"), ("a", 2, late + dt.timedelta(hours=1), "try")}
    assert ("x", 1, at(24 * 16 + 1), "done") in four
