import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidewrack.operators import enrich, jobs, tables
from tidewrack.operators.store import Conflict, Store, bucket_of

NOW = dt.datetime(2025, 6, 10)
SOURCES = "id int, name string, country string, scope string, lang string, specialist boolean, website string"


def feeds(spark, n=12):
    item = lambda i: f"<item><title>Drone order {i}</title><link>https://example.com/{i}</link><description>text {i}</description><dc:date>2025-06-{9 - i % 3:02d}T0{i % 10}:00:00Z</dc:date></item>"
    rows = [(s, "<rss>" + "".join(item(i) for i in range(n) if i % 3 == s) + "</rss>") for s in range(3)]
    return spark.createDataFrame(rows, "source_id int, xml string")


def sources(spark):
    return spark.createDataFrame([(i, f"S{i}", None, "global", "en", i == 1, f"https://s{i}.example") for i in range(3)], SOURCES)


def replies(spark):
    rows = [(f"https://example.com/{i}", [["Acme Ltd", "Borg"], ["ACME", "EU"], [], ["Fresh Air", "Mega Fund"], ["Nobody Knows"], ["fresh air gmbh", None]][i % 6], [["AB-9"], [], ["ab9"], ["ZZ 1"], [], ["No Such"]][i % 6]) for i in range(10)]
    return spark.createDataFrame(rows, "url string, companies array<string>, products array<string>")


def verdicts(spark):
    raw = [
        ("company", "Borg", False, None, None, None, None, None, None, None), ("company", "Fresh Air", True, "company", "Fresh Air GmbH", "DE", "https://fresh.example", "startup", None, None),
        ("company", "fresh air gmbh", True, "company", "Fresh Air GmbH", "DE", None, None, None, None), ("company", "Mega Fund", True, "investor", "Mega Fund", "US", None, None, None, None),
        ("product", "ZZ 1", True, None, "ZZ-1", None, None, None, "UAV", "Fresh Air GmbH"), ("product", "No Such", False, None, None, None, None, None, None, None),
    ]
    return enrich.verdict_fields(spark.createDataFrame(raw, "kind string, name string, ok boolean, entity_kind string, canonical string, country string, website string, type string, category string, maker string"))


def recipients(spark):
    return spark.createDataFrame([("a@example.com", []), ("b@example.com", ["none"]), ("c@example.com", None)], "email string, tags array<string>")


def world(spark, folder, kind=Store):
    store = jobs.setup(spark, folder, 4)
    t = dt.datetime(2025, 1, 1)
    tx = store.begin()
    tx.put("companies", spark.createDataFrame([("c1", "Acme", "acme", t), ("c2", "Gone Soon", "gone-soon", t)], "id string, name string, slug string, created_at timestamp").select("id", "name", "slug", *[F.lit(None).cast("string").alias(c) for c in ("hq_country", "website", "publication_status", "confidence", "company_type")], F.array().cast("array<string>").alias("source_urls"), "created_at"))
    tx.put("products", spark.createDataFrame([("p1", "AB 9", "ab-9", t)], "id string, name string, slug string, created_at timestamp").select("id", "name", "slug", *[F.lit(None).cast("string").alias(c) for c in ("hq_country", "website", "publication_status", "confidence", "category")], F.array().cast("array<string>").alias("source_urls"), "created_at"))
    tx.put("tag_resolutions", spark.createDataFrame([("company", "old name", "Old Name", "matched", "c9", "exact", t), ("company", "eu", "EU", "rejected", None, "blocklist", t)], jobs.TABLES["tag_resolutions"][0]))
    tx.publish()
    return kind(spark, folder)


def steps(spark):
    return [
        ("ingest", lambda tx: jobs.ingest(tx, feeds(spark), sources(spark), NOW, replies(spark))),
        ("resolve", lambda tx: jobs.resolve(tx, verdicts(spark), NOW)),
        ("digest", lambda tx: jobs.digest(tx, recipients(spark), NOW + dt.timedelta(hours=1))),
    ]


def content(store):
    return {name: sorted(map(str, store.read(name).collect())) for name in jobs.TABLES}


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    """A store after all jobs, what they reported, and how many writes each made."""
    class Counting(Store):
        writes = 0

        def _write(self, *a):
            Counting.writes += 1
            return super()._write(*a)

    store = world(spark, str(tmp_path_factory.mktemp("jobs")), Counting)
    reports, writes = {}, {}
    for name, body in steps(spark):
        before = Counting.writes
        reports[name] = store.run(name, "1", body)
        writes[name] = Counting.writes - before
    return store, reports, writes


def test_jobs(finished):
    store, reports, _ = finished
    a = {r.url.rsplit("/", 1)[1]: r for r in store.read("articles").collect()}
    assert len(a) == 12 and sum(r["kept"] for r in reports["ingest"]) == 12
    assert all((r.analyzed_at is not None) == (int(k) < 10) for k, r in a.items())
    cache = {(r.kind, r.tag_lc): (r.decision, r.entity_id, r.reason) for r in store.read("tag_resolutions").collect()}
    fresh = next(r for r in store.read("companies").collect() if r.slug == "fresh-air-gmbh")
    zz = next(r for r in store.read("products").collect() if r.name == "ZZ-1")
    assert cache["company", "acme ltd"][:2] == ("matched", "c1") and cache["company", "borg"] == ("rejected", None, "verdict:rejected") and ("company", "old name") not in cache
    assert cache["company", "fresh air"][:2] == cache["company", "fresh air gmbh"][:2] == ("created", fresh.id) and cache["company", "mega fund"] == ("rejected", None, "verdict:investor")
    assert cache["product", "ab9"][:2] == ("matched", "p1") and cache["product", "zz 1"][:2] == ("created", zz.id) and ("company", "nobody knows") not in cache
    assert [r.slug for r in store.read("investors").collect()] == ["mega-fund"] and store.read("product_companies").collect()[0][:2] == (zz.id, fresh.id)
    # Articles 4 mention somebody that nobody decided on; 10 and 11 aren't analysed.
    assert {k for k, r in a.items() if r.entities_resolved_at} == {str(i) for i in range(10)} - {"4"}
    assert {(r.article_id, r.company_id) for r in store.read("article_companies").collect()} >= {(a["0"].id, "c1"), (a["3"].id, fresh.id), (a["5"].id, fresh.id)}
    assert sorted(r.email for r in store.read("outbox").collect()) == ["a@example.com", "c@example.com"] and reports["digest"] == 2


def test_a_published_run_isnt_done_twice(spark, finished):
    store, _, _ = finished
    before, head = content(store), store.head()
    assert all(store.run(name, "1", body) is None for name, body in steps(spark)) and store.head() == head
    # Another run of the same day finds the same articles, decides nothing anew and sends nothing twice.
    for name, body in steps(spark):
        store.run(name, "2", body)
    assert content(store) == before


def test_a_job_that_stops_runs_again(spark, tmp_path, finished):
    """Stopped before its first write, between two, and before the manifest, each job leaves the tables as they were; run again it gives what it gives unstopped."""
    done, _, writes = finished

    class Stopping(Store):
        left = None

        def _write(self, *a):
            if self.left == 0:
                raise OSError("stopped before a write")
            found = super()._write(*a)
            if self.left is not None:
                self.left -= 1
            return found

        def _publish(self, base, state):
            if self.left is not None:
                raise OSError("stopped before the manifest")
            return super()._publish(base, state)

    store = world(spark, str(tmp_path), Stopping)
    for name, body in steps(spark):
        before, head = content(store), store.head()
        for at in (0, 1, writes[name] // 2 if name == "resolve" else writes[name]):
            store.left = at
            with pytest.raises(OSError):
                store.run(name, "1", body)
            assert store.head() == head
        store.left = None
        assert content(store) == before
        store.run(name, "1", body)
    assert content(store) == content(done)
    named = content(store)
    assert store.expire(keep=1, hours=0) > 0 and content(store) == named and store.expire(keep=1, hours=0) == 0


def test_a_dry_run_writes_nothing(spark, tmp_path, finished):
    import os

    store = world(spark, str(tmp_path))
    files = lambda: sorted(os.path.join(d, f) for d, _, fs in os.walk(tmp_path) for f in fs)
    before = files()
    tx = store.begin(dry=True)
    reports = {name: body(tx) for name, body in steps(spark)}
    assert reports == finished[1] and files() == before
    assert {n: sorted(map(str, tx.read(n).collect())) for n in ("companies", "tag_resolutions")} == {n: content(finished[0])[n] for n in ("companies", "tag_resolutions")}
    with pytest.raises(ValueError):
        tx.publish()
    tx.close()


def test_empty_manifests_of_others_are_skipped(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("t", spark.range(3))
    (tmp_path / "manifests" / "2").touch()
    assert store.write("t", spark.range(4)) == 3 and store.read("t").count() == 4 and store.head() == store.version("t") == 3


def test_two_jobs_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("t", spark.range(3), ["id"], 4)
    seen = []

    def body(tx):
        if not seen:  # another job publishes in the middle of this one
            store.merge("t", spark.range(5, 6), lambda o, n: tables.insert_ignore(o, n, ["id"]))
        seen.append(tx.base)
        tx.merge("t", spark.range(9, 10), lambda o, n: tables.insert_ignore(o, n, ["id"]))
        return tx.base

    assert store.run("job", "1", body) == 2 and seen == [1, 2]
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 2, 5, 9]
    late = store.begin()
    store.write("t", spark.range(1))
    late.put("t", spark.range(2))
    with pytest.raises(Conflict):
        late.publish()


def test_a_merge_writes_only_the_buckets_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit(None).cast("string").alias("note"))
    store.write("t", rows, ["k"], 64)
    changes = spark.range(1990, 2010).select(F.col("id").alias("k"), F.lit(-1).cast("bigint").alias("v"))
    touched = {str(r[0]) for r in changes.select(bucket_of(["k"], 64)).distinct().collect()}
    before = store.manifest(store.head())["tables"]["t"]["files"]
    store.merge("t", changes, lambda old, new: tables.upsert(old, new, ["k"]))
    after = store.manifest(store.head())["tables"]["t"]["files"]
    assert {b for b in after if after[b] != before.get(b)} == touched and len(touched) < 25
    want = {k: (2 * k if k < 1990 else -1, None) for k in range(2010)}
    assert {r.k: (r.v, r.note) for r in store.read("t").collect()} == want
    assert {(r.change, r.k, r.v) for r in store.diff("t", 1).collect()} == {("update" if k < 2000 else "insert", k, -1) for k in range(1990, 2010)}
    read = store.diff("t", 1).inputFiles()
    assert {p.split("__bucket=")[1].split("/")[0] for p in read} == touched
    store.merge("t", spark.range(5).select(F.col("id").alias("k")), lambda old, gone: tables.delete(old, gone, "k"))
    assert store.read("t").count() == 2005 and {r.change for r in store.diff("t", 2).collect()} == {"delete"}
    with pytest.raises(ValueError, match="without changes"):
        store.merge("t", spark.range(1).select(F.col("id").alias("k")), lambda old, new: old.withColumn("k", F.col("k") + 1))


def test_sums_follow_random_changes(spark, tmp_path):
    import random

    from tidewrack.operators import aggregates

    r, store, rows = random.Random(7), Store(spark, str(tmp_path)), {}
    schema = "k bigint, g string, h int, v bigint"
    tx = store.begin()
    tx.create("t", schema, ["k"], 8)
    tx.publish()
    for step in range(4):
        new = {k: (r.choice(["a", "b", None]), r.choice([1, None]), r.choice([None, 5, -3])) for k in r.sample(range(60), 15)}
        gone = r.sample(sorted(rows), min(len(rows), 6))
        store.merge("t", spark.createDataFrame([(k, *x) for k, x in new.items()], schema), lambda old, n: tables.upsert(old, n, ["k"]))
        rows |= new
        if gone:
            store.merge("t", spark.createDataFrame([(k,) for k in gone], "k bigint"), lambda old, n: tables.delete(old, n, "k"))
            rows = {k: x for k, x in rows.items() if k not in gone}
        want = {}
        for g, h, v in rows.values():
            n, s = want.get((g, h), (0, 0))
            want[g, h] = (n + 1, s + (v or 0))
        for _ in range(1 + step % 2):  # a repeated refresh adds nothing
            assert {(x.g, x.h): (x.n, x.sum_v) for x in aggregates.refresh(store, "t", "sums", ["g", "h"], ["v"], 4).collect()} == want


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    """A table of two buckets with much more than Spark's advisory size goes to many tasks, and reads back whole."""
    store = Store(spark, str(tmp_path))
    rows = spark.range(0, 200_000, 1, 16).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        store.write("t", rows, ["id"], 2)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)
    files = store.read("t").inputFiles()
    assert len(files) >= 8 and len({f.rsplit("/", 1)[0] for f in files}) == 2
    assert store.read("t").count() == 200_000 and store.read("t").exceptAll(rows).count() == 0


def test_a_digest_sends_all_new_items_in_as_many_letters_as_they_take(spark, tmp_path):
    store = jobs.setup(spark, str(tmp_path), 2)
    fields = [x.split()[0] for x in jobs.ARTICLES.split(", ")]

    def add(numbers):
        rows = [(f"u{i}", ["ukraine"] if i % 2 else [], None if i == 7 else NOW - dt.timedelta(seconds=40 * i), NOW) for i in numbers]
        d = spark.createDataFrame(rows, "url string, tags array<string>, published_at timestamp, scraped_at timestamp")
        tx = store.begin()
        tx.merge("articles", d, lambda old, new: old.unionByName(new, allowMissingColumns=True).select(*fields))
        tx.publish()

    add(range(8))
    to = spark.createDataFrame([("all@example.com", []), ("some@example.com", ["ukraine"]), ("none@example.com", ["maritime"])], "email string, tags array<string>")
    assert store.run("digest", "1", lambda tx: jobs.digest(tx, to, NOW + dt.timedelta(hours=1), most=3)) == 5
    sent = store.read("outbox").orderBy("email", F.desc("n"), "subject").collect()
    urls = [re.findall(r'href="(u\d)"', r.html) for r in sent]
    assert [(r.email, r.n, len(u)) for r, u in zip(sent, urls, strict=True)] == [("all@example.com", 3, 3), ("all@example.com", 3, 3), ("all@example.com", 2, 2), ("some@example.com", 3, 3), ("some@example.com", 1, 1)]
    assert [sorted(u) for u in urls] == [["u0", "u1", "u2"], ["u3", "u4", "u5"], ["u6", "u7"], ["u1", "u3", "u5"], ["u7"]]
    assert len({r.id for r in sent}) == 5 and [r.subject for r in sent[:3]] == ["Daily digest — 3 new items", "Daily digest — 3 new items (2)", "Daily digest — 2 new items (3)"]
    # Another run of the day has one more item, which moves all others on: nobody gets a second letter.
    add([9])
    assert store.run("digest", "2", lambda tx: jobs.digest(tx, to, NOW + dt.timedelta(hours=1), most=3)) == 0
    assert store.read("outbox").count() == 5
