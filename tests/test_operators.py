import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import text as X
from tidewrack.operators import enrich, ingest, resolve, serving, tables
from tidewrack.operators.store import Conflict, Store
from tidewrack.sources import config, feeds
from tidewrack.streaming import ingest_stream

NOW = dt.datetime(2025, 6, 10)
RSS = """<rss><channel>
<item><title><![CDATA[Jammer <b>contract</b> at airport]]></title><link>https://www.example.com/a/?utm_source=x&amp;b=2</link><description><![CDATA[<p>A <i>drone</i> order</p>]]></description><pubDate>Mon, 02 Jun 2025 10:00:00 GMT</pubDate><category>Air</category><media:content url="https://example.com/i.jpg"/></item>
<item><title>Cooking</title><link>https://example.com/b</link><description>Soup</description></item>
<item><title>Kyiv swarm</title><link>https://example.com/c</link><content:encoded>drones &lt;img src="https://example.com/c.png"&gt;</content:encoded><dc:date>2025-06-01T00:00:00Z</dc:date></item>
<item><title>No link</title></item></channel></rss>"""
ATOM = """<feed><entry><title>EASA drone regulation</title><link rel="alternate" href="https://example.org/e"/><summary>s</summary><published>2025-06-03T00:00:00Z</published><media:thumbnail url="https://example.org/t.png"/></entry></feed>"""
SOURCES = "id int, name string, country string, scope string, lang string, specialist boolean, website string, rss string"


def sources(spark):
    return spark.createDataFrame([(1, "One", None, "global", "en", False, "https://example.com", "x"), (2, "Two", "PL/CZ", "regional", "en", True, "https://example.org", "y")], SOURCES)


def landed(spark):
    return spark.createDataFrame([(1, RSS), (2, ATOM), (2, RSS), (1, "<rss><item><title>broken"), (2, None)], "source_id int, xml string")


def test_feeds(spark):
    rows = feeds.parse_feeds(landed(spark)).where("source_id = 1").orderBy("item_ord").collect()
    assert [r.title for r in rows] == ["Jammer contract at airport", "Cooking", "Kyiv swarm"]
    assert rows[0].summary == "A drone order" and rows[0].image_url == "https://example.com/i.jpg" and rows[0].categories == ["Air"]
    assert rows[2].image_url == "https://example.com/c.png" and str(rows[2].published_at) == "2025-06-01 00:00:00"
    atom = feeds.parse_feeds(landed(spark)).where("url LIKE '%/e'").first()
    assert (atom.url, atom.image_url) == ("https://example.org/e", "https://example.org/t.png")


def test_ingest_and_upsert(spark, tmp_path):
    rows = ingest.ingest(landed(spark), sources(spark), NOW)
    got = {r.url: r for r in rows.collect()}
    assert set(got) == {"https://example.com/a?b=2", "https://example.com/b", "https://example.com/c", "https://example.org/e"}
    assert got["https://example.com/a?b=2"].source_id == 1 and got["https://example.com/b"].source_id == 2
    assert {"counter-uas", "critical-infra", "contract-intel"} <= set(got["https://example.com/a?b=2"].tags)
    assert "eu-regulatory" in got["https://example.org/e"].tags and "region-pl" in got["https://example.org/e"].tags
    old = spark.createDataFrame([], "id string, url string, url_hash string, title string, summary string, tags array<string>, companies array<string>, products array<string>, published_at timestamp, scraped_at timestamp, analyzed_at timestamp")
    keep = rows.select("url", "url_hash", "title", "summary", "tags", "published_at")
    store = Store(spark, str(tmp_path))
    store.write("articles", old)
    first = store.apply("articles", lambda o: ingest.merge(o, keep, F.lit(NOW)))
    again = store.apply("articles", lambda o: ingest.merge(o, keep, F.lit(NOW + dt.timedelta(1))))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect())) and store.version("articles") == 3
    replies = spark.createDataFrame([("https://example.com/c", ["X"], [])], "url string, companies array<string>, products array<string>")
    done = ingest.analysed(again, replies, F.lit(NOW))
    assert done.where("analyzed_at IS NULL").count() == 3 and tables.work_queue(done, "analyzed_at", serving.newest(), 2).count() == 2


def test_stream(spark, tmp_path):
    landing = str(tmp_path / "in")
    landed(spark).withColumn("fetched_at", F.lit(NOW)).select("source_id", "fetched_at", "xml").write.parquet(landing)
    store = Store(spark, str(tmp_path / "store"))
    store.write("articles", spark.createDataFrame([], "id string, url string, title string, companies array<string>, products array<string>, scraped_at timestamp"), ["url"], 4)
    ingest_stream(spark, landing, sources(spark), store, str(tmp_path / "check")).awaitTermination(60)
    assert store.read("articles").count() == 4


def test_stream_repeats_nothing(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), Store(spark, str(tmp_path / "store"))
    spark.createDataFrame([(1, NOW, "<rss></rss>")], "source_id int, fetched_at timestamp, xml string").write.parquet(landing)
    store.write("articles", spark.createDataFrame([], "id string, url string, title string, companies array<string>, products array<string>, scraped_at timestamp"), ["url"], 4)
    ingest_stream(spark, landing, sources(spark), store, str(tmp_path / "check")).awaitTermination(60)
    assert store.version("articles") == 1


def test_store_survives_a_writer_that_stops(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write("t", spark.range(3))

    class Stopped(Store):
        def _publish(self, base, state):
            raise OSError("stopped between data and manifest")

    with pytest.raises(OSError):
        Stopped(spark, str(tmp_path / "store")).write("t", spark.range(9))
    assert store.version("t") == 1 and store.read("t").count() == 3
    late = store.begin()
    assert store.write("t", spark.range(5)) == 2 and store.read("t").count() == 5 and store.read("t", 1).count() == 3
    late.put("t", spark.range(7))
    with pytest.raises(Conflict):
        late.publish()
    assert store.apply("t", lambda d: d.where("id > 1"), dry=True).count() == 3 and store.version("t") == 2
    with pytest.raises(ValueError):
        store.read("none")


def test_unique_slugs_lose_no_row(spark):
    taken = ["x", *[f"x-{k}" for k in range(2, 52)], "y-3", "z-2", "x-2-2", "w-0", "w-1", "w-02"]
    names = ["x"] * 3 + ["y"] * 4 + ["z", "z", "w", "w", "v", "v", "v-2", "x-2", "x-2"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = [r.slug for r in resolve.unique_slugs(rows, spark.createDataFrame([(t,) for t in taken], "slug string"), "name", ["id"]).orderBy("id").collect()]
    assert got == ["x-52", "x-53", "x-54", "y", "y-2", "y-4", "y-5", "z", "z-3", "w", "w-2", "v", "v-3", "v-2", "x-2-3", "x-2-4"]
    assert resolve.unique_slugs(rows.limit(0), rows.select(F.col("name").alias("slug")), "name", ["id"]).count() == 0


def test_created_products_and_their_makers(spark):
    queue = spark.createDataFrame([("ab 1", "AB 1", ["u"], 1), ("ab1x", "AB1X", [], 2), ("cd 2", "CD 2", [], 3)], "lo string, tag string, urls array<string>, at int")
    verdicts = spark.createDataFrame([("ab 1", True, None, "AB 1", "UAV", "New Co"), ("ab1x", True, None, "ab 1", "Sensor", None), ("cd 2", True, None, "CD 2", "Toaster", "Tern Works")], "name_lc string, ok boolean, entity_kind string, canonical string, category string, maker string").withColumns({c: F.lit(None).cast("string") for c in ("country", "website", "type")})
    out = resolve.apply_verdicts(queue, verdicts, spark.createDataFrame([], "name_lc string, id string, reason string"))
    exact, normed = resolve.company_keys(spark.createDataFrame([(0, "c1", "Tern Works")], "ord int, id string, name string"), spark.createDataFrame([], "ord int, company_id string, alias string"))
    products, makers = resolve.new_products(out, spark.createDataFrame([("ab-1",)], "slug string"), exact, normed, spark.createDataFrame([("c9", "New Co")], "id string, name string"))
    by_name = {r.name: r for r in products.collect()}
    assert {n: (r.slug, r.category) for n, r in by_name.items()} == {"AB 1": ("ab-1-2", "UAV"), "CD 2": ("cd-2", None)}
    assert {(r.product_id, r.company_id) for r in makers.collect()} == {(by_name["AB 1"].id, "c9"), (by_name["CD 2"].id, "c1")}


def test_replies(spark):
    reply = '```json\n{"companies": ["A  b", 5, "a B", null, {"x": 1}, " ", "C"], "products": "none"}\n```'
    d = spark.createDataFrame([(reply,), ("no json",), (None,)], "reply string").select(X.names_in_reply(F.col("reply"), "companies").alias("c"), X.names_in_reply(F.col("reply"), "products").alias("p"))
    assert [(r.c, r.p) for r in d.collect()] == [(["A b", "C"], []), ([], []), ([], [])]
    row = spark.range(1).select(X.article_text(F.lit("t"), F.lit(""), F.lit(None).cast("string")), X.article_text(F.lit(None).cast("string"), F.lit("s"), F.lit("b" * 20), 5)).first()
    assert row[0] == "TITLE: t\nARTICLE:\nt" and row[1] == "SUMMARY: s\nARTICLE:\nbbbbb"


def test_sitemaps_in_sitemaps(spark):
    index = lambda n: f"<sitemapindex><sitemap><loc>u{n}</loc></sitemap></sitemapindex>"
    leaf = "<urlset><url><loc>deep</loc></url></urlset>"
    maps = spark.createDataFrame([(f"u{k}", index(k + 1)) for k in range(1, 8)] + [("u8", leaf), ("loop", index("loop".replace("u", "")))], "url string, xml string")
    seeds = spark.createDataFrame([("w", "u1"), ("w", "loop"), ("v", "u9")], "website string, url string")
    assert [(r.website, r.loc) for r in feeds.crawl_sitemaps(seeds, maps, F.lit(NOW)).collect()] == [("w", "deep")]
    assert feeds.crawl_sitemaps(seeds, maps, F.lit(NOW), max_sitemaps=5).count() == 0


def test_upsert_null_overwrites(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(1, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], {"w": F.lit("d")}).collect())) == [(1, None, "x"), (2, "b", "y"), (3, "c", "d")]
    filled = tables.patch(old.withColumn("v", F.lit("")), new.where("k = 1").withColumn("v", F.lit("z")), ["k"], overwrite=False)
    assert sorted(map(tuple, filled.collect())) == [(1, "z", "x"), (2, "", "y")]


def test_sitemaps(spark):
    index = "<sitemapindex><sitemap><loc>u2</loc><lastmod>2025-06-01</lastmod></sitemap><sitemap><loc>u3</loc><lastmod>2020-01-01</lastmod></sitemap></sitemapindex>"
    leaf = "<urlset><url><loc>p1</loc><lastmod>2025-06-05</lastmod></url><url><loc>p2</loc></url><url><loc>p0</loc><lastmod>2024-01-01</lastmod></url><url><loc>p1</loc></url><url></url></urlset>"
    maps = spark.createDataFrame([("u1", index), ("u2", leaf), ("u3", leaf.replace("p", "q"))], "url string, xml string")
    seeds = spark.createDataFrame([("w", "u1")], "website string, url string")
    got = feeds.crawl_sitemaps(seeds, maps, F.lit(dt.datetime(2025, 5, 1)))
    assert sorted((r.loc, str(r.lastmod)) for r in got.collect()) == [("p1", "2025-06-05 00:00:00"), ("p2", "None")]
    robots = spark.createDataFrame([("https://a.example/", "User-agent: *\nSitemap: https://a.example/s.xml")], "website string, robots string")
    assert [r.url for r in feeds.discover_sitemaps(robots).orderBy("ord").collect()][:2] == ["https://a.example/s.xml", "https://a.example/sitemap.xml"]


def test_meta(spark):
    page = """<meta content="It's here" property="og:title"><meta name='description' content='d &amp; e'><meta property="og:image" content="i"><time datetime="2025-01-02">"""
    r = feeds.extract_meta(spark.createDataFrame([(page,)], "html string")).first()
    assert (r.title, r.summary, r.image_url, str(r.published_at)) == ("It's here", "d & e", "i", "2025-01-02 00:00:00")


def test_digest(spark):
    items = spark.createDataFrame([("a", ["contract-intel", "counter-uas"], NOW), ("b", ["eu-regulatory"], NOW), ("c", ["swarm", "ukraine"], None), ("d", [], NOW)], "url string, tags array<string>, published_at timestamp")
    sections = serving.digest(items)
    assert [(r.label, r.n) for r in sections.orderBy("place").collect()] == [("Counter-UAS", 1), ("EU & regulatory", 1), ("Ukraine / front line", 1), ("Other", 1)]
    wants = [("all", []), ("one", ["contract-intel"]), ("two", ["eu-regulatory", "ukraine"]), ("none", ["maritime"])]
    got = serving.for_recipients(items, spark.createDataFrame(wants, "email string, tags array<string>")).groupBy("email").count().collect()
    assert {r[0]: r[1] for r in got} == {"all": 4, "one": 1, "two": 2}
    full = items.withColumns({"title": F.concat(F.lit("T<"), "url"), "summary": F.when(F.col("url") == "a", "s & s"), "image_url": F.when(F.col("url") == "b", "https://example.com/i"), "source": F.lit("Wire"), "wanted": F.array(F.lit("ukraine"))})
    r = serving.digest_html(full).first()
    assert r.n == 4 and r.html.startswith("<h1>Daily digest</h1><p>4 new items</p><h3>Counter-UAS (1)</h3>") and r.html.endswith('subject=Unsubscribe+">Unsubscribe</a></p>')
    assert [x in r.html for x in ("T&lt;a</a><p>s &amp; s</p>", '<img src="https://example.com/i"><small>Wire · ', "<small>Wire · </small>", "<p>Filtered to your topics: Ukraine / front line.</p>")] == [True] * 4 and r.html.count("<p>s") == 1
    letters = serving.digest_html(full.withColumn("email", F.lit("x@example.com")), "week", ["email"])
    mails = [serving.outbox(letters, "News", dt.date(2025, 6, 9)).first() for _ in range(2)]
    assert mails[0] == mails[1] and mails[0].subject == "News — 4 new items" and "Weekly roundup" in mails[0].html and "Unsubscribe+x%40example.com" in mails[0].html
    assert [x["url"] for x in json.loads(serving.feed_json(items, 3).first().json)] == ["a", "b", "d"]
    assert serving.rss(items.withColumns({"title": F.lit("a<b"), "summary": F.lit("s")}), "T", "https://example.com").first()[0].count("<item>") == 4


def test_search(spark):
    a = spark.createDataFrame([("u1", "100% Rotor", None, ["x"]), ("u2", "other", "a ROTOR here", ["y"]), ("u3", None, None, None)], "url string, title string, summary string, tags array<string>").withColumn("published_at", F.lit(NOW))
    assert [r.url for r in serving.feed_page(a, query="(rotor)").collect()] == ["u2"]
    assert [r.url for r in serving.feed_page(a, query="rotor").collect()] == ["u1", "u2"]
    assert [r.url for r in serving.feed_page(a, tag="y").collect()] == ["u2"]


def test_recipients(spark):
    assert [r.email for r in config.recipients(spark, env_list="a@example.com, b@example.com").collect()] == ["a@example.com", "b@example.com"]
    assert spark.range(1).select(config.valid_email(F.lit("a@b.c")), config.valid_email(F.lit("a b@c.d"))).first() == (True, False)


def test_verdicts_slugs_and_cache(spark):
    queue = spark.createDataFrame([("new co", "New Co", ["u"], 1), ("fund", "Fund", [], 2), ("bad", "Bad", [], 3), ("later", "Later", [], 4), ("newco", "NewCo", [], 5)], "lo string, tag string, urls array<string>, at int")
    raw = [("company", "New Co", True, "company", "New Co"), ("company", "newco", True, "company", "New Co"), ("company", "Fund", True, "investor", "Fund One"), ("company", "Bad", False, None, None)]
    replies = spark.createDataFrame([(*r, None, "ftp://x", "prime", None, None) for r in raw], "kind string, name string, ok boolean, entity_kind string, canonical string, country string, website string, type string, category string, maker string")
    none = spark.createDataFrame([], "name_lc string, id string, reason string")
    out = resolve.apply_verdicts(queue, enrich.verdict_fields(replies), none)
    assert {r.lo: r.outcome for r in out.collect()} == {"new co": "created", "newco": "created", "fund": "side", "bad": "rejected", "later": "undecided"}
    rows, aliases = resolve.new_companies(out, spark.createDataFrame([("new-co",)], "slug string"))
    assert [(r.name, r.slug, r.website) for r in rows.collect()] == [("New Co", "new-co-2", None)] and [a.alias for a in aliases.collect()] == ["NewCo"]
    assert [r.slug for r in resolve.side_rows(out, "investor").collect()] == ["fund-one"]
    cache = spark.createDataFrame([("company", "a", "matched", "e1"), ("company", "b", "created", "gone"), ("company", "c", "rejected", None)], "kind string, tag string, decision string, entity_id string")
    keep, gone = resolve.heal_cache(cache, spark.createDataFrame([("company", "e1")], "kind string, id string"))
    assert sorted(r.tag for r in keep.collect()) == ["a", "c"] and [r.tag for r in gone.collect()] == ["b"]


def test_products_and_makers(spark):
    p = spark.createDataFrame([(0, "p0", "AB-9 Name"), (1, "p1", "Model 91"), (2, "p2", "!!!")], "ord int, id string, name string")
    tags = spark.createDataFrame([(x.lower(), x) for x in ("ab9name", "Model 92", "???", "model 91")], "lo string, tag string")
    assert {r.lo: (r.id, r.reason) for r in resolve.match_products(tags, p).collect()} == {"ab9name": ("p0", "normalized"), "model 91": ("p1", "exact")}


def test_profiles(spark):
    good = {"description": " d ", "company_type": "Tier-1", "ownership": "Listed", "founded_year": "1999", "is_public": True, "latitude": 91, "longitude": -10.5, "linkedin_url": "https://x.example/y", "employee_count": 12.7, "employee_range": "1,001 - 5000", "revenue_currency": "usd", "total_funding": "-1", "risk_flags": ["a", 1, "a", " "], "overview": 5}
    rows = spark.createDataFrame([(1, json.dumps(good)), (2, "{bad"), (3, "{}"), (4, None)], "company_id int, json string")
    got = {r.company_id: r for r in enrich.profiles(rows, this_year=2025).collect()}
    r = got[1]
    assert (r.description, r.company_type, r.ownership, r.founded_year, r.is_public, r.latitude, r.longitude) == ("d", "tier1", "public", 1999, True, None, -10.5)
    assert (r.linkedin_url, r.employee_count, r.employee_range, r.revenue_currency, r.total_funding, r.risk_flags, r.overview) == ("https://x.example/y", 12, "1001-5000", "USD", None, ["a"], None)
    assert all(v is None for k in (2, 3, 4) for v in got[k][1:])


def test_facts(spark):
    c = [("Q1", "P1128", 0, "+40", "1", "+2019-01-01T00:00:00Z"), ("Q1", "P1128", 1, "+60", "1", "+2020-01-01T00:00:00Z"), ("Q1", "P2139", 0, "+5.5", "http://kb/Q4916", None), ("Q1", "P2226", 0, "+9", "http://kb/Q1", None), ("Q1", "P571", 0, "+1990-00-00T00:00:00Z", None, None)]
    r = enrich.facts(spark.createDataFrame(c, "qid string, property string, pos int, value string, unit string, time string")).first()
    assert (r.employee_count, r.employee_range, r.revenue_amount, r.revenue_currency, r.valuation, r.founded_year) == (60, "51-200", 5.5, "EUR", None, 1990)
