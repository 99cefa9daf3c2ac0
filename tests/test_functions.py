import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import classify as C
from tidewrack.functions import names as N
from tidewrack.functions import text as X
from tidewrack.functions import urls as U
from tidewrack.functions import vocab


def on(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_vocabulary_sizes():
    assert len(vocab.GATE_TERMS) == 45
    assert [len(w) for w in vocab.THEMES.values()] == [18, 13, 14, 15, 17, 7, 2, 5]
    assert (len(vocab.COMPANY_SUFFIXES), len(vocab.BLOCKLIST), len(vocab.CUT_MARKERS), len(vocab.PROFILE_FIELDS)) == (36, 21, 30, 35)
    assert (len(vocab.OWNERSHIP_WORDS), len(vocab.COMPANY_TYPE_WORDS), len(vocab.CURRENCIES), len(vocab.ORG_TYPES)) == (28, 25, 13, 15)


def test_canonical_url(spark):
    got = on(spark, U.canonical_url, ["https://www.Example.com/a/?utm_source=x&b=2#frag", "HTTP://example.com:80", "http://example.com:8080/p//?z=1&a=%20&refer=1", "not a url ", "https://example.com/?b=2&a=1&a=0"])
    assert got == ["https://example.com/a?b=2", "http://example.com/", "http://example.com:8080/p?a=+&z=1", "not a url", "https://example.com/?a=1&a=0&b=2"]
    assert on(spark, U.canonical_url, got) == got


def test_entities_and_markup(spark):
    assert on(spark, X.decode_entities, ["&amp;lt; &#65;&#x1F600; &nope; & &hellip;", "&#x110000;", None]) == ["&lt; A😀 &nope; & …", "&#x110000;", None]
    assert on(spark, X.strip_html, ["<![CDATA[<b>a</b>  b]]>", "&lt;i&gt;x&lt;/i&gt;<script>no()</script>", None]) == ["a b", "<i>x</i>", ""]


def test_clip(spark):
    got = on(spark, lambda c: X.clip(c, 12), ["one two three four five", "short", "", None])
    assert got == ["one two…", "short", "", ""]
    assert on(spark, lambda c: F.length(X.clip(c, 5)), ["abcdefghij", "a b c d e f"]) == [5, 4]


def test_dates(spark):
    got = on(spark, X.parse_date, ["Mon, 02 Jun 2025 10:00:00 +0200", "2025-05-20T01:02:03Z", "02 Jun 2025 10:00:00 GMT", "yesterday", None])
    assert got == [dt.datetime(2025, 6, 2, 8), dt.datetime(2025, 5, 20, 1, 2, 3), dt.datetime(2025, 6, 2, 10), None, None]


def test_html_to_text(spark):
    page = "<nav>menu</nav><main><p>Story one.</p><div class='related'>x</div><ul><li><a>1</a><a>2</a><a>3</a></ul><p>Two &amp; three</p></main><footer>f</footer>"
    long = "<article><p>" + "word " * 100 + "</p><p>Related stories</p><p>gone</p></article>"
    assert on(spark, X.html_to_text, [page, long, None]) == ["Story one.\nTwo & three", ("word " * 100).strip(), ""]


def test_lists_and_json(spark):
    d = spark.createDataFrame([(["A  b", "a B", None, " ", "c" * 90],)], "v array<string>")
    assert d.select(X.clean_list(F.col("v"))).first()[0] == ["A b", "c" * 80]
    got = on(spark, lambda c: F.to_json(X.json_in_text(c)), ['```json\n{"a": 1}\n```', 'so {"b": [2]} it is', "no"])
    assert got == ['{"a":1}', '{"b":[2]}', None]


def test_gate_and_tags(spark):
    d = spark.createDataFrame([("New drone jammer at airport; contract awarded", ["Air Defence!"], "regional", "PL/CZ", False), ("Persuasion", None, "global", None, False), ("Cooking", None, "global", None, True)], "t string, c array<string>, s string, k string, sp boolean")
    rows = d.select(C.is_relevant(F.col("t"), F.col("sp")), C.tag_item(F.col("t"), F.col("c"), F.col("s"), F.col("k"))).collect()
    assert [r[0] for r in rows] == [True, True, True]
    assert rows[0][1] == ["counter-uas", "critical-infra", "contract-intel", "air-defence", "region-pl"]
    assert on(spark, lambda c: C.primary_theme(c), [["swarm", "ukraine"], [], None], "array<string>") == ["ukraine", "other", "other"]


def test_names(spark):
    assert on(spark, N.norm_company, ["Norrvik Systems Group, Inc.", "Systems", "A & B Ltd", "Éclat S.A.", "Łódź"]) == ["norrvik", "systems", "a and b", "eclat", "odz"]
    assert on(spark, N.norm_product, ["AB-9 Name", "!!!"]) == ["ab9name", None]
    assert on(spark, N.slugify, ["Éclat Robotique", "!!!"]) == ["eclat-robotique", "x"]
    d = spark.createDataFrame([("night", "nacht"), ("aaaa", "aaa"), ("a", "b"), ("x", "x")], "a string, b string")
    assert [round(r[0], 2) for r in d.select(N.dice(F.col("a"), F.col("b"))).collect()] == [0.25, 0.8, 0.0, 1.0]


@pytest.mark.parametrize(("url", "site", "ok"), [("https://a.example/2024/some-story", "https://a.example", True), ("https://a.example/tag-heuer-story", "https://a.example", False), ("https://www.a.example/some-story", "https://a.example", False), ("https://a.example/file-name.pdf", "https://a.example", False), ("https://a.example/abc", "https://a.example", False)])
def test_article_urls(spark, url, site, ok):
    assert spark.range(1).select(U.looks_like_article(F.lit(url), F.lit(site))).first()[0] is ok


def test_blocklist(spark):
    assert on(spark, C.is_blocklisted, ["Royal Navy", "Navytech", None]) == [True, False, False]


def test_html_to_text_odd_pages(spark):
    pages = {
        '<div class="share"><script>"</div>"</script>x</div>y': "y", "<main>a<article>b</article>": "b", "<ARTICLE>a</ARTICLE><main>m</main> z": "m",
        '<ul><li><a href="1">a</a><li><a>b</a></ul>': "a b", "<ul><a>1</a><a>2</a><a>3</a></ul>t": "t", '<ul><li><div id="popular-now">p</div>q</li></ul>': "q",
        '<section class="x related y"><div>i</div></section>k<div class="story">s</div>': "k s", "a < b": "a < b", "": "", "<p>x</p><br/><p>y</p>": "x\ny",
        "<main>one</main><main>two</main>": "one", '<div class="menu">never closed': "never closed", "<nav>n<p>z</p></NAV>&amp;lt;": "&lt;",
    }
    assert on(spark, X.html_to_text, list(pages)) == list(pages.values())
