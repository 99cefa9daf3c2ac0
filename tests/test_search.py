import random
import re

import pytest
from pyspark.sql import functions as F

from tidewrack.operators import tables
from tidewrack.operators.search import Index, _pieces, literal_runs
from tidewrack.operators.store import Store

WORDS = ["the", "Drone", "über", "x1", "jammer", "日本", "contract", "don't", "a_b", "100%", "C:\\d", "😀"]


def texts(n=40):
    r = random.Random(2)
    return {f"u{i}": None if i == 3 else "" if i == 4 else " ".join(r.choice(WORDS) for _ in range(r.randint(1, 15))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame([(k, v, 1, 1, "x") for k, v in docs.items()] + [(None, "the drone", 1, 1, "x")], "url string, text string, tf int, part int, term string")


def terms(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def like(pattern, text):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        i += 1
    return text is not None and re.fullmatch(out, text, re.I | re.S) is not None


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Documents, changed, new and deleted ones, in two indexes of one store; and what there is in the end."""
    store = Store(spark, str(tmp_path_factory.mktemp("search")))
    found = [Index(store, k, "url", k, 8, 2) for k in ("words", "grams")]
    docs = texts()
    more = {"u1": "changed Drone drone", "u90": "quite new über drone", "u7": None}
    for rows, gone in ((docs, None), (more, ["u2", "u5", "none", None])):
        tx = store.begin()
        df = frame(spark, rows)
        tx.create("docs", "url string, text string", ["url"], 8)
        tx.merge("docs", df.where("url IS NOT NULL").select("url", "text"), lambda old, new: tables.upsert(old, new, ["url"]))
        out = None if gone is None else spark.createDataFrame([(x,) for x in gone], "url string")
        if out is not None:
            tx.merge("docs", out, lambda old, x: tables.delete(old, x, "url"))
        for index in found:
            index.refresh(tx, df, deleted=out)
        tx.publish()
    return store, *found, {k: v for k, v in (docs | more).items() if k not in ("u2", "u5")}


def check(words, grams, docs):
    for q in ("drone", "the jammer", "Über the", "nothing here", "x1 x1", ""):
        asked = set(terms(q))
        assert {r.url for r in words.match(q).collect()} == {k for k, v in docs.items() if asked and asked <= set(terms(v))}
    for p in ("%drone%", "%jam%con%", "%DON'T%", "a\\_b%", "%100\\%%", "%ch_ng%", "%_%", "%日本 %", "%C:\\\\d%", "zzz%", "", "%😀 the%"):
        got = grams.ilike(p, "docs").select("url").collect()
        assert {r.url for r in got} == {k for k, v in docs.items() if like(p, v)}, p


def test_searches_equal_scans(indexed):
    store, words, grams, docs = indexed
    check(words, grams, docs)
    n, length = store.read("words.total").first()
    assert (n, length) == (len(docs), sum(len(terms(v)) for v in docs.values()))


def test_ranking(indexed):
    import math

    _, words, _, docs = indexed
    n, mean = len(docs), sum(len(terms(v)) for v in docs.values()) / len(docs)
    want = {}
    for q in ("drone", "jammer"):
        df = sum(q in terms(v) for v in docs.values())
        for k, v in docs.items():
            w = terms(v)
            if q in w:
                tf = w.count(q)
                want[k] = want.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    order = sorted(want, key=lambda k: (-round(want[k], 9), k))
    got = words.search("jammer drone", 7).collect()
    assert [r.url for r in got] == order[:7] and all(abs(r.score - want[r.url]) < 1e-9 for r in got)
    both = words.search("jammer drone", 100, every=True).collect()
    assert {r.url for r in both} == {k for k in want if {"jammer", "drone"} <= set(terms(docs[k]))}


def test_a_search_reads_its_terms_buckets_only(indexed):
    store, words, grams, _ = indexed
    files = [p for t, x in store.manifest(store.head())["tables"].items() if ".postings." in t and t.startswith("words") for p in x["files"].values()]
    read = {p for p in words.match("jammer").inputFiles() if ".postings." in p}
    assert 0 < len({p.rsplit("/", 1)[0] for p in read}) <= 4 < len(files)
    plan = words.match("jammer")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,jammer)]" in plan or "In(term" in plan
    rare = grams.ilike("%quite new%", "docs")
    assert len({p for p in rare.inputFiles() if "/docs/" in p}) == 1 and rare.count() == 1


def test_compacting_changes_nothing_found(indexed):
    store, words, grams, docs = indexed
    tx = store.begin()
    words.compact(tx)
    grams.compact(tx)
    tx.publish()
    assert [t for t in store.manifest(store.head())["tables"] if ".postings." in t] == ["words.postings.3", "grams.postings.3"]
    check(words, grams, docs)


def test_runs_of_patterns():
    assert literal_runs("%ab_c\\%d%") == ["ab", "c%d"] and literal_runs("%_%") == [] and literal_runs("x\\") == ["x\\"]


def test_an_empty_index(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    index = Index(store, "i", "url", buckets=2)
    tx = store.begin()
    index.refresh(tx, frame(spark, {}).limit(0))
    tx.publish()
    assert index.search("drone").count() == 0 and index.match("drone").count() == 0 and index.search("").count() == 0


def test_a_term_is_sent_and_written_once_for_many_documents(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    docs = spark.range(400).select(F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("one two two three four x"), F.col("id") % 7).alias("text"))
    indexes = [Index(store, k, "url", k, 4, 2) for k in ("words", "grams")]
    tx = store.begin()
    for index in indexes:
        index.refresh(tx, docs)
    tx.publish()
    said = "one two two three four x0"
    runs = len({said[i : i + 3] for i in range(len(said) - 2)})
    for index in indexes:
        rows = store.read(f"{index.name}.postings.1")
        assert rows.count() <= 2 * (33 + 1) < 400  # 33 runs of three at most, and the list of all documents, in two parts
        got = index._live(store.manifest(store.head()), None)
        assert got.groupBy("url").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"), F.max("length").alias("length")).select("n", "tf", "length").distinct().collect() == [(5, 6, 6) if index.counted else (runs, runs, runs)]
    assert {r.url for r in indexes[0].match("two x3").collect()} == {f"u{i}" for i in range(400) if i % 7 == 3} == {r.url for r in indexes[1].match("four x3").collect()}
    tx = store.begin()
    with pytest.raises(ValueError, match="aren't by its keys"):
        tx.merge("words.postings.1", store.read("words.postings.1"), lambda old, new: old)


def test_batches_are_cut_and_joined_to_pieces():
    import pyarrow as pa

    r = random.Random(4)
    rows = ["x" * r.choice([0, 1, 3, 50]) for _ in range(500)]
    batches = [pa.RecordBatch.from_pydict({"t": rows[a : a + 37]}) for a in range(0, 500, 37)]
    found = [p["t"].to_pylist() for p in _pieces(iter(batches), "t", 60, 9)]
    assert [x for p in found for x in p] == rows
    assert all(0 < len(p) <= 9 and sum(map(len, p[:-1])) < 60 for p in found) and all(len(p) == 9 or sum(map(len, p)) >= 60 for p in found[:-1])
    assert [len(p) for p in _pieces(iter(batches), None, rows=200)] == [200, 200, 100]


def test_runs_beyond_the_basic_plane(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    docs = {"a": "x😀y😀z", "b": "😀y", "c": "İSTANBUL 𝔘𝔫𝔦", "d": ""}
    index = Index(store, "i", "url", "grams", 2, 2)
    tx = store.begin()
    tx.create("docs", "url string, text string", ["url"], 2)
    tx.put("docs", frame(spark, docs).where("url IS NOT NULL").select("url", "text"))
    index.refresh(tx, frame(spark, docs).where("url IS NOT NULL"))
    tx.publish()
    asked = {"%😀y😀%": {"a"}, "%😀y%": {"a", "b"}, "%stanbul%": {"c"}, "%𝔘𝔫𝔦": {"c"}, "%y😀z%": {"a"}}
    for p, want in asked.items():
        assert {r.url for r in index.ilike(p, "docs").collect()} == want, p
    assert {r.url for r in index.match("X😀Y").collect()} == {"a"}
    assert {r.url: r.length for r in store.read("i.lengths").collect()} == {"a": 3, "b": 0, "c": 11, "d": 0}


def test_blocks_are_short_however_many_documents_have_a_term(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    docs = spark.range(3000).select("id", F.concat(F.lit("same words "), F.col("id") % 7).alias("text"))
    indexes = [Index(store, k, "id", k, 2, 2) for k in ("words", "grams")]
    tx = store.begin()
    for index in indexes:
        index.refresh(tx, docs)
    tx.publish()
    for index, asked in zip(indexes, ("same 3", "words 3"), strict=True):
        rows = store.read(f"{index.name}.postings.1")
        assert rows.agg(F.max(F.size("keys"))).first()[0] <= 256  # Spark reads 4096 rows with their lists at once
        assert rows.where("term IS NULL").agg(F.sum(F.size("keys"))).first()[0] == 3000
        assert sorted(r.id for r in index.match(asked).collect()) == list(range(3, 3000, 7))
    tx = store.begin()
    indexes[0].refresh(tx, docs.where("id = 10"))
    indexes[0].compact(tx)
    tx.publish()
    assert store.read("words.postings.3").agg(F.max(F.size("keys"))).first()[0] <= 256
    assert sorted(r.id for r in indexes[0].match("same 3").collect()) == list(range(3, 3000, 7))
