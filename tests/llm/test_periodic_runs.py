import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewrack.llm import periodic_runs, queries

from . import brute

SCHEMA = "doc_id bigint, text string"


def runs(w, exponent=4, least=6):
    """Every maximal stretch with its smallest period, by trying all of them."""
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda x: (x[0], x[2]))


def rest(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(d, w):
    h = zlib.crc32(str(d).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def texts():
    r = random.Random(4)
    out = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a c", "é x " * 9, "x " * 500, "Up up " * 8, "a\x0bb\fa b a\rb a b"]
    for k in range(60):
        words = ["".join(r.choice("ab") for _ in range(r.randint(1, 2))) for _ in range(r.randint(1, 80))]
        unit = [r.choice("abc") for _ in range(r.randint(1, 6))]
        out.append(" ".join(words + unit * r.randint(2, 7) + words[: r.randint(0, 9)] + ["b"] * r.randint(0, 9)))
    out.append(" ".join("w%d" % (i % 977) for i in range(30_000)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    clashing = ["digest", "k", "of", "found", "runs", "collapsed", "_d", "_g"]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in clashing}).cache()


# With 30 bytes nearly every text is cut into ranges of lags.
@pytest.mark.parametrize("range_bytes", [1 << 16, 30])
def test_runs_equal_the_plain_version(docs, range_bytes):
    if range_bytes == 30:
        docs = docs.where("length(text) < 5000 OR text IS NULL")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in periodic_runs.find(docs, range_bytes=range_bytes).collect()}
    want = {}
    for i, t in enumerate(texts()):
        w = brute.words(t)
        if len(t or "") < 5000 or range_bytes > 30:
            found = runs(w) if len(w) < 5000 else [(0, 30_000, 977)]
            want[i] = (found, rest(w, found), len(w))
    assert got == want


def test_other_limits(docs):
    few = docs.where("length(text) < 200")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.find(few, min_exponent=2, min_length=4).collect()}
    assert got == {i: runs(brute.words(t), 2, 4) for i, t in enumerate(texts()) if t is not None and len(t) < 200}


@pytest.mark.parametrize("range_bytes", [1 << 16, 8])
def test_repeated_and_null_ids(spark, range_bytes):
    rows = [(None, "a " * 9), (None, "a " * 9), (1, "a " * 9), (1, None), (1, "b " * 9), (None, None)]
    got = periodic_runs.find(spark.createDataFrame(rows, SCHEMA), range_bytes=range_bytes).collect()
    assert sorted((str(r.doc_id), r.collapsed, len(r.runs)) for r in got) == sorted((str(d), t[0] if t else "", int(t is not None)) for d, t in rows)
    assert periodic_runs.find(spark.createDataFrame([], SCHEMA), range_bytes=range_bytes).count() == 0


def test_planted_words(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for i in range(300)] + [(None, "a b"), (301, None)]
    got = {x.doc_id: x.text for x in periodic_runs.planted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(brute.words(got[d]) == planted(d, brute.words(t)) for d, t in rows if d is not None) and got[None] == "a b" and got[301] is None
    assert sum(got[d] != t for d, t in rows) > 10


def test_query_columns(spark):
    d = "/root/testdata/sf0.001"
    out = queries.op11_periodic_runs(spark, d)
    assert dict(out.dtypes) == {"doc_id": "bigint"} | dict.fromkeys(["n_runs", "start", "length", "period", "exponent_milli"], "bigint") | dict.fromkeys(["runs_sha256", "collapsed_sha256"], "string")
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in out.collect():
        w = planted(r.doc_id, brute.words(source[r.doc_id]))
        found = runs(w)
        best = min(((-n, s, p) for s, n, p in found), default=None)
        want = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *want)
        assert r.runs_sha256 == brute.sha("".join("%d,%d,%d\n" % x for x in found)) and r.collapsed_sha256 == brute.sha(rest(w, found))
