import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.llm import collocations, queries

from . import brute

SCHEMA = "doc_id bigint, text string, lang string"


def counted(rows, most=3):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    return f, n


def mined(rows, most=3, least=10, share=50, top=2000):
    f, n = counted(rows, most)
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [b for (x, q), b in f.items() if x == lang and len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= share * a for b in longer):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    rank, rows = Counter(), []
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return rows


def corpus(seed=3):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "é", "日本", "x", "_", "a.b", "New", "york", "city"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "  ", "\xa0"]) for _ in range(r.randint(0, 60))), r.choice(["en", "fr", "", None, "a b"])) for i in range(60)]
    rows += [(70, None, "en"), (70, None, None), (None, "", "en"), (None, "new york city " * 30, "en"), (None, "new york city " * 30, "en"), (71, "the " * 500, "fr"), (72, "one-off words only", "zz"), (73, "a b c d e " * 12, "de")]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit(c) for c in ("phrase", "count", "a", "l", "r", "k", "words", "score", "over", "rank")})


# A filter of 256 bits lets nearly everything pass; shards of 100 bytes hold a text each.
@pytest.mark.parametrize("most, least, share, shard_bytes, bits", [(3, 10, 50, 8 << 20, 27), (3, 10, 50, 100, 9), (4, 3, 60, 2000, 27), (2, 1, 50, 1 << 20, 12), (5, 5, 100, 1 << 20, 16)])
def test_mining_equals_the_plain_version(spark, most, least, share, shard_bytes, bits):
    rows = corpus()
    got = collocations.mine(frame(spark, rows), most, least, share, shard_bytes=shard_bytes, filter_bits=bits)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == sorted(mined(rows, most, least, share))


def test_first_phrases_and_empty_tables(spark):
    rows = corpus(9)
    got = collocations.mine(frame(spark, rows), top=2).collect()
    assert sorted(tuple(r) for r in got) == sorted(mined(rows, top=2))
    assert collocations.mine(frame(spark, rows).limit(0)).count() == 0
    assert collocations.mine(frame(spark, [(1, "a b", "en"), (2, None, None)])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9 * 10**14 + 7
    levels = [spark.createDataFrame([("en", "a", big + 5), ("en", "b", big + 11), ("en", None, 10**15)], collocations.COUNTED), spark.createDataFrame([("en", "a b", big)], collocations.COUNTED)]
    assert collocations._scored(levels).collect()[0].score == 1000000 * big * big // ((big + 5) * (big + 11))


def test_suffix_array_sorts_by_the_first_words():
    r = random.Random(1)
    for depth in (1, 2, 3, 4, 5, 7):
        ids = np.array([r.randrange(4) for _ in range(300)], np.int64)
        piece = np.sort(np.array([r.randrange(20) for _ in range(300)]))
        at = np.array([i for i in range(300) if i + depth <= 300 and piece[i] == piece[i + depth - 1]])
        order, same = collocations.suffix_array(ids, piece, depth, at)
        key = [tuple(ids[i : i + depth]) for i in order]
        assert key == sorted(key) and sorted(order) == at.tolist()
        assert same.tolist() == [False, *(a == b for a, b in zip(key, key[1:]))][: len(key)]


def test_filter_passes_every_key(spark):
    rows = [("en", f"w{i} x{i % 7}", 1) for i in range(5000)]
    for most in (27, 10):
        f = collocations.bloom(spark.createDataFrame(rows, collocations.COUNTED), 2, most)
        import pyarrow as pa

        words = lambda k, a, b: collocations._word_hashes(pa.array([k(i) for i in range(a, b)]))
        lang = collocations._lang_hashes(pa.array(["en"]))
        h = lambda a, b: collocations._combined([words(lambda i: f"w{i}", a, b), words(lambda i: f"x{i % 7}", a, b)], np.repeat(lang, b - a))
        assert f.has(h(0, 5000)).all()
        assert most == 10 or f.has(h(5000, 15000)).mean() < 0.03


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect()]
    f, _ = counted(rows)
    got = queries.op13_collocations(spark, d).collect()
    assert got and all(f[r.lang, tuple(r.phrase.split(" "))] == r.a >= 10 for r in got)
