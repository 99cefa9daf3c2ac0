import random
from collections import Counter

from pyspark.sql import functions as F

from tidewrack.operators import resolve


def dice(a, b):
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2.0 * sum((x & y).values()) / (len(a) + len(b) - 2)


def names(r, n, words="acme borg general atomics aero aaa a supplier 000 x9 systems".split()):
    """Names, many of which begin alike, and small alterations of them."""
    out = {"a", "x", "aa", "aaaa aaaa"}
    while len(out) < n:
        w = " ".join(r.choice(words) for _ in range(r.randint(1, 5)))
        out.add(w)
        i = r.randrange(len(w))
        out.add((w[:i] + r.choice("abc01") + w[i + 1 :]).strip())
    return sorted(" ".join(x.split()) for x in out)


def test_prefix_pairs_equal_all_pairs(spark):
    r = random.Random(1)
    a, b = names(r, 150), names(r, 150)
    starts = lambda s, t: s.count(" ") >= 1 and (t + " ").startswith(s + " ")
    want = {(x, y) for x in a for y in b if starts(x, y) and " " in y or starts(y, x) and " " in x}
    got = [tuple(x) for x in resolve.prefix_pairs(spark.createDataFrame([(x,) for x in a], "key string"), spark.createDataFrame([(x,) for x in b], "k string")).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_fuzzy_pairs_equal_all_pairs(spark):
    r = random.Random(2)
    a, b = names(r, 220), names(r, 220)
    left, right = spark.createDataFrame([(x,) for x in a], "key string"), spark.createDataFrame([(x,) for x in b], "k string")
    for least in (0.9, 0.6):
        want = {(x, y): dice(x, y) for x in a for y in b if x.split(" ")[0] == y.split(" ")[0] and dice(x, y) >= least - 1e-12}
        got = {(x.key, x.k): x.d for x in resolve.fuzzy_pairs(left, right, least).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want) and any(x != y for x, y in want)


def test_one_first_word_for_all_names_is_spread(spark):
    """Under one first word, keys meet by many pairs of letters: no key of the join has ten times what a middling one has."""
    keys = spark.range(3000).select(F.concat(F.lit("supplier "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 9)).alias("k"))
    gram = F.transform(F.sequence(F.lit(1), F.length("k") - 1), lambda i: F.substring(F.col("k"), i, F.lit(2)))
    often = keys.select(F.explode(gram).alias("g")).groupBy("g").agg(F.count("*").alias("often"))
    sizes = sorted(r[0] for r in resolve._letter_pairs(keys, "k", often, 0.9).groupBy("_w", "g", "nth").count().select("count").collect())
    assert sizes[-1] <= 10 * sizes[len(sizes) // 2]


def test_numbered_names_meet_few_others(spark):
    """Four times the names under one first word make about four times the pairs to verify, not sixteen times."""
    met = []
    for n in (1500, 6000):
        keys = spark.range(n).select(F.concat(F.lit("customer "), F.lpad(F.col("id").cast("string"), 9, "0")).alias("k"))
        met.append(resolve._met_pairs(keys.withColumnRenamed("k", "key"), keys, 0.9).distinct().count())
    assert met[1] <= 6 * met[0] and met[1] <= 40 * 6000


def test_empty_names(spark):
    none = spark.createDataFrame([], "key string")
    assert resolve.fuzzy_pairs(none, none.toDF("k")).count() == 0 and resolve.prefix_pairs(none, none.toDF("k")).count() == 0
