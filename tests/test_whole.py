"""Queries and operators do the whole job: nothing is left out for size."""

from tidewrack.plans import queries as plans

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def saved(spark, path, texts):
    spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], SCHEMA).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_usable_bodies_keep_long_texts(spark, tmp_path):
    d = saved(spark, tmp_path, ["a" * 199, "b" * 200, "c" * 261, "d" * 5000])
    got = {r.doc_id: (r.text, r.lang) for r in plans.usable_bodies(spark, d).collect()}
    assert got == {1: ("b" * 200, "en"), 2: ("c" * 261, "en"), 3: ("d" * 5000, "en")}


def test_feed_search_reads_whole_texts(spark, tmp_path):
    texts = ["x" * 55 + "station there" + "y" * 10, "z" * 900 + " nation that", "station there", "w" * 400]
    got = [r.doc_id for r in plans.feed_search(spark, saved(spark, tmp_path, texts)).collect()]
    assert got == [1, 0, 2]
