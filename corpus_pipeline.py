"""A training-data pipeline over documents, made of operators of tidewrack.llm.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written to
the shared folder and read again; the stage before it is then removed. All but
the last return the columns of documents, whatever their names. Rows are judged
by themselves, whatever their ids: a row is told from others by a hash of all
its columns, of 128 bits and with nulls marked, so of rows with one id, or with
none, some can stay and others go. Wholly equal rows are judged alike;
near_duplicates leaves one of them. Null, empty and very short texts fail the
quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import bpe, decontamination, jaccard_join, quality_rules, secrets
from tidewrack.llm.queries import word_bpe
from tidewrack.llm.shared import discard, stored, table


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a hash of all columns, and the name of that column, which docs doesn't have."""
    name = "_row"
    while name.lower() in {x.lower() for x in docs.columns}:
        name += "_"
    cells = [c for x in docs.columns for c in (F.col(f"`{x}`").isNull(), F.col(f"`{x}`"))]
    return docs.withColumn(name, F.struct(*[F.xxhash64(F.lit(k), *cells).alias(f"h{k}") for k in range(2)])), name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group, the document with the least id stays; one without id only where none has one."""
    keyed, row = _keyed(docs)
    named = keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias("_id"), "text")
    first = jaccard_join.join(named, id_col="_id").where("doc_id = component_id").select(F.col("doc_id.row").alias(row))
    return keyed.join(first.distinct(), row, "left_semi").dropDuplicates([row]).drop(row)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a benchmark window go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: a mark takes the place of each secret, and n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: ids, their number, and digests of the ids and of what they decode to."""
    return bpe.digests(docs, word_bpe(), with_ids=True)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("secret_scan", redact_secrets), ("bpe", encode)]

#: SQL can't express these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
