"""Configuration as frames: sources, recipients, and landed payloads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_SCHEMA = "id int, name string, country string, scope string, lang string, specialist boolean, website string, rss string"


def read_sources(spark: SparkSession, path: str, need: str = "rss", only: list[int] | None = None) -> DataFrame:
    """Sources of a JSON file {"sources": [...]} that have the needed column, of those ids if any are given."""
    d = spark.read.schema(f"sources array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in SOURCE_SCHEMA.split(','))}>>").option("multiLine", True).json(path)
    d = d.select(F.explode("sources").alias("s")).select("s.*").where(F.col(need).isNotNull())
    return d.where(F.col("id").isin(only)) if only else d


def recipients(spark: SparkSession, file_json: str | None = None, env_json: str | None = None, env_list: str | None = None) -> DataFrame:
    """ord, email, tags by the first of the three that is given; entries are addresses or {"email", "tags"}."""
    entries = json.loads(file_json) if file_json else json.loads(env_json) if env_json else [x for x in (env_list or "").split(",")]
    entries = entries.get("recipients", []) if isinstance(entries, dict) else entries
    rows = [(x, []) if isinstance(x, str) else (x.get("email"), x.get("tags") or []) for x in entries]
    return spark.createDataFrame([(i, e.strip(), t) for i, (e, t) in enumerate(rows) if e and e.strip()], "ord int, email string, tags array<string>")


def with_signups(base: DataFrame, signups: DataFrame) -> DataFrame:
    """Base recipients as they are, then sign-ups with new addresses, the first of each, for everything."""
    from pyspark.sql.window import Window

    key = F.lower("email")
    new = signups.where("email IS NOT NULL").withColumn("_k", key).join(base.select(key.alias("_k")), "_k", "left_anti")
    new = new.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(F.asc_nulls_last("created_at"), "email"))).where("_r = 1")
    return base.select("email", "tags").unionByName(new.select("email", F.array().cast("array<string>").alias("tags")))


def valid_email(email):
    return F.coalesce(email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))
