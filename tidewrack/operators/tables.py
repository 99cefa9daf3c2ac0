"""Changes of keyed tables as functions from frame to frame; operators.store applies them to stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. Only the key and the order decide, whatever the partitions."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Supplied columns of matched rows are overwritten, by nulls too; columns not supplied stay, or take defaults in new rows. New keys must be unique."""
    defaults = defaults or {}
    o = old.select(*[F.col(c).alias(f"_o_{c}") for c in old.columns], F.lit(True).alias("_old"))
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns], F.lit(True).alias("_new"))
    on = reduce(lambda a, b: a & b, [F.col(f"_o_{k}") == F.col(f"_n_{k}") for k in keys])
    both = o.join(n, on, "full_outer")

    def value(c: str) -> Column:
        if c in new.columns:
            return F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
        return F.when(F.col("_old"), F.col(f"_o_{c}")).otherwise(defaults.get(c, F.lit(None)))

    return both.select(*[value(c).cast(old.schema[c].dataType).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Old rows, and new rows with keys that aren't there, one for each: the first in order, then by its other columns."""
    rest = [F.col(c) for c in new.columns if c not in keys and dict(new.dtypes)[c] != "variant" and not dict(new.dtypes)[c].startswith("map")]
    rows = first_by(new, keys, [*(order or []), *rest] or keys)
    return old.unionByName(rows.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def patch(old: DataFrame, changes: DataFrame, keys: list[str], overwrite: bool = True, false_is_empty: bool = False) -> DataFrame:
    """Rows whose key has changes take them. overwrite False fills only empty columns; null, "", and [] are empty, and false if asked."""
    kinds = dict(old.dtypes)

    def empty(c: str) -> Column:
        x = F.col(c)
        extra = (x == "") if kinds[c] == "string" else (F.size(x) == 0) if kinds[c].startswith("array") else ~x if kinds[c] == "boolean" and false_is_empty else F.lit(False)
        return x.isNull() | F.coalesce(extra, F.lit(False))

    columns = [c for c in changes.columns if c not in keys]
    p = changes.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in columns], F.lit(True).alias("_hit"))
    both = old.join(p, keys, "left")
    put = lambda c: F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c)) if overwrite else F.when(empty(c), F.coalesce(f"_p_{c}", c)).otherwise(F.col(c))
    return both.select(*[put(c).alias(c) if c in columns else F.col(c) for c in old.columns])


def stamp(old: DataFrame, ids: DataFrame, key: str, column: str, when: Column) -> DataFrame:
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return old.join(hit, key, "left").select(*[F.when(F.col("_hit"), when).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in old.columns])


def delete(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return old.join(ids.select(key), key, "left_anti").select(*old.columns)


def work_queue(df: DataFrame, stamp_column: str, order: list, limit: int) -> DataFrame:
    """Rows without a stamp, in order, at most limit: a top-k, not a sort of everything."""
    return df.where(F.col(stamp_column).isNull()).orderBy(*order).limit(limit)
