"""Counts and sums by group that are kept up to date from the changes of a stored table.

A refresh reads the rows that changed since the manifest that it last saw: new
rows count, old ones are taken back, and the differences by group are merged
into the buckets they fall in. What hasn't changed is not read. The sums and the
number of the manifest they stand for are published together, so a refresh that
stops is as if it had not begun, and one that is repeated adds nothing.

Defined results: null groups are groups; null values add nothing; a group goes
with its last row. Sums are of whole numbers or decimals, which can be taken
back exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


def refresh(store: Store, source: str, name: str, by: list[str], sums: list[str] | None = None, buckets: int = 16) -> DataFrame:
    """Bring the table name (by, n, sum_<column> each) up to date with source, and return it."""
    job, sums = f"sums {name}", sums or []
    tx = store.begin()
    last = int((tx.state["runs"].get(job) or [0])[-1])
    if last and last not in store._numbers():
        raise ValueError(f"manifest {last} that {name} stands for has expired; drop {name} and begin anew")
    changed = store.pairs(source, last, tx.base)
    side = lambda s, sign: changed.where(F.col(s).isNotNull()).select(*[F.col(f"{s}.{c}").alias(c) for c in by], F.lit(sign).cast("bigint").alias("n"), *[(F.coalesce(F.col(f"{s}.{c}"), F.lit(0)) * sign).alias(f"sum_{c}") for c in sums])
    values = ["n", *(f"sum_{c}" for c in sums)]
    total = lambda rows: rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in values])
    delta = total(side("new", 1).unionByName(side("old", -1)))
    tx.create(name, delta.schema, by, buckets)
    tx.merge(name, delta, lambda old, new: total(old.unionByName(new)).where("n <> 0"))
    tx.publish(job, str(tx.base))
    return store.read(name)
