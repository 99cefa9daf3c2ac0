"""Connected components of an edge list, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b): a row (v, label) for every node, label being the least node it is connected with.

    In each round a node takes the least label among its neighbours' and then
    its label's label, so long chains shorten quickly. Rounds are written to the
    shared folder, and removed there once the next one is. Labels are combined
    before they are shuffled, so a node with very many edges is no hot spot.

    Defined results: an edge with a null end, or from a node to itself, is
    left out, and a node with no other edge has no row; repeated edges count
    once; without edges there are no rows.
    """
    ways = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = stored(edges.where("a <> b").select(ways).select("e.a", "e.b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        best = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", "label", F.least("label", "m").alias("new"))
        jump = labels.select(F.col("v").alias("new"), F.col("label").alias("next"))
        step = best.join(jump, "new").select("v", F.least("new", "next").alias("label"), (F.least("new", "next") != F.col("label")).alias("moved"))
        step = stored(step, "labels")
        discard(labels)
        labels = step
        if step.where("moved").isEmpty():
            discard(both)
            out = step.select("v", "label")
            out._stored_at = step._stored_at
            return out
