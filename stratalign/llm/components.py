"""Connected components by smallest label, for graphs of any size: no collect, no local state.

Defined cases: edges with a null end and loops are left out, repeated edges and both directions
of an edge count once, a graph without edges gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalign.llm._util import discard, materialize


def connected_components(edges: DataFrame, parts: int = 0) -> DataFrame:
    """(id, label) for every end of an edge (a, b): the smallest id that can be reached.

    ``parts`` > 0 bounds the partitions of the tables of each round, for graphs known to be small.

    Each round takes the smallest label next door and then the label's own label, which
    halves long chains. Labels are written after each round, so lost executors cost no more
    than the round. Rounds end when no label changes.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("near")))
    fit = (lambda df: df.coalesce(parts)) if parts else (lambda df: df)
    both = materialize(fit(both.filter("id <> near").distinct()), "cc-edges")
    labels = materialize(both.groupBy("id").agg(F.least(F.min("near"), F.col("id")).alias("label")).transform(fit), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("near"), F.col("label").alias("m")), "near").groupBy("id").agg(F.min("m").alias("m"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "m").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("further"))
        moved = lower.join(jump, "to", "left").select("id", "was", F.coalesce("further", "to").alias("label"))
        moved = materialize(fit(moved), "cc-labels")
        changed = moved.filter("label < was").limit(1).count()
        discard(labels)
        labels = moved
        if not changed:
            discard(both)
            return labels.select("id", "label")
