"""Connected components by star contraction: alternating large-star and small-star operations.

Edges are pairs (a, b) with a > b, each once. The large star of a node hands its larger neighbours over to
the least node that it knows; the small star does so with its smaller neighbours and itself. Both
keep the components, and when neither changes an edge, every node hangs on the least node of its
component. The number of rounds grows with the logarithm of the longest path, squared at worst.

What a node knows as its least neighbour is a minimum, combined before the shuffle. Handing it back to the
node's edges is ``hot_join``: a hub of any degree gets it by a broadcast of bounded size, so no task gathers
a hub's neighbours. Each operation's edges are a written table; the one before is deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalign.operators.hot import LEAST_HOT, hot_join
from stratalign.storage import SnapshotError, discard, materialize, materialize_counted


@dataclass(frozen=True)
class Components:
    """``labels`` (node, label): the least node that each end of an edge can reach. ``rounds`` counts pairs of operations."""

    labels: DataFrame
    rounds: int


def _oriented(edges: DataFrame, parts: int = 0) -> DataFrame:
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b"))).toDF("a", "b", "void")
    out = ends.filter("NOT void").select("a", "b").distinct()
    return out.coalesce(parts) if parts else out


def _least(edges: DataFrame, node: str) -> DataFrame:
    return edges.groupBy(F.col("a").alias(node)).agg(F.min("b").alias("m"))


def large_star(edges: DataFrame, n: int | None = None) -> DataFrame:
    """Edge (a, b) becomes (a, m) with m the least of b and its neighbours."""
    return hot_join(edges, _least(edges, "b"), ["b"], "left", n).select("a", F.coalesce("m", "b").alias("b"))


def small_star(edges: DataFrame, n: int | None = None) -> DataFrame:
    """Edges (a, b) of one a become (b, m) and (a, m) with m the least b."""
    known = hot_join(edges, _least(edges, "a"), ["a"], "left", n)
    return known.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and what tells one set of edges from another: their number and two sums of hashes."""
    table, seen = materialize_counted(edges, "stars", n=F.count(F.lit(1)), s=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), x=F.bit_xor(F.xxhash64("b", "a")))
    return table, (seen["n"], seen["s"], seen["x"])


def star_components(edges: DataFrame, parts: int = 0, limit: int = 200) -> Components:
    """Components of the edges (a, b) of any ordered type; loops and edges with a null end are left out.

    ``parts`` > 0 bounds the partitions of each round's tables, for graphs known to be small.
    """
    now, state = _written(_oriented(edges, parts))
    for turn in range(1, limit + 1):
        if not state[0]:
            break
        few = state[0] < LEAST_HOT  # so few edges are one partition and one job a round; neither operation makes more of them
        large = _oriented(large_star(now.coalesce(1) if few else now, state[0]), parts)
        large = large if few else materialize(large, "stars")
        was = state
        small, state = _written(_oriented(small_star(large, was[0] if few else None), parts or int(few)))
        discard(now, *([] if few else [large]))
        now = small
        if state == was:
            break
    else:
        raise SnapshotError(f"components haven't settled after {limit} rounds")
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    return Components(labels, turn if state[0] else 0)
