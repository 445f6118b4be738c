"""Keyed comparison of two tables, value by value (J17, N14, N18), and proofs of one-to-one relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalign.operators.stars import star_components
from stratalign.storage import SnapshotError, discard, materialize

FLOATS = ("double", "float")


def shared_columns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Columns that both tables have beside the keys, and (column, type left, type right) of those that differ in being there or in type."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    odd = [(c, a.get(c, ""), b.get(c, "")) for c in sorted({*a, *b}) if a.get(c) != b.get(c)]
    if bad := [c for c, _, _ in odd if c in keys]:
        raise SnapshotError(f"keys differ in type: {bad}")
    return [c for c in left.columns if c not in keys and a[c] == b.get(c)], odd


def _keyed(df: DataFrame, keys: Sequence[str], columns: Sequence[str], side: str) -> DataFrame:
    """One row per key: how many rows it has, a hash of one and that one's values."""
    values = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)])
    one = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in columns]).alias("hash"), values.alias("values"))
    return one.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias(f"{side}_n"), F.first("hash").alias(f"{side}_hash"), F.first("values").alias(f"{side}_values"))


def _differs(a: Column, b: Column, dtype: str, tolerance: float) -> Column:
    if dtype in FLOATS or dtype.startswith("decimal"):
        near = (a == b) | (F.isnan(a.cast("double")) & F.isnan(b.cast("double"))) | (F.abs(a.cast("double") - b.cast("double")) <= tolerance)
    else:
        near = a == b
    return ~F.coalesce(near, a.isNull() & b.isNull())


def compare_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float | Mapping[str, float] = 0.0) -> DataFrame:
    """(keys, difference, column, left_value, right_value): what differs, one row each; empty if nothing does.

    ``difference`` is left_only, right_only, repeated (a key that a table has twice: its values are not compared),
    null_left, null_right or value. One join by key, in which equal rows are told by a hash and dropped; columns are looked
    at only where it differs. ``tolerance`` holds for numbers with a fraction, for all or by column. Columns that only one
    table has, or that differ in type, are ``shared_columns``' to report. A null key equals a null key.
    """
    columns, _ = shared_columns(left, right, keys)
    kinds = dict(left.dtypes)
    at = (lambda c: float(tolerance.get(c, 0.0))) if isinstance(tolerance, Mapping) else (lambda c: float(tolerance))
    l, r = _keyed(left, keys, columns, "left"), _keyed(right, keys, columns, "right")
    ks = [f"k{i}" for i in range(len(keys))]
    r = r.select(*[F.col(k).alias(f"r_{k}") for k in ks], "right_n", "right_hash", "right_values")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in ks])
    met = l.join(r, same, "full_outer").filter(~(F.col("left_hash").eqNullSafe(F.col("right_hash")) & (F.col("left_n") == 1) & (F.col("right_n") == 1)) | F.col("left_n").isNull() | F.col("right_n").isNull())
    found = lambda kind, c, a, b: F.struct(F.lit(kind).alias("difference") if isinstance(kind, str) else kind.alias("difference"), F.lit(c).cast("string").alias("column"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value"))
    null = F.lit(None)
    each = []
    for i, c in enumerate(columns):
        a, b = F.col(f"left_values.v{i}"), F.col(f"right_values.v{i}")
        kind = F.when(a.isNull(), "null_left").when(b.isNull(), "null_right").otherwise("value")
        each.append(F.when(_differs(a, b, kinds[c], at(c)), found(kind, c, a, b)))
    whole = (
        F.when(F.col("right_n").isNull(), F.array(found("left_only", None, null, null)))
        .when(F.col("left_n").isNull(), F.array(found("right_only", None, null, null)))
        .when((F.col("left_n") > 1) | (F.col("right_n") > 1), F.array(found("repeated", None, F.col("left_n"), F.col("right_n"))))
        .otherwise(F.array_compact(F.array(*each)) if each else F.expr("cast(null as array<struct<difference:string,column:string,left_value:string,right_value:string>>)"))
    )
    picked = [F.when(F.col("left_n").isNull(), F.col(f"r_{k}")).otherwise(F.col(k)).alias(name) for k, name in zip(ks, keys, strict=True)]
    return met.select(*picked, F.explode(whole).alias("_d")).select(*[F.col(f"`{k}`") for k in keys], "_d.*")


def one_to_one(pairs: DataFrame, group: Sequence[str], left: str, right: str) -> DataFrame:
    """Components of the relation between two kinds of ids within each group, at any degree: group, component, n_left, n_right, n_pairs, kind.

    A relation is one to one exactly if every component has one id of each kind. The component is named by its least left id. Pairs
    with a null end are left out. Groups are told apart in the nodes' names, so one contraction serves all of them.
    """
    g = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(group)], F.lit(0).alias("g")))
    named = lambda tag, c: F.to_json(F.struct(g.alias("g"), F.lit(tag).alias("side"), F.col(f"`{c}`").cast("string").alias("id")))
    rows = pairs.filter(F.col(f"`{left}`").isNotNull() & F.col(f"`{right}`").isNotNull())
    edges = materialize(rows.select(*[F.col(f"`{c}`") for c in group], F.col(f"`{left}`").cast("string").alias("_l"), F.col(f"`{right}`").cast("string").alias("_r"), named("l", left).alias("a"), named("r", right).alias("b")).distinct(), "bipartite")
    labels = star_components(edges.select("a", "b")).labels
    held = edges.join(labels, F.col("a") == F.col("node")).groupBy(*[F.col(f"`{c}`") for c in group], "label").agg(
        F.min("_l").alias("component"), F.count_distinct("_l").alias("n_left"), F.count_distinct("_r").alias("n_right"), F.count(F.lit(1)).alias("n_pairs")
    )
    kind = F.when((F.col("n_left") == 1) & (F.col("n_right") == 1), "one_to_one").when(F.col("n_left") == 1, "one_to_many").when(F.col("n_right") == 1, "many_to_one").otherwise("many_to_many")
    out = materialize(held.drop("label").withColumn("kind", kind), "bipartite-kinds")
    discard(edges)
    return out
