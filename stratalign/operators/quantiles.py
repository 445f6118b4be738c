"""Exact quantiles of any number of groups by distributed selection.

A quantile is the value at a rank, or lies between the values at two. Each rank begins with its group's
whole range. A round counts the values of every open range in ``bins`` bins, with partial counts before the
shuffle, and keeps of each range the bin that holds the rank, as the least and greatest value that are
in it. A range of one value is solved. One that holds few values is solved by counting its different
values. No task gathers a group, whatever its size or its number of different values; a round reads the
rows again, or only those in open ranges once these are few.

Bins are even on a logarithmic scale where a range spans several powers of two, so values of many magnitudes
need no more rounds than others. Nulls and not-a-number take no part; a group without other values has null
quantiles. Infinities are values. A null in a group column is a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalign.operators.hot import hot_join
from stratalign.storage import discard, materialize

BINS = 256
#: Values of a range that are counted one by one.
FEW = 4_096
_MOST = 1.7976931348623157e308


def _place(x: Column, lo: Column, hi: Column) -> Column:
    """Where x lies between lo and hi: 0 to 1, never falling as x grows."""
    low, high = F.greatest(lo, F.lit(-_MOST)), F.least(hi, F.lit(_MOST))
    unit = F.greatest(F.abs(low), F.abs(high)) * F.lit(2.0**-60)
    bent = lambda v: F.signum(v) * F.log1p(F.abs(v) / unit)
    return (
        F.when((low > 0) & (high / low > 4), F.ln(x / low) / F.ln(high / low))
        .when((high < 0) & (low / high > 4), 1 - F.ln(x / high) / F.ln(low / high))
        .when((low <= 0) & (high >= 0), (bent(x) - bent(low)) / (bent(high) - bent(low)))
        .otherwise((x - low) / (high - low))
    )


def _bin(x: Column, at: Column, bins: int) -> Column:
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _place(x, at["lo"], at["hi"])))
    return F.when(x == at["lo"], 0).when(x == at["hi"], bins - 1).otherwise(F.least(F.floor(place * bins), F.lit(bins - 1))).cast("int")


def _in_range(rows: DataFrame, ranges: DataFrame, n_rows: int) -> DataFrame:
    """(g, x, at): the values that lie in a range of their group; ranges of a group don't overlap."""
    per = ranges.groupBy("g").agg(F.collect_list(F.struct("lo", "hi", "few")).alias("all"))  # two for each quantile at most
    met = hot_join(rows, per, ["g"], "inner", n_rows)
    at = F.get(F.filter("all", lambda r: (F.col("x") >= r["lo"]) & (F.col("x") <= r["hi"])), F.lit(0))
    return met.select("g", "x", at.alias("at")).filter("at IS NOT NULL")


def _narrow(counts: DataFrame, open_: DataFrame, value_order: str) -> DataFrame:
    """Open ranks (g, lo, hi, below, rank) meet the counts (g, lo, hi, n, least, most) of their range's parts: the part that holds each."""
    upto = F.sum("n").over(W.partitionBy("g", "lo", "hi").orderBy(value_order))
    parts = counts.withColumns({"end": upto, "start": upto - F.col("n")}).drop(value_order)
    met = open_.join(parts, ["g", "lo", "hi"]).filter((F.col("below") + F.col("start") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("end")))
    return met.select("g", "rank", (F.col("below") + F.col("start")).alias("below"), F.col("least").alias("lo"), F.col("most").alias("hi"), "n")


def values_at(rows: DataFrame, ranks: DataFrame, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(g, rank, v): the value at each rank (g, rank; from 0) among the rows (g, x) of its group. ``rows`` is a written table."""
    whole = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    state = materialize(ranks.join(whole, "g").select("g", "rank", F.lit(0).cast("long").alias("below"), "lo", "hi", "n"), "quantile-ranks")
    left, n_rows, solved = rows, rows.count(), None
    while True:
        done = materialize(state.filter("lo = hi").select("g", "rank", F.col("lo").alias("v")), "quantile-found")
        solved = done if solved is None else solved.unionByName(done)
        small = state.filter((F.col("lo") < F.col("hi")) & (F.col("n") <= few))
        wide = state.filter((F.col("lo") < F.col("hi")) & (F.col("n") > few))
        ranges = state.filter("lo < hi").select("g", "lo", "hi", "n", (F.col("n") <= few).alias("few")).distinct()
        held = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
        if not held["n"]:
            return solved
        inside = _in_range(left, ranges, n_rows)
        if 4 * held["n"] <= n_rows:
            now = materialize(inside.select("g", "x"), "quantile-rows")
            if left is not rows:
                discard(left)
            left, n_rows = now, held["n"]
            inside = _in_range(left, ranges, n_rows)
        bounds = [F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi")]
        parts = None
        if held["most"] > few:
            by_bin = inside.filter("NOT at.few").select("g", *bounds, "x", _bin(F.col("x"), F.col("at"), bins).alias("order"))
            counted = by_bin.groupBy("g", "lo", "hi", "order").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
            parts = _narrow(counted, wide.drop("n"), "order")
        valued = inside.filter("at.few").select("g", *bounds, "x").groupBy("g", "lo", "hi", "x").agg(F.count(F.lit(1)).alias("n")).select("g", "lo", "hi", "n", F.col("x").alias("order"), F.col("x").alias("least"), F.col("x").alias("most"))
        settled = _narrow(valued, small.drop("n"), "order")
        before, state = state, materialize(settled if parts is None else settled.unionByName(parts), "quantile-ranks")
        discard(before)


def point_name(p: float) -> str:
    """p05, p50, p99_9, p100."""
    whole, _, part = f"{p * 100:.10g}".partition(".")
    return f"p{int(whole):02d}" + (f"_{part}" if part else "")


def exact_quantiles(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = (), bins: int = BINS, few: int = FEW) -> DataFrame:
    """One row per group: ``by``, n, and p01, p50, p99_9 ... for each point: the linear quantile between the two nearest ranks."""
    if any(not 0 <= p <= 1 for p in points):
        raise ValueError("points are shares from 0 to 1")
    x = F.col(f"`{value}`").cast("double")
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("k"))
    g = F.to_json(key)  # nulls are left out of it, so they differ from every value
    groups = df.select(g.alias("g"), key.alias("key"), x.alias("x")).groupBy("g", "key").agg(F.count(F.when(F.col("x").isNotNull() & ~F.isnan("x"), 1)).alias("n"))
    groups = materialize(groups, "quantile-groups")
    rows = materialize(df.select(g.alias("g"), (x + F.lit(0.0)).alias("x")).filter("x IS NOT NULL AND NOT isnan(x)"), "quantile-values")
    asked = groups.filter("n > 0").select("g", F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("p"), "n").withColumn("h", (F.col("n") - 1) * F.col("p"))
    asked = asked.withColumns({"low": F.floor("h"), "high": F.ceil("h")})
    ranks = asked.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = materialize(values_at(rows, ranks, bins, few), "quantile-values-at")
    low, high = found.select("g", F.col("rank").alias("low"), F.col("v").alias("a")), found.select("g", F.col("rank").alias("high"), F.col("v").alias("b"))
    met = asked.join(low, ["g", "low"]).join(high, ["g", "high"])
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.col("low")))
    wide = met.groupBy("g").agg(*[F.max(F.when(F.col("p") == float(p), between)).alias(point_name(p)) for p in points])
    out = materialize(groups.join(wide, "g", "left").select(*[F.col(f"key.k{i}").alias(c) for i, c in enumerate(by)], "n", *[point_name(p) for p in points]), "quantiles")
    discard(rows, groups, found)
    return out
