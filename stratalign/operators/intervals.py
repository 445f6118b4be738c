"""Points that meet intervals, for tables of intervals of any length.

An interval of length l touches at most three cells of the grid whose cells are the power of two at or above l. It
is filed under those cells, and a point looks into its one cell of each grid that any interval uses, so
both sides meet by equality and a range condition is checked on what met. No interval is tried against a
point that is not within two of its lengths, and none is split into many pieces.

Different points are matched once, however many rows have them; rows take their point's matches by a join
that spreads hot points. Counts need no matches: they are differences of running totals along the axis.
Numbers are compared as 64-bit integers: dates as days, timestamps as microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalign.operators.hot import hot_join, spread_join
from stratalign.storage import assert_none, materialize


def as_number(c: Column, dtype: str) -> Column:
    if dtype == "date":
        return F.unix_date(c)
    if dtype.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("long")


def _level(length: Column) -> Column:
    """The least power of two that is not below the length."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def matches(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Different points (x) and the intervals (lo, hi, ...) with lo < x <= hi; bounds are whole numbers."""
    length = F.col("hi") - F.col("lo")
    filed = intervals.filter("lo < hi").withColumn("level", _level(length))
    filed = filed.withColumn("cell", F.explode(F.sequence(_cell(F.col("lo") + 1, F.col("level")), _cell(F.col("hi"), F.col("level")))))
    levels = [r["level"] for r in filed.select("level").distinct().collect()]  # 64 at most
    if not levels:
        return points.filter("false").crossJoin(intervals.filter("false"))
    looked = points.select("x", F.explode(F.array(*[F.struct(F.lit(v).alias("level"), _cell(F.col("x"), F.lit(v)).alias("cell")) for v in sorted(levels)])).alias("at")).select("x", "at.level", "at.cell")
    return looked.join(filed, ["level", "cell"]).filter((F.col("x") > F.col("lo")) & (F.col("x") <= F.col("hi"))).drop("level", "cell")


def interval_join(rows: DataFrame, point: str, intervals: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Each row with each interval that holds its point (start excluded, end included); columns of both."""
    dtype = dict(rows.dtypes)[point]
    other = dict(intervals.dtypes)
    x = as_number(F.col(f"`{point}`"), dtype)
    table = intervals.withColumns({"lo": as_number(F.col(start), other[start]), "hi": as_number(F.col(end), other[end])})
    met = matches(rows.select(x.alias("x")).filter("x IS NOT NULL").distinct(), table.select("lo", "hi", F.struct(*intervals.columns).alias("interval")))
    joined = spread_join(rows.withColumn("x", x).filter("x IS NOT NULL"), met.select("x", "interval"), ["x"])
    return joined.select(*rows.columns, "interval.*")


def running_totals(steps: DataFrame, key: str, n: str) -> DataFrame:
    """(key, total): the sum of ``n`` over all keys up to each; keys are different and not null.

    Two levels: the keys are dealt to ranges, each summed by itself, and a range starts with what those before it hold.
    """
    dealt = materialize(steps.select(key, n).repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")
    per = dealt.groupBy("_range").agg(F.min(key).alias("_first"), F.sum(n).alias("_whole"))  # a row per partition
    before = per.select("_range", F.coalesce(F.sum("_whole").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(n).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_within", within).join(F.broadcast(before), "_range").select(key, (F.col("_before") + F.col("_within")).alias("total"))


def interval_totals(rows: DataFrame, point: str, intervals: DataFrame, out: str = "n", start: str = "start", end: str = "end") -> DataFrame:
    """Each interval with the number of rows whose point it holds (start excluded, end included), if there are any.

    An interval holds the rows up to its end less those up to its start, so no row meets an interval, and the work
    grows with rows and intervals, not with their matches.
    """
    other = dict(intervals.dtypes)
    x = as_number(F.col(f"`{point}`"), dict(rows.dtypes)[point])
    table = intervals.select(F.struct(*intervals.columns).alias("interval"), as_number(F.col(start), other[start]).alias("lo"), as_number(F.col(end), other[end]).alias("hi")).filter("lo < hi")
    held = rows.select(x.alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    bounds = table.select(F.explode(F.array("lo", "hi")).alias("x")).distinct().withColumn("n", F.lit(0).cast("long"))
    upto = materialize(running_totals(held.unionByName(bounds).groupBy("x").agg(F.sum("n").alias("n")), "x", "n"), "interval-totals")
    low = materialize(hot_join(table, upto.select(F.col("x").alias("lo"), F.col("total").alias("below")), ["lo"], "inner"), "interval-starts")
    both = hot_join(low, upto.select(F.col("x").alias("hi"), "total"), ["hi"], "inner")
    return both.select("interval.*", (F.col("total") - F.col("below")).alias(out)).filter(F.col(out) > 0)


def first_match(rows: DataFrame, point: str, intervals: DataFrame, group: str, order: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Each row with the first interval of each group that holds its point, first by ``order``; ties are an error."""
    twice = intervals.groupBy(group, *order).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    assert_none(twice, "intervals of one group and one place in its order")
    dtype, other = dict(rows.dtypes)[point], dict(intervals.dtypes)
    x = as_number(F.col(f"`{point}`"), dtype)
    table = intervals.select(as_number(F.col(start), other[start]).alias("lo"), as_number(F.col(end), other[end]).alias("hi"), F.col(group).alias("group"), F.struct(*order, *[c for c in intervals.columns if c not in order]).alias("interval"))
    met = matches(rows.select(x.alias("x")).filter("x IS NOT NULL").distinct(), table)
    best = met.groupBy("x", "group").agg(F.min("interval").alias("interval")).groupBy("x").agg(F.collect_list("interval").alias("found"))
    per = materialize(best, "interval-firsts")
    joined = hot_join(rows.withColumn("x", x), per, ["x"], "inner")
    return joined.select(*rows.columns, F.explode("found").alias("interval")).select(*rows.columns, "interval.*")


def layers_of(first: DataFrame, backtests: DataFrame, date_col: str = "first_available_date") -> DataFrame:
    """``firstseen.assign_layers`` for a table (backtest, layer, start, end, place) of any length: backtest and layer of each row."""
    return first_match(first, date_col, backtests, "backtest", ["place"]).drop("start", "end", "place")


