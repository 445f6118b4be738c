"""Joins of many rows with a table of one row per key, for keys that may hold any share of the rows.

A key is hot when it holds ``least`` rows or more. Of n rows, at most n / least keys can be hot, so with ``least``
at n / MOST_HOT or above, the hot keys' rows of the table are a broadcast of proven size. All other keys hold fewer
rows than that, so an ordinary shuffle spreads them. No row is salted, copied or dropped.

``spread_join`` is for tables of any number of rows per key, whose hot part no broadcast could hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalign.storage import materialize

#: Most hot keys, and the fewest rows of one.
MOST_HOT = 50_000
LEAST_HOT = 1_000


def hot_keys(rows: DataFrame, keys: Sequence[str], n_rows: int | None = None) -> DataFrame:
    """The keys that hold so many rows that a task of a shuffle would feel it; at most ``MOST_HOT``."""
    n = rows.count() if n_rows is None else n_rows
    least = max(LEAST_HOT, -(-n // MOST_HOT))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= least).drop("held")


def hot_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", n_rows: int | None = None) -> DataFrame:
    """``rows`` joined (left or inner) with ``table``, which has one row per key; keys must not be null in ``table``.

    ``rows`` should be a written table: it is read for the counts and once for each of the two ways.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    n_rows = rows.count() if n_rows is None else n_rows
    if n_rows < LEAST_HOT:
        return rows.join(table.hint("merge"), list(keys), how)  # so few rows need no job of their own for a broadcast
    hot = hot_keys(rows, keys, n_rows)
    taken = [c for c in table.columns if c not in keys]
    marked = F.broadcast(hot.join(table, list(keys), "left").withColumn("_hot", F.lit(True)))
    near = rows.join(marked, list(keys), "left")
    there = near.filter("_hot").drop("_hot")
    if how == "inner":
        there = there.join(F.broadcast(hot.join(table.select(*keys), list(keys), "left_semi")), list(keys), "left_semi")
    away = rows.join(F.broadcast(hot), list(keys), "left_anti").join(table, list(keys), how)
    columns = [*rows.columns, *taken]
    return there.select(*columns).unionByName(away.select(*columns))


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], n_rows: int | None = None) -> DataFrame:
    """``rows`` joined (inner) with ``table``, either of which may have any number of rows per key; keys must not be null.

    A hot key's rows are dealt into shares of about ``least`` rows, and each share meets a copy of that key's rows of the
    table. Only the number of shares is broadcast, and there is one copied row for about ``least`` rows of the result.
    """
    n_rows = rows.count() if n_rows is None else n_rows
    least = max(LEAST_HOT, -(-n_rows // MOST_HOT))
    shares = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / least).cast("int").alias("_shares")).filter("_shares > 1")
    shares = F.broadcast(materialize(shares, "shares"))
    one = F.coalesce("_shares", F.lit(1))
    # written, so that a task that runs again doesn't deal its rows in another way
    dealt = materialize(rows.join(shares, list(keys), "left").withColumn("_share", F.pmod(F.monotonically_increasing_id(), one).cast("int")).drop("_shares"), "dealt")
    copies = table.join(shares, list(keys), "left").withColumn("_share", F.explode(F.sequence(F.lit(0), one - 1))).drop("_shares")
    taken = [c for c in table.columns if c not in keys]
    return dealt.join(copies.hint("merge"), [*keys, "_share"]).select(*rows.columns, *taken)
