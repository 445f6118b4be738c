"""Shards by rendezvous hashing: every (record key, shard) pair has a score, and the best score takes the record.

The score of a key at a shard of weight w is -ln(u) / w, with u a uniform number from an MD5 of
key and shard; the least one wins, so a shard gets records in proportion to its weight. A key's
scores at other shards don't change when a shard comes or goes: one shard more takes rows only into
itself, one fewer gives up its own rows only. ``shard_of`` is an expression, without a shuffle.

Slots number the rows of a shard from 0 without a gap, in an order that depends on the keys alone.
A shard is cut into cells along that order; cells are counted, their counts summed, and rows are
ranked inside their cell, so no task sees a whole shard. Rows that agree in key, size and checksum are
counted before they are moved and are told apart only at the end, so a row repeated very often is
one row until then.

Defined cases: a null key is a key of its own; rows of one key share a shard; a null text
has size 0 plus the record's overhead and the checksum of the empty text; an empty table gives no rows.
Ties of scores go to the smaller shard. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalign.llm._util import materialize, or_empty, unit_interval, unused_name

#: Bytes that a record takes beside its text.
OVERHEAD = 16
#: Rows that a cell holds in the mean.
CELL_ROWS = 5_000
#: Most equal rows that one row is expanded to in one step.
CHUNK = 10_000


def _word(key: Column) -> Column:
    """The key as text; null is a word that no integer has."""
    return F.coalesce(key.cast("string"), F.lit("null"))


def score(key: Column, shard: Column, weight: Column) -> Column:
    return -F.ln(unit_interval(F.lit("shard"), _word(key), shard.cast("string"))) / weight


def best(key: Column, weights: Sequence[float]) -> Column:
    """(score, shard) of the shard that takes the key; shard i weighs weights[i], and 0 takes nothing."""
    open_ = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not open_ or min(weights) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in open_])
    return F.array_min(F.transform(shards, lambda s: F.struct(score(key, s["i"], s["w"]).alias("score"), s["i"].alias("shard"))))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    return best(key, weights)["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], key_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row."""
    return docs.withColumn(out, shard_of(F.col(f"`{key_col}`"), weights))


def moved(docs: DataFrame, before: Sequence[float], after: Sequence[float], key_col: str = "doc_id") -> DataFrame:
    """(was, is, n): rows that another set of weights gives to another shard."""
    key = F.col(f"`{key_col}`")
    both = docs.select(shard_of(key, before).alias("was"), shard_of(key, after).alias("is"))
    return both.filter("was <> is").groupBy("was", "is").agg(F.count(F.lit(1)).alias("n"))


def _order(key: Column, crc: Column) -> Column:
    return unit_interval(F.lit("slot"), _word(key), crc.cast("string"))


def _cells(rows: int, shards: int) -> int:
    return max(1, -(-rows // (CELL_ROWS * max(1, shards))))


def place(docs: DataFrame, weights: Sequence[float], key_col: str = "doc_id", text_col: str = "text", grown: float | None = None) -> DataFrame:
    """One narrow row per row of ``docs``: key, size, text_crc32, shard, slot; with ``grown`` also grown_shard.

    ``grown`` is the weight of one shard more. Texts are read once, and what is moved are keys and numbers.
    """
    text, key = or_empty(F.col(f"`{text_col}`")), F.col(f"`{key_col}`")
    narrow = docs.select(key.alias("key"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    counted = narrow.groupBy("key", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    took = best(F.col("key"), weights)
    rows = materialize(counted.withColumns({"best": took, "at": _order(F.col("key"), F.col("crc"))}), "shard-rows")
    cells = _cells(rows.count(), len(weights))
    own = ["key", "size", "crc", "n", "at", F.col("best.shard").alias("shard"), F.least(F.floor(F.col("at") * cells), F.lit(cells - 1)).cast("int").alias("cell")]
    if grown is not None:
        more = score(F.col("key"), F.lit(len(weights)), F.lit(float(grown)))
        own.append(F.when(more < F.col("best.score"), F.lit(len(weights))).otherwise(F.col("best.shard")).alias("grown_shard"))
    rows = rows.select(*own)
    counts = rows.groupBy("shard", "cell").agg(F.sum("n").alias("n"))
    starts = counts.select("shard", "cell", (F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("start"))
    before = F.sum("n").over(W.partitionBy("shard", "cell").orderBy("at", F.col("key").asc_nulls_last(), "size", "crc")) - F.col("n")
    ranked = rows.join(starts, ["shard", "cell"]).withColumn("first", F.col("start") + before)
    chunks = ranked.select("*", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / CHUNK).cast("long"))).alias("chunk"))
    last = F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1
    each = chunks.select("*", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("i"))
    out = [F.col("key").alias(key_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("i")).alias("slot")]
    return each.select(*out, *([F.col("grown_shard").cast("int").alias("grown_shard")] if grown is not None else []))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key_col: str = "doc_id", text_col: str = "text", mean_bytes: int = 1 << 27) -> None:
    """All columns of ``docs`` as Parquet below path/shard=i, in the order of their slots from file to file.

    Each text is moved once, to its shard's cell; a file holds a cell of about ``mean_bytes``. The rows of
    a source, or copies of a text under different keys, spread over shards and cells.
    """
    if "shard" in docs.columns:
        raise ValueError("the column shard is the layout's own; rename it first")
    text, key = or_empty(F.col(f"`{text_col}`")), F.col(f"`{key_col}`")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text) + F.lit(OVERHEAD)), F.lit(0)).alias("b")).first()["b"]
    cells = max(1, round(total / (mean_bytes * len(weights))))
    at, cell = unused_name(docs.columns, "at"), unused_name(docs.columns, "cell")
    rows = docs.withColumns({"shard": shard_of(key, weights), at: _order(key, F.crc32(F.encode(text, "UTF-8")))})
    rows = rows.withColumn(cell, F.least(F.floor(F.col(at) * cells), F.lit(cells - 1)).cast("int"))
    rows = rows.repartitionByRange(cells * len(weights), "shard", cell).sortWithinPartitions("shard", at, key.asc_nulls_last())
    rows.drop(at, cell).write.mode("overwrite").partitionBy("shard").parquet(path)
