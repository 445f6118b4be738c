"""Incremental first dates: release batches arrive in any order, and the minimum per key is kept.

First dates only ever fall, so a batch touches its own keys alone. Identity is not monotone
(a later contradiction can split an earlier merge), so identities are resolved in batches and
only their keys are streamed.

A batch writes its own minima below ``kind=delta``; every ``compact_every`` batches the deltas are
merged into one table below ``kind=base``, and what that table covers is deleted. A repeated
batch writes the same folder again; a reader takes the newest base and the deltas after it, so a
run that ends between writing and deleting leaves nothing wrong.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _minima(rows: DataFrame, key: str, day: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(day).alias("first_available_date"))


def _current(rows: DataFrame) -> DataFrame:
    """Of all tables, the newest base and the deltas after it."""
    base = rows.filter("kind = 'base'").agg(F.max("n").alias("n")).first()["n"]
    last = -1 if base is None else base
    return rows.filter((F.col("kind") == "base") & (F.col("n") == last) | (F.col("kind") == "delta") & (F.col("n") > last))


def _drop_until(spark: SparkSession, path: str, n: int) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for kind, last in (("delta", n), ("base", n - 1)):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
        fs = folder.getFileSystem(conf)
        for at in fs.listStatus(folder) if fs.exists(folder) else ():
            if int(at.getPath().getName().split("=")[1]) <= last:
                fs.delete(at.getPath(), True)


def start_first_seen(events: DataFrame, key: str, day: str, path: str, checkpoint: str, compact_every: int = 20) -> StreamingQuery:
    """Keep the first dates of all batches so far below ``path``; ``latest`` reads them."""

    def merge(batch: DataFrame, n: int) -> None:
        spark: SparkSession = batch.sparkSession
        _minima(batch, key, day).write.mode("overwrite").parquet(f"{path}/kind=delta/n={n}")
        if (n + 1) % compact_every == 0:
            rows = _current(spark.read.parquet(path).filter(F.col("n") <= n))
            _minima(rows, key, "first_available_date").write.mode("overwrite").parquet(f"{path}/kind=base/n={n}")
            _drop_until(spark, path, n)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(key, first_available_date) after the last batch; without any batch it raises."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no batch has been written below {path}") from e
    key = next(c for c in rows.columns if c not in ("first_available_date", "kind", "n"))
    return _minima(_current(rows), key, "first_available_date")
