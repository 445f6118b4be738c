"""Durable intermediate tables in the cluster's shared folder, and fail-closed checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class SnapshotError(ValueError):
    """A violated contract; ``audit`` holds the offending rows, if any."""

    def __init__(self, message: str, audit: DataFrame | None = None):
        super().__init__(message)
        self.audit = audit


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise SnapshotError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        root = tempfile.mkdtemp(prefix="stratalign-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stratalign/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet below spark.checkpoint.dir and read back: no lineage, survives lost executors."""
    spark: SparkSession = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # noqa: SLF001
    return out


def materialize_counted(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``materialize``, and aggregates of the rows, observed by the job that writes them."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name)
    return out, seen.get


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write as a table of ``buckets`` files, each sorted, dealt by a hash of the keys; shuffle partitions by default.

    What groups, orders or joins its rows by the keys, or by them and more, then reads each bucket as it stands: the one
    exchange is that of the write. The files lie in the shared folder like those of ``materialize``.
    """
    spark: SparkSession = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = f"{name.replace('-', '_')}_{path.rsplit('-', 1)[1]}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._stored_at, out._table = path, table  # noqa: SLF001
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that no frame still reads."""
    for df in tables:
        if hasattr(df, "_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")  # noqa: SLF001
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)  # noqa: SLF001
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def required(value: Column, message: Column | str) -> Column:
    """The value; where it is null the query that reads it fails with the message, without a pass of its own."""
    return F.coalesce(value, F.raise_error(F.lit(message) if isinstance(message, str) else message))


def known_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, noted to be unique on ``keys`` by construction (one row per group of an aggregate)."""
    df._unique_on = keys  # noqa: SLF001
    return df


def assert_unique(df: DataFrame, keys: list[str], what: str) -> None:
    """One side of a join must not repeat its keys (J23); what is noted to be unique is not counted."""
    if getattr(df, "_unique_on", None) == tuple(keys):
        return
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if twice.limit(1).count():
        raise SnapshotError(f"{what}: {', '.join(keys)} not unique", twice)


def assert_none(bad: DataFrame, message: str) -> None:
    """Raise with a few offending rows, before any result is handed out."""
    sample = bad.limit(20).collect()
    if sample:
        raise SnapshotError(f"{message}: {[tuple(r) for r in sample]}", bad)
