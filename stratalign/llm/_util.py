"""Shared pieces of the corpus operators: durable intermediate tables and text expressions.

Intermediate results that are read more than once are written as Parquet tables
below ``spark.checkpoint.dir``, the folder that the cluster shares. Such a table
survives the loss of any executor, cuts the lineage and is never recomputed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. Without one a local master gets a temporary folder, and a cluster raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        root = tempfile.mkdtemp(prefix="stratalign-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/stratalign/{name}-{uuid.uuid4().hex}"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch meanwhile, if that is less than the session has; for wide rows."""
    was = spark.conf.get(ARROW_ROWS)
    if rows is None or 0 < int(was) <= rows:
        yield
        return
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, was)


def materialize(df: DataFrame, name: str, path: str | None = None, arrow_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a shared Parquet table and read it back."""
    path = path or new_path(df.sparkSession, name)
    with arrow_batches(df.sparkSession, arrow_rows):
        df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path  # noqa: SLF001
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that no returned frame reads."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def sliced(batches, rows: int = 500):
    """Arrow batches cut to ``rows`` rows: what a Python worker holds beside a batch stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and after a task what its Python worker no longer needs goes back to the system.

    Workers live on from task to task and from stage to stage; allocators would keep the most
    that any of them ever took.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow

        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def in_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``df.mapInArrow``, which itself can't name a column with a dot; ``run`` goes by the columns' places."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def unused_name(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII strings take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def unit_interval(*parts: Column) -> Column:
    """A reproducible uniform number in (0, 1) from 52 bits of an MD5 over the parts."""
    head = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
