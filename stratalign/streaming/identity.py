"""Identity over batches of occurrences: only what a batch touches is resolved again.

Aliases of one occurrence belong together, so occurrences fall into families: the components of the alias
graph before anything is quarantined. Batches add occurrences and take none away, so families only grow and
merge. Quarantine, by which a family may split into several identities, reads the family's own
aliases and nothing else. After a batch, then, only the families that its aliases meet can differ: they are
merged, and ``protected_components`` solves them again from their own occurrences. All other families'
identities stay as they were, which is what a full resolution of all batches would say of them.

State below a shared folder, one set of tables per batch (``n=...``), newest row wins:

* ``labels`` (alias, root): the family of an alias, by its smallest alias, partitioned by a hash of the alias;
* ``families`` (root, gone): which families a batch solved, and which it merged away;
* ``occurrences``, ``identities``, ``components``, ``quarantined``: rows of the families that the batch
  solved, partitioned by a hash of the root, so that a batch reads the partitions that it touches.

A batch that is repeated writes its own folders again, and reads only those before it. After
``compact_every`` batches the state is written as one. Occurrence identifiers are unique over all batches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalign.functions import text as X
from stratalign.operators.components import protected_components
from stratalign.operators.stars import star_components
from stratalign.storage import discard, materialize

BUCKETS = 64
TABLES = {
    "labels": "alias string, root string, bucket int, n long",
    "families": "root string, gone boolean, bucket int, n long",
    "occurrences": "occurrence_id string, aliases array<string>, fallback_alias string, root string, bucket int, n long",
    "identities": "occurrence_id string, canonical_key string, root string, bucket int, n long",
    "components": "canonical_key string, aliases array<string>, root string, bucket int, n long",
    "quarantined": "alias string, iteration int, root string, bucket int, n long",
    "work": "batch_rows long, touched_families long, state_rows long, bucket int, n long",
}


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


class IncrementalIdentity:
    """Families and identities of one kind (document or assay) below ``path``."""

    def __init__(self, spark: SparkSession, path: str, kind: str, compact_every: int = 20):
        self.spark, self.path, self.kind, self.compact_every = spark, path.rstrip("/"), kind, compact_every

    # ---- state

    def _read(self, name: str, before: int | None, buckets: list[int] | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        except AnalysisException:  # no batch yet
            rows = self.spark.createDataFrame([], TABLES[name])
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return rows if before is None else rows.filter(F.col("n") < before)

    def _labels(self, before: int | None, buckets: list[int] | None = None) -> DataFrame:
        return self._read("labels", before, buckets).groupBy("alias").agg(F.max_by("root", "n").alias("root"))

    def _alive(self, before: int | None, buckets: list[int] | None = None) -> DataFrame:
        """(root, n): families that stand, and the batch that solved each last."""
        last = self._read("families", before, buckets).groupBy("root").agg(F.max(F.struct("n", "gone")).alias("last"))
        return last.filter("NOT last.gone").select("root", F.col("last.n").alias("n"))

    def _current(self, name: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        return self._read(name, before, buckets).join(self._alive(before, buckets), ["root", "n"], "left_semi")

    def identities(self) -> DataFrame:
        """(occurrence_id, canonical_key) after the last batch."""
        return self._current("identities").select("occurrence_id", "canonical_key")

    def components(self) -> DataFrame:
        return self._current("components").select("canonical_key", "aliases")

    def quarantined(self) -> DataFrame:
        return self._current("quarantined").select("alias", "iteration").distinct()

    def work(self) -> DataFrame:
        """(n, batch_rows, touched_families, state_rows): what each batch brought, and what it read again of the state."""
        return self._read("work", None).select("n", "batch_rows", "touched_families", "state_rows")

    def _write(self, rows: DataFrame, name: str, n: int, key: str | None = None) -> None:
        """One folder for each table and batch; a repeated batch replaces its own."""
        out = rows.withColumn("bucket", _bucket(key) if key else F.lit(0)) if "bucket" not in rows.columns else rows
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/n={n}")

    # ---- a batch

    def update(self, batch: DataFrame, n: int) -> None:
        """Take in batch n: occurrences (occurrence_id, aliases, fallback_alias)."""
        new = batch.select(F.col("occurrence_id").cast("string").alias("occurrence_id"), X.sorted_set(F.col("aliases")).alias("aliases"), "fallback_alias")
        new = materialize(new.filter(F.size("aliases") > 0), "identity-batch")
        met = new.select(F.explode("aliases").alias("alias")).distinct()
        hit = [r["bucket"] for r in met.select(_bucket("alias")).distinct().collect()]  # BUCKETS numbers at most
        known = materialize(met.join(self._labels(n, hit), "alias"), "identity-known")
        # families of the batch: its own aliases, joined by the roots of those that are known already
        own = new.select(F.element_at("aliases", 1).alias("b"), F.explode("aliases").alias("a"))
        linked = star_components(own.unionByName(known.select(F.col("alias").alias("a"), F.col("root").alias("b"))))
        labels = materialize(linked.labels.unionByName(met.select(F.col("alias").alias("node"), F.col("alias").alias("label")).join(linked.labels.select("node"), "node", "left_anti")), "identity-labels")
        roots = known.select("root").distinct()
        moved = materialize(roots.join(labels.select(F.col("node").alias("root"), F.col("label").alias("to")), "root"), "identity-moved")
        places = [r["bucket"] for r in moved.select(_bucket("root")).distinct().collect()]
        old = self._current("occurrences", n, places).join(moved, "root").select("occurrence_id", "aliases", "fallback_alias", F.col("to").alias("root"))
        fresh = new.join(labels.select(F.col("node").alias("first"), F.col("label").alias("root")), F.element_at("aliases", 1) == F.col("first")).select("occurrence_id", "aliases", "fallback_alias", "root")
        rows = materialize(old.withColumn("was", F.lit(True)).unionByName(fresh.withColumn("was", F.lit(False))), "identity-rows")
        # the touched families, solved from their own occurrences
        mapping, table, gone = protected_components(rows.select("occurrence_id", "aliases", "fallback_alias"), self.kind)
        home = rows.select("occurrence_id", "root")
        mapped = materialize(mapping.join(home, "occurrence_id"), "identity-mapped")
        self._write(mapped, "identities", n, "root")
        self._write(table.select("canonical_key", "aliases").join(mapped.select("canonical_key", "root").distinct(), "canonical_key"), "components", n, "root")
        flat = rows.select(F.explode("aliases").alias("alias"), "root").distinct()
        self._write(gone.join(flat, "alias"), "quarantined", n, "root")
        self._write(rows.drop("was"), "occurrences", n, "root")
        self._write(flat, "labels", n, "alias")
        solved = rows.select("root").distinct().withColumn("gone", F.lit(False))
        merged = moved.filter("root <> to").select("root", F.lit(True).alias("gone"))
        # families last: without its row nothing of the batch is seen
        self._write(rows.agg(F.sum((~F.col("was")).cast("long")).alias("batch_rows"), F.count_distinct("root").alias("touched_families"), F.sum(F.col("was").cast("long")).alias("state_rows")), "work", n)
        self._write(solved.unionByName(merged), "families", n, "root")
        discard(new, known, labels, moved, rows, mapped)
        if (n + 1) % self.compact_every == 0:
            self._compact(n)

    def _compact(self, n: int) -> None:
        """The state up to batch n as the rows of batch n; what that replaces is deleted."""
        alive = self._alive(n + 1)
        kept = {name: materialize(self._current(name, n + 1), f"identity-{name}") for name in ("occurrences", "identities", "components", "quarantined")}
        kept["labels"] = materialize(self._labels(n + 1), "identity-labels")
        kept["families"] = materialize(alive.select("root", F.lit(False).alias("gone")), "identity-families")
        for name, rows in kept.items():
            self._write(rows.drop("n", "bucket"), name, n, "alias" if name == "labels" else "root")
            self._drop_before(name, n)
            discard(rows)

    def _drop_before(self, name: str, n: int) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = folder.getFileSystem(conf)
        for at in fs.listStatus(folder) if fs.exists(folder) else ():
            kind, _, k = at.getPath().getName().partition("=")
            if kind == "n" and int(k) < n:
                fs.delete(at.getPath(), True)

    def start(self, occurrences: DataFrame, checkpoint: str) -> StreamingQuery:
        """A stream of occurrences, batch by batch, until what there is has been read."""
        return occurrences.writeStream.foreachBatch(lambda batch, n: self.update(batch, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
