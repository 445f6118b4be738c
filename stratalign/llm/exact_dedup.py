"""Exact document dedup on a log-structured merge index, DataFrame operations only.

Documents arrive in memtables of (digest, identifier, count). A memtable is first probed
against the runs that are there: a run's filter (blocked Bloom words, one array per shard of
digests) lets a digest pass or proves it new, and what passes meets the run itself. Then the
memtable is flushed as a run of its own, a Parquet table sorted by digest, with its filter. A tier
that has ``fanout`` runs is compacted into one run of the next tier; compaction merges equal
digests, keeps the smallest (or largest) identifier and adds the counts. Digests only nominate
copies. Every hit, a digest that a memtable holds twice or that a run held already, is then
verified on its bytes: the texts of all hits are grouped by (digest, whole text), and a
digest with two different texts is split.

Scale: the index holds one narrow row per different digest. A memtable is aggregated on the map
side before its shuffle, so a text that fills a third of the corpus arrives as one row per
map task. Filters are broadcast while a run's are below ``FILTER_BYTES`` together, and met by
shard beyond that. Only texts of hits are shuffled, likewise collapsed on the map side. The last
join meets written tables, so that adaptive execution can split a digest that many rows hold.

Defined cases: a null text counts as the empty text, very long texts are compared whole. Repeated
rows are documents of their own. Identifiers may be of any ordered type; a null one loses to
any other. An empty table gives an empty result. Columns other than the identifier and the
text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalign.llm._util import discard, materialize, new_path, or_empty

#: Digest sets up to this size may be broadcast (64 bytes a row at most).
BROADCAST_ROWS = 500_000
#: Filters of a run up to this size may be broadcast.
FILTER_BYTES = 32 << 20
#: 64-bit words of a filter, and the keys it is made for: about 13 bits a key, three of them set in one word.
WORDS, KEYS = 4096, 20_000


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _slots(digest: Column, shards: int) -> list[Column]:
    """shard, word and mask of a digest."""
    spread, bits = F.xxhash64(digest), F.xxhash64(digest, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(3):
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    word = F.shiftrightunsigned(spread, 40).bitwiseAND(F.lit(WORDS - 1)).cast("int")
    return [F.pmod(F.xxhash64(digest, F.lit(2)), F.lit(shards)).cast("int").alias("shard"), word.alias("word"), mask.alias("mask")]


class Run:
    """A sorted table (digest, id, n) and its filter (shard, words)."""

    def __init__(self, rows: DataFrame, filters: DataFrame, shards: int):
        self.rows, self.filters, self.shards = rows, filters, shards

    def passing(self, digests: DataFrame) -> DataFrame:
        """The rows of ``digests`` (digest, ...) that the filter does not prove absent."""
        kept = digests.columns
        small = self.shards * WORDS * 8 <= FILTER_BYTES
        met = digests.select("*", *_slots(F.col("digest"), self.shards)).join(F.broadcast(self.filters) if small else self.filters, "shard")
        return met.filter(F.get("words", F.col("word")).bitwiseAND(F.col("mask")) == F.col("mask")).select(*kept)


class ExactDedupIndex:
    """Runs and their tiers. ``keep`` is 'min' or 'max': which identifier represents equal texts."""

    def __init__(self, spark: SparkSession, keep: str = "min", fanout: int = 4, path: str | None = None):
        if keep not in ("min", "max"):
            raise ValueError("keep must be 'min' or 'max'")
        self.spark, self.keep, self.fanout = spark, keep, fanout
        self.path = path or new_path(spark, "lsm")
        self.tiers: list[list[Run]] = [[]]
        self._serial = 0

    @property
    def runs(self) -> list[Run]:
        return [r for tier in self.tiers for r in tier]

    def _merge(self, entries: DataFrame) -> DataFrame:
        pick = F.max if self.keep == "max" else F.min
        return entries.groupBy("digest").agg(pick("id").alias("id"), F.sum("n").alias("n"))

    def _write_run(self, merged: DataFrame) -> Run:
        self._serial += 1
        at = f"{self.path}/run-{self._serial:05d}"
        rows = materialize(merged.select("digest", "id", "n").sortWithinPartitions("digest"), "", at)
        shards = max(1, -(-rows.count() // KEYS))
        bits = rows.select(*_slots(F.col("digest"), shards))
        blank = self.spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1))).alias("word"), F.lit(0).cast("long").alias("mask"))
        words = bits.unionByName(blank).groupBy("shard", "word").agg(F.bit_or("mask").alias("bits"))
        filters = words.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
        return Run(rows, materialize(filters, "", f"{at}-filter"), shards)

    def insert(self, entries: DataFrame) -> DataFrame:
        """Flush one memtable of (digest, id) as a run; compact full tiers. Returns the (digest) of its hits."""
        memtable = materialize(self._merge(entries.select("digest", "id", F.lit(1).cast("long").alias("n"))), "dedup-memtable")
        hits = memtable.filter("n > 1").select("digest")
        if self.runs:
            hits = hits.unionByName(self.probe(memtable).select("digest")).distinct()
        hits = materialize(hits, "dedup-hits")
        self.tiers[0].append(self._write_run(memtable))
        discard(memtable)
        for level in range(len(self.tiers)):
            if len(self.tiers[level]) >= self.fanout:
                self._compact(level)
        return hits

    def _replace(self, runs: list[Run]) -> Run:
        union = runs[0].rows
        for run in runs[1:]:
            union = union.unionByName(run.rows)
        merged = self._write_run(self._merge(union))
        for run in runs:
            discard(run.rows, run.filters)
        return merged

    def _compact(self, level: int) -> None:
        runs = self.tiers[level]
        if level + 1 == len(self.tiers):
            self.tiers.append([])
        self.tiers[level + 1].append(self._replace(runs))
        self.tiers[level] = []

    def major_compact(self) -> DataFrame:
        """All runs merged into one: (digest, id, n)."""
        if len(self.runs) > 1:
            merged = self._replace(self.runs)
            self.tiers = [[] for _ in self.tiers] + [[merged]]
        return self.runs[0].rows if self.runs else self.spark.createDataFrame([], "digest string, id long, n long")

    def probe(self, digests: DataFrame) -> DataFrame:
        """Indexed (digest, id, n) of the given digests: filters first, then the runs."""
        asked, found = digests.select("digest"), None
        for run in self.runs:
            mine = run.rows.join(run.passing(asked), "digest", "left_semi")
            found = mine if found is None else found.unionByName(mine)
        return self._merge(found) if found is not None else self.spark.createDataFrame([], "digest string, id long, n long")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    memtables: int = 4,
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``memtables`` is the number of flushes that the batch is split into, by a hash of
    the identifier; ``digest`` may be replaced, for example by a weak one in tests.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), or_empty(F.col(text_col)).alias("text"))
    columns = [F.col("id"), digest(F.col("text")).alias("digest"), *([sha256_hex(F.col("text")).alias("sha")] if digest is not sha256_hex else [])]
    # each memtable is a folder of its own, so that none is read for another
    at = new_path(spark, "dedup-entries")
    arriving = rows.select(*columns, F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int").alias("memtable"))
    arriving.write.partitionBy("memtable").parquet(at)
    entries = spark.read.schema(arriving.schema).parquet(at)
    index = ExactDedupIndex(spark, keep=keep, fanout=max(2, memtables))
    hits = None
    for k in range(memtables):
        new = index.insert(entries.filter(F.col("memtable") == k))
        hits = new if hits is None else hits.unionByName(new)
    merged = index.major_compact()
    hits = materialize(hits.distinct(), "dedup-hits")
    n_hits = hits.count()
    hit_set = F.broadcast(hits) if n_hits <= BROADCAST_ROWS else hits
    pick = F.max if keep == "max" else F.min
    verified = materialize(
        rows.withColumn("digest", digest(F.col("text"))).join(hit_set, "digest", "left_semi")
        .groupBy("digest", "text").agg(pick("id").alias("id"), F.count(F.lit(1)).alias("n")),
        "dedup-verified",
    ) if n_hits else None
    torn = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest") if n_hits else None
    n_torn = torn.count() if n_hits else 0

    def result(pairs: DataFrame, sha: Column) -> DataFrame:
        # (no identifier at all: the only one that stays is the first, which nobody can tell apart)
        return pairs.select(
            F.col("e.id").alias(id_col), F.col("k.id").alias("keep_id"), F.col("k.n").alias("group_size"),
            F.coalesce(F.col("e.id") == F.col("k.id"), F.col("k.id").isNull()).alias("kept"), sha.alias("text_sha256"),
        )

    own = F.col("e.sha") if "sha" in entries.columns else F.col("e.digest")
    if not n_torn:
        return result(entries.alias("e").join(merged.alias("k"), F.col("e.digest") == F.col("k.digest")), own)
    torn_set = materialize(torn, "dedup-torn")
    sound = entries.join(torn_set, "digest", "left_anti").alias("e").join(merged.alias("k"), F.col("e.digest") == F.col("k.digest"))
    split_rows = rows.select("id", "text", digest(F.col("text")).alias("digest"), sha256_hex(F.col("text")).alias("sha")).join(torn_set, "digest", "left_semi")
    split = split_rows.alias("e").join(verified.alias("k"), (F.col("e.digest") == F.col("k.digest")) & (F.col("e.text") == F.col("k.text")))
    return result(sound, own).unionByName(result(split, F.col("e.sha")))
