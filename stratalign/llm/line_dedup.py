"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

The index counts, for every line key, the documents that hold it. The counts are exact and
live in a table (shard, key, n_docs), with a 128-bit digest for a key. Keys that reach
``min_docs`` are common: their fingerprints stand in one cuckoo filter per shard, from which
a key is deleted again when document deletions take its count below the mark. Inserting
documents and deleting the same ones leaves every answer as it was.

Lookups probe the filters first; only lines that a filter lets pass meet the exact table,
so false positives cost a lookup and never a line.

Scale: counting combines on the map side, so one line in a third of all documents arrives
as one row per task. There are as many shards as keep a filter at ``SHARD_KEYS`` keys. While
there are at most ``BROADCAST_KEYS`` common keys (16 bytes each, and about 3 in a filter),
filters and digests go to the tasks that read the texts, where hits are verified and dropped in
one pass without a shuffle. Beyond that filters are sent alone while they are under
``FILTER_BYTES``, lines that passed meet the written exact table in a join that adaptive
execution can split at a hot line, and texts are shuffled once, by document. Past that size
too every line meets the exact table, as a lookup in a filter elsewhere would move as much.

Defined cases: a row is a document, also if its id repeats. Null and empty texts are one
empty line. A line's key is the line stripped of white space at both ends, A-Z lower-cased;
empty keys are never dropped. A null id is an id. Very long texts are taken whole. The columns
``lines_as`` and ``dropped_as`` are added, in place of columns of these names; all others pass
through unchanged. An empty table gives an empty result. Deleting documents that were never
inserted raises where a count would fall below zero, with the index as it was; it can't be
noticed where other documents hold the same lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalign.llm._util import SPACE, discard, in_arrow, materialize, sliced, thrifty, unused_name

FILTER_BYTES = 64 << 20
BROADCAST_KEYS = 500_000
SHARD_KEYS, LEAST_SHARDS = 50_000, 16
#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 1_000
STRIP = SPACE.encode()
SLOTS = 4


def key_of(line: bytes) -> bytes:
    return line.strip(STRIP).lower()  # bytes.lower touches A-Z alone


def digest_of(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def text_bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key has two buckets, each reachable from the other."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: Iterable[bytes], spare: float = 1.4) -> CuckooFilter:
        keys = list(keys)
        buckets = 1 << max(3, int(np.ceil(np.log2(max(1, len(keys)) * spare / SLOTS))))
        while True:
            out = cls(buckets)
            if all(out.insert(k) for k in keys):
                return out
            buckets *= 2

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _swing(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & self.mask
        return mark, first, self._swing(first, mark)

    def insert(self, key: bytes) -> bool:
        mark, first, second = self._place(key)
        for bucket in (first, second):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = second
        for turn in range(400):
            slot = (turn * 7 + bucket) % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self._swing(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, first, second = self._place(key)
        for bucket in (first, second):
            held = np.flatnonzero(self.table[bucket] == mark)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """keys: uint8 array of shape (n, 16)."""
        words = np.ascontiguousarray(keys[:, :8]).view(np.uint64)[:, 0]
        marks = np.ascontiguousarray(keys[:, 8:10]).view(np.uint16)[:, 0].copy()
        marks[marks == 0] = 1
        first = (words & np.uint64(self.mask)).astype(np.int64)
        second = (first ^ (marks.astype(np.int64) * 0x5BD1E995)) & self.mask
        wanted = marks[:, None]
        return (self.table[first] == wanted).any(1) | (self.table[second] == wanted).any(1)


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.ascontiguousarray(keys[:, 10:14]).view(">u4")[:, 0].astype(np.int64) % shards


def shard_column(key: Column, shards: int) -> Column:
    """As ``shards_of``."""
    return F.pmod(F.conv(F.hex(F.substring(key, 11, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


class DigestSet:
    """An exact set of digests in two sorted columns of eight bytes."""

    def __init__(self, digests: bytes):
        both = np.frombuffer(digests, "<u8").reshape(-1, 2)
        order = np.lexsort((both[:, 1], both[:, 0]))
        self.head, self.tail = both[order, 0], both[order, 1]
        runs = np.unique(self.head, return_counts=True)[1]
        self.longest = int(runs.max()) if len(runs) else 0

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """keys: uint8 array of shape (n, 16)."""
        both = np.ascontiguousarray(keys).view("<u8")
        first = np.searchsorted(self.head, both[:, 0])
        found = np.zeros(len(both), bool)
        for step in range(self.longest):
            at = np.minimum(first + step, max(0, len(self.head) - 1))
            found |= (self.head[at] == both[:, 0]) & (self.tail[at] == both[:, 1])
        return found


def without_lines(text: bytes, lines: list[bytes], gone: set[bytes]) -> tuple[bytes, int]:
    """The text without the lines whose digest is in ``gone``, and how many went."""
    kept = [x for x in lines if not (k := key_of(x)) or digest_of(k) not in gone]
    return b"\n".join(kept), len(lines) - len(kept)


def _distinct_digests(text: bytes) -> list[bytes]:
    return [digest_of(k) for k in {key_of(x) for x in text.split(b"\n")} if k]


class LineIndex:
    """Exact counts and filters; every insert or delete writes the next version of both.

    ``shards`` fixes the number of filters; by default it grows with the common keys.
    """

    COUNTS = "key binary, n_docs long"
    FILTERS = "shard int, blob binary"

    def __init__(self, spark: SparkSession, min_docs: int = 10, shards: int | None = None):
        self.spark, self.min_docs, self.fixed = spark, min_docs, shards
        self.shards = shards or LEAST_SHARDS
        self.counts = spark.createDataFrame([], self.COUNTS)
        self.filters = spark.createDataFrame([], self.FILTERS)
        self.n_common = 0
        self.empty = True

    def insert(self, docs: DataFrame, text_col: str = "text") -> None:
        self._update(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> None:
        """Take back documents that were inserted with these texts."""
        self._update(docs, text_col, -1)

    def _update(self, docs: DataFrame, text_col: str, sign: int) -> None:
        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                found = [d for text in text_bytes(batch.column(0)) for d in _distinct_digests(text)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["key"])

        least = self.min_docs
        delta = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(thrifty(keys), "key binary")
        if self.empty:
            summed = delta.groupBy("key").agg((F.count(F.lit(1)) * sign).alias("n_docs")).withColumn("old", F.lit(0).cast("long"))
        else:
            both = delta.select("key", F.lit(0).cast("long").alias("old"), F.lit(sign).cast("long").alias("new"))
            both = both.unionByName(self.counts.select("key", F.col("n_docs").alias("old"), F.col("n_docs").alias("new")))
            summed = both.groupBy("key").agg(F.sum("old").alias("old"), F.sum("new").alias("n_docs"))
        state = materialize(summed.select("key", "old", "n_docs"), "line-counts", arrow_rows=TEXT_ROWS)
        if sign < 0 and state.filter("n_docs < 0").limit(1).count():
            discard(state)
            raise ValueError("documents were deleted that had not been inserted")
        old_counts, old_filters = self.counts, self.filters
        self.counts = state.filter("n_docs > 0").select("key", "n_docs")
        self.n_common = self.common().count()
        wanted = self.fixed or max(LEAST_SHARDS, 1 << (self.n_common // SHARD_KEYS).bit_length())
        renew, self.shards = self.empty or wanted > self.shards, max(wanted, self.shards)
        changed = state.filter((F.col("old") >= least) != (F.col("n_docs") >= least))
        changed = changed.select(shard_column(F.col("key"), self.shards).alias("shard"), "key", (F.col("n_docs") >= least).alias("add"))

        def revise(kept, news):
            import pandas as pd

            adds, drops = news.loc[news["add"], "key"], news.loc[~news["add"], "key"]
            if len(kept):
                out = CuckooFilter.load(kept["blob"].iloc[0])
                fits = all([out.delete(k) for k in drops]) and all([out.insert(k) for k in adds])
            else:
                out, fits = CuckooFilter.of(adds), True
            shard_id = int((kept if len(kept) else news)["shard"].iloc[0])
            return pd.DataFrame({"shard": [shard_id], "blob": [out.dump() if fits else b""]})

        if not renew:
            revised = self.filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(revise, self.FILTERS)
            self.filters = materialize(revised, "line-filters")
            if self.filters.filter(F.length("blob") == 0).limit(1).count():  # a filter is full: larger ones from the exact table
                discard(self.filters)
                renew = True
        if renew:
            self.filters = self._built()
        discard(old_filters)
        if hasattr(old_counts, "_state"):
            discard(old_counts._state)  # noqa: SLF001
        self.counts._state = state  # noqa: SLF001
        self.empty = False

    def _built(self) -> DataFrame:
        def build(news):
            import pandas as pd

            return pd.DataFrame({"shard": [int(news["shard"].iloc[0])], "blob": [CuckooFilter.of(news["key"]).dump()]})

        keys = self.common().select(shard_column(F.col("key"), self.shards).alias("shard"), "key")
        return materialize(keys.groupBy("shard").applyInPandas(build, self.FILTERS), "line-filters")

    def common(self) -> DataFrame:
        """(key) of the keys in at least ``min_docs`` documents."""
        return self.counts.filter(F.col("n_docs") >= self.min_docs).select("key")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_as: str = "n_lines", dropped_as: str = "n_dropped") -> DataFrame:
        """``docs`` with common lines taken out of the text, and with n_lines (before) and n_dropped."""
        out_cols = [c for c in docs.columns if c not in (lines_as, dropped_as)]
        fields = [T.StructField(c, T.StringType() if c == text_col else docs.schema[c].dataType) for c in out_cols]
        schema = T.StructType([*fields, T.StructField(lines_as, T.LongType()), T.StructField(dropped_as, T.LongType())])
        return self._in_place(docs, text_col, schema) if self.n_common <= BROADCAST_KEYS else self._by_key(docs, id_col, text_col, schema)

    def _sent(self):
        return self.spark.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in self.filters.collect()})

    def _in_place(self, docs: DataFrame, text_col: str, schema: T.StructType) -> DataFrame:
        """Filters and exact digests in one pass over the texts."""
        loaded, shards = self._sent(), self.shards
        exact = self.spark.sparkContext.broadcast(b"".join(bytes(r["key"]) for r in self.common().collect()))
        names = schema.names
        columns = names[:-2]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, common = {s: CuckooFilter.load(b) for s, b in loaded.value.items()}, DigestSet(exact.value)
            at = columns.index(text_col)
            for batch in sliced(batches):
                texts = text_bytes(batch.column(at))
                owners, found = [], []
                for row, text in enumerate(texts):
                    mine = _distinct_digests(text)
                    found += mine
                    owners += [row] * len(mine)
                marks = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16)
                keep = np.flatnonzero(_passed(known, marks, shards))
                gone: dict[int, set[bytes]] = {}
                for i in keep[common.contains(marks[keep])].tolist():
                    gone.setdefault(owners[i], set()).add(found[i])
                total, dropped = [t.count(b"\n") + 1 for t in texts], [0] * len(texts)
                for row, mine in gone.items():
                    texts[row], dropped[row] = without_lines(texts[row], texts[row].split(b"\n"), mine)
                yield _rebuilt(batch, at, texts, total, dropped, names)

        return in_arrow(docs.select(*[F.col(f"`{c}`") for c in columns]), thrifty(run), schema)

    def _by_key(self, docs: DataFrame, id_col: str, text_col: str, schema: T.StructType) -> DataFrame:
        """Lines that pass the filters meet the exact table by key, and texts their hits by document."""
        shards, names = self.shards, schema.names
        out_cols = names[:-2]
        total = self.filters.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("n")).first()["n"]
        loaded = self._sent() if total <= FILTER_BYTES else None

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {s: CuckooFilter.load(b) for s, b in loaded.value.items()} if loaded is not None else None
            for batch in sliced(batches):
                owners, found = [], []
                for row, text in enumerate(text_bytes(batch.column(1))):
                    mine = _distinct_digests(text)
                    found += mine
                    owners += [row] * len(mine)
                marks = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16)
                keep = np.flatnonzero(_passed(known, marks, shards)) if known is not None else np.arange(len(found))
                ids = batch.column(0).take(pa.array(np.array(owners, np.int64)[keep]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([found[i] for i in keep], pa.binary())], ["line_doc", "key"])

        id_type = docs.schema[id_col].dataType
        probed = docs.select(F.col(id_col).alias("line_doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            thrifty(probe), T.StructType([T.StructField("line_doc", id_type), T.StructField("key", T.BinaryType())])
        )
        hits = materialize(probed.join(self.common(), "key").groupBy("line_doc").agg(F.collect_set("key").alias("line_hits")), "line-hits", arrow_rows=TEXT_ROWS)

        def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = out_cols.index(text_col)
            for batch in sliced(batches):
                texts, total, dropped = text_bytes(batch.column(at)), [], []
                for row, marks in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    lines = texts[row].split(b"\n")
                    total.append(len(lines))
                    dropped.append(0)
                    if marks:
                        texts[row], dropped[row] = without_lines(texts[row], lines, set(marks))
                yield _rebuilt(batch, at, texts, total, dropped, names)

        plain = [f"c{i}" for i in range(len(out_cols))]
        left = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(out_cols, plain, strict=True)])
        joined = left.join(hits, F.col(plain[out_cols.index(id_col)]).eqNullSafe(F.col("line_doc")), "left").select(*plain, "line_hits")
        return in_arrow(joined, thrifty(rebuild), schema)


def _passed(known: dict[int, CuckooFilter], marks: np.ndarray, shards: int) -> np.ndarray:
    """Which digests the filter of their shard holds."""
    at, out = shards_of(marks, shards), np.zeros(len(marks), bool)
    order = np.argsort(at, kind="stable")
    ends = np.flatnonzero(np.diff(at[order])) + 1
    for mine in np.split(order, ends) if len(order) else ():
        held = known.get(int(at[mine[0]]))
        if held is not None:
            out[mine] = held.contains(marks[mine])
    return out


def _rebuilt(batch: pa.RecordBatch, at: int, texts: list[bytes], total: list[int], dropped: list[int], names: list[str]) -> pa.RecordBatch:
    """The batch's columns with the texts in place of column ``at``, and the counts."""
    columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(names) - 2)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names)


def dedup_lines(
    docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None,
    lines_as: str = "n_lines", dropped_as: str = "n_dropped",
) -> DataFrame:
    """Index the documents and apply the index to them."""
    index = LineIndex(docs.sparkSession, min_docs, shards)
    index.insert(docs, text_col)
    return index.apply(docs, id_col, text_col, lines_as, dropped_as)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with common lines taken out of the text, its columns as they are, whatever their names."""
    n, gone = unused_name(docs.columns, "n_lines"), unused_name(docs.columns, "n_dropped")
    return dedup_lines(docs, min_docs, id_col, text_col, lines_as=n, dropped_as=gone).select(*[F.col(f"`{c}`") for c in docs.columns])
