"""The trie of conversations: which prefixes of turns they share, and what sharing them saves.

A node is a different sequence of first turns. Conversations are scanned in order, and numpy gives each
turn the polynomial fingerprint of the prefix that it ends: the running sum of turn hash times base to
the depth, modulo two primes. Equal fingerprints at one depth are candidates for one node. Each
group's turns are then held, byte for byte, against those of its representative, the smallest
conversation; since equal turns subtract alike, a group that agrees turn by turn agrees in its whole
prefixes. Where a group disagrees, the conversations in it are scanned again with another hash and
base from that depth on, which splits it; this is repeated until no group disagrees.

A conversation represents the nodes of its path from some depth on, its branch. What a subtree
holds is the sum over branches, so parents are rolled up without a walk from level to level: a branch adds
its total to the nodes above it, and within the branch a sum from below does the rest.

Everything is grouped by (depth, fingerprint) with partial sums before the shuffle, so that a first
turn that a third of all conversations share is a row per task. Parents with very many children
are looked up from a table of bounded size. Identifiers that end at a node are joined in blocks,
and their digest is taken from the blocks as a stream.

Defined cases: rows without a conversation identifier take no part; a null role or text is the empty one; turns
are ordered by turn (null first), then role, then text; equal rows of one conversation are turns of their own;
an empty table gives no nodes. The turns of one conversation pass through one task as a stream of batches,
which keeps no more than a batch. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalign.llm._util import arrow_batches, discard, materialize, or_empty, sliced, thrifty

#: The primes of the fingerprint's two halves, and the bases that seeds start from.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
#: Identifiers in a block of those that end at a node.
BLOCK = 1024
#: Parents whose children are looked up from a broadcast table: at most so many.
BROADCAST_PARENTS = 50_000
NODE = ("depth", "key")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text."""
    return conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", or_empty(F.col("role")).alias("role"), or_empty(F.col("text")).alias("text"))


def _in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def plain_plan(turns: DataFrame) -> DataFrame:
    """Every conversation as it is: rows for ``fingerprints``."""
    return turns.select("conv_id", F.lit(1).alias("own"), F.lit(0).alias("skip"), "turn", "role", "text")


def grafted(turns: DataFrame, every: int = 20, modulus: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of the conversation that begins their block of ``every``.

    h is the CRC-32 of the identifier's digits modulo ``modulus``. own is 0 for a turn that is taken over
    and 1 for one of the conversation's own, of which the first ``skip`` don't count.
    """
    c = F.col("conv_id")
    base, h = c - c % every, (F.crc32(c.cast("string").cast("binary")) % modulus).cast("int")
    ranked = turns.filter(c % every == 0).withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy(*_in_order())))
    heads = materialize(ranked.filter(F.col("rank") < modulus).withColumnRenamed("conv_id", "base").drop("turn"), "trie-heads")
    others = turns.select("conv_id").distinct().filter(c % every != 0).select("conv_id", base.alias("base"), h.alias("h"))
    taken = others.join(heads, "base").filter("rank <= h").select("conv_id", F.lit(0).alias("own"), F.lit(0).alias("skip"), F.col("rank").cast("long").alias("turn"), "role", "text")
    own = turns.select("conv_id", F.lit(1).alias("own"), F.when(c % every == 0, 0).otherwise(h).cast("int").alias("skip"), "turn", "role", "text")
    return taken.unionByName(own)


class Powers:
    """Powers of a base modulo a prime, doubled as deeper turns come."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime, self.at = base, np.uint64(prime), np.ones(1, np.uint64)

    def upto(self, depth: int) -> np.ndarray:
        while len(self.at) <= depth:
            step = np.uint64(int(self.at[-1]) * self.base % int(self.prime))
            self.at = np.concatenate([self.at, self.at * step % self.prime])
        return self.at


class PrefixScan:
    """Depths and fingerprints of turns in order; what is open at a batch's end is carried to the next."""

    def __init__(self, seed: int = 0, primes: tuple[int, int] = PRIMES):
        self.primes = [np.uint64(p) for p in primes]
        self.powers = [Powers(b * (2 * seed + 1) % p or 2, p) for b, p in zip(BASES, primes, strict=True)]
        self.conv, self.owned, self.depth, self.sums = None, 0, 0, [0, 0]

    def feed(self, conv: np.ndarray, own: np.ndarray, skip: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(which rows count, first rows of conversations, depths, prefix and parent fingerprints) of a batch."""
        n = len(conv)
        new = np.empty(n, bool)
        new[0], new[1:] = self.conv is None or conv[0] != self.conv, conv[1:] != conv[:-1]
        run = np.cumsum(new) - new[0]  # number of the conversation within the batch
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        carried = not new[0]

        def within(values: np.ndarray, carry: int) -> np.ndarray:
            """Running sums that start over with each conversation."""
            total = np.cumsum(values)
            before = np.concatenate([[0], total])[first].astype(total.dtype)
            if carried:
                before = before.astype(np.int64)
                before[0] -= carry
                return total.astype(np.int64) - before[run]
            return total.astype(np.int64) - before.astype(np.int64)[run]

        rank = within(own.astype(np.int64), self.owned)
        counts = (own == 0) | (rank > skip)
        depth = within(counts.astype(np.int64), self.depth)
        ends, parents = [], []
        for k, (p, powers) in enumerate(zip(self.primes, self.powers, strict=True)):
            high = (hashes.view(np.uint64) >> np.uint64(32)) if k else hashes.view(np.uint64)
            term = np.where(counts, high % p * powers.upto(int(depth.max(initial=0)))[depth] % p, np.uint64(0)).astype(np.int64)
            sums = within(term, self.sums[k])
            ends.append(sums % int(p))
            parents.append((sums - term) % int(p))
            self.sums[k] = int(sums[-1]) % int(p)
        self.conv, self.owned, self.depth = conv[-1], int(rank[-1]), int(depth[-1])
        key, above = ((x[0] << 31) | x[1] for x in (ends, parents))
        return counts, new, depth, key, above


def fingerprints(plan: DataFrame, seed: int = 0, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(conv_id, depth, key, parent, role, text, words) of every turn that counts, and a row of depth 0 per conversation."""
    rows = plan.select("conv_id", "own", "skip", "turn", "role", "text", F.xxhash64(F.lit(seed), "role", "text").alias("hash"), words(F.col("text")).alias("words"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "own", *_in_order()).drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = PrefixScan(seed, primes)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            conv, own, skip, hashes = (at[c].to_numpy(zero_copy_only=False) for c in ("conv_id", "own", "skip", "hash"))
            counts, new, depth, key, above = scan.feed(conv, own, skip, hashes)
            kept, roots = pa.array(counts), int(new.sum())
            if roots:
                zero, empty = pa.array(np.zeros(roots, np.int64)), pa.array([""] * roots, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(conv[new]), zero, zero, pa.nulls(roots, pa.int64()), empty, empty, zero], NAMES)
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array(conv[counts]), pa.array(depth[counts]), pa.array(key[counts]), pa.array(above[counts]), *[at[c].filter(kept) for c in ("role", "text", "words")]], NAMES)

    return rows.mapInArrow(thrifty(run), "conv_id long, depth long, key long, parent long, role string, text string, words long")


NAMES = ["conv_id", "depth", "key", "parent", "role", "text", "words"]


def _nodes(members: DataFrame) -> DataFrame:
    """(depth, key, parent, rep, n, words), one row per different turn of a group of candidates.

    Turns are grouped by their bytes, so the rows of a group beside its representative's are its collisions.
    """
    same = members.groupBy("depth", "key", "parent", "fix", "up", "role", "text").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("words").alias("words"))
    return same.drop("role", "text")


def verified(plan: DataFrame, primes: tuple[int, int] = PRIMES, arrow_rows: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(members, nodes): turns with the keys of their nodes, and one row per node, free of collisions."""
    spark = plan.sparkSession
    with arrow_batches(spark, arrow_rows):
        members = materialize(fingerprints(plan, 0, primes).withColumns({"fix": F.lit(""), "up": F.lit("")}), "trie-members")
    seed = 0
    while True:
        nodes = materialize(_nodes(members), "trie-nodes")
        torn = nodes.groupBy("depth", "key", "fix").agg(F.count(F.lit(1)).alias("turns")).filter("turns > 1").select("depth", "key", "fix")
        torn = materialize(torn, "trie-torn")
        if not torn.limit(1).count():
            discard(torn)
            return members, nodes
        seed += 1
        before, members = members, _split(members, torn, seed, primes, arrow_rows)
        discard(before, nodes, torn)


def _split(members: DataFrame, torn: DataFrame, seed: int, primes: tuple[int, int], arrow_rows: int) -> DataFrame:
    """Members whose path meets a torn group are scanned again, and get a second fingerprint from there on."""
    hit = members.join(torn, ["depth", "key", "fix"], "left_semi").groupBy("conv_id").agg(F.min("depth").alias("since"))
    hit = materialize(hit, "trie-hit")
    again = members.join(hit, "conv_id", "left_semi").filter("depth > 0")
    plan = again.select("conv_id", F.lit(1).alias("own"), F.lit(0).alias("skip"), F.col("depth").alias("turn"), "role", "text")
    with arrow_batches(members.sparkSession, arrow_rows):
        new = fingerprints(plan, seed, primes).filter("depth > 0").select("conv_id", "depth", F.col("key").alias("k2"), F.col("parent").alias("p2"))
        out = members.join(hit, "conv_id", "left").join(new, ["conv_id", "depth"], "left").select(
            *NAMES,
            F.when(F.col("depth") >= F.col("since"), F.concat("fix", F.lit("."), "k2")).otherwise(F.col("fix")).alias("fix"),
            F.when(F.col("depth") > F.col("since"), F.concat("up", F.lit("."), "p2")).otherwise(F.col("up")).alias("up"),
        )
        out = materialize(out, "trie-members")
    discard(hit)
    return out


def _digests(ended: DataFrame) -> DataFrame:
    """(depth, key, fix, ends): SHA-256 of the identifiers (conv_id) that end at each node, in order, joined by commas."""
    block = F.floor(F.col("conv_id") / BLOCK)
    blocks = ended.groupBy("depth", "key", "fix", block.alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    rows = blocks.select("depth", "key", "fix", "block", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))
    rows = rows.repartition("depth", "key", "fix").sortWithinPartitions("depth", "key", "fix", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []

        def full() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["depth", "key", "fix", "ends"])

        for batch in sliced(batches, 1000):
            for depth, key, fix, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
                if node != (depth, key, fix):
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (depth, key, fix), hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(done) >= 1000:
                yield full()
        if node is not None:
            done.append((*node, state.hexdigest()))
            yield full()

    return rows.mapInArrow(run, "depth long, key long, fix string, ends string")


def trie(plan: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    members, flat = verified(plan, primes)
    node, above = ["depth", "key", "fix"], (F.col("depth") - 1).alias("depth")
    children = flat.filter("depth > 0").groupBy(above, F.col("parent").alias("key"), F.col("up").alias("fix")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(flat.join(children, node, "left").fillna(0, ["n_children"]), "trie-counted")
    branches = nodes.groupBy("rep").agg(
        F.min("depth").alias("since"), F.sum((F.col("n") - 1) * F.col("words")).alias("saves"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"),
        F.min_by(F.struct("parent", "up"), "depth").alias("top"),
    )
    branches = materialize(branches, "trie-branches")
    # what branches add to the nodes above them
    adding = branches.filter("since > 0 AND (saves > 0 OR leaves > 0)").select(F.col("rep").alias("conv_id"), "since", "saves", "leaves")
    added = members.select("conv_id", *node).join(adding, "conv_id").filter("depth < since").groupBy(*node).agg(F.sum("saves").alias("more_saves"), F.sum("leaves").alias("more_leaves"))
    # ends of conversations: the deepest row of each
    ends = members.groupBy("conv_id").agg(F.max(F.struct(*node)).alias("end")).select("conv_id", *[F.col(f"end.{c}").alias(c) for c in node])
    ended = _digests(ends)
    # representatives of branches' parents
    n = branches.count()
    heavy_at = max(64, n // BROADCAST_PARENTS)
    tops = branches.filter("since > 0").select(F.col("rep").alias("child"), (F.col("since") - 1).alias("depth"), F.col("top.parent").alias("key"), F.col("top.up").alias("fix"))
    heavy = F.broadcast(nodes.filter(F.col("n_children") >= heavy_at).select(*node, F.col("rep").alias("above")))
    near = tops.join(heavy, node, "left")
    light = nodes.filter((F.col("n_children") > 0) & (F.col("n_children") < heavy_at)).select(*node, F.col("rep").alias("above"))
    looked = near.filter("above IS NOT NULL").select("child", "above").unionByName(near.filter("above IS NULL").drop("above").join(light, node).select("child", "above"))
    looked = looked.withColumnRenamed("child", "rep")
    below = W.partitionBy("rep").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    full = nodes.join(branches.select("rep", "since", F.col("leaves").alias("own_leaves")), "rep").join(looked, "rep", "left").withColumn("own_saves", F.sum((F.col("n") - 1) * F.col("words")).over(below))
    full = full.join(added, node, "left").join(ended, node, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = full.select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("since"), F.col("rep")).otherwise(F.col("above")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        (F.col("own_leaves") + zero("more_leaves")).alias("n_leaves"), (F.col("own_saves") + zero("more_saves")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    out = materialize(out, "trie")
    discard(members, flat, nodes, branches)
    return out
