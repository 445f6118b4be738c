"""Near-duplicate classes from bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch is the k
smallest of them. Documents with equal sets are one node from the start. Inverted lists of
retained values nominate nodes: two sets of Jaccard similarity t or more share at
least c of their k retained values (for t = 0.8 and k = 64, c = 32 but for one pair in
5e7; exactly where a set is no larger than its sketch), so if all values are put in one
order, they share a value among the first k - c + 1 of each. Rare values come first in that
order: a passage that thousands of documents hold stands at its end and makes no list
unless it is most of the document. Most documents are on no list; for those that are, lists
of 1024 retained values are made in the same way, which are the whole sets of all but long
texts, and a pair needs as many values in common as the two sizes demand.

Within a list pairs are not all tried. Rounds take a few pivots per list (one at first, up to
twice as many in each later round) and try the other members against them. Members that are
linked join a class; a pivot has met its whole list and leaves it. Pivots come from the classes
that have the fewest members in the list. A list ends when its members are one class or its last
pivots have met, so no link between two classes is missed, and a list with m members outside
its largest class ends after about log2(m) rounds. A tried pair passes the estimate of its
similarity from the union sketch first and is then confirmed on the full sets.

With ``exact`` the whole sets are the sketches: nothing is estimated, and no risk is taken.

Scale: the text is read twice, once for sketches (0.5 kB a document) and once for the full
sets of nominated nodes. Nothing is collected. Joins meet written tables, so that adaptive
execution can split the rows of a value that very many nodes hold.

Defined cases: A-Z is lower-cased and words are runs of anything but white space. With
fewer words than a shingle has, the whole sequence is the one shingle; without words the
set is empty and linked with nothing. Rows of one id are one document, also if their texts
differ: each row has the size of its own set, and what any of them is linked with is linked
with all of them. Rows without an id are linked with nothing. Ids are integers; a text that
is no integer raises. Repeated rows and very long texts are taken whole, other columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalign.llm._util import discard, materialize, sliced, thrifty, unused_name
from stratalign.llm.components import connected_components
from stratalign.llm.line_dedup import text_bytes

BROADCAST_IDS = 1_000_000
#: Rows of an Arrow batch that holds whole texts or whole sets.
TEXT_ROWS, SET_ROWS = 1_000, 256
_MEMO = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def shingle_set(text: bytes, width: int, memo: _Hashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (uint64)."""
    words = text.lower().split()  # bytes: A-Z, and the white space of ASCII
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    span = min(n, width)
    out = np.full(n - span + 1, (span * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(span):
        out += _mixed(h[i : n - span + 1 + i] + np.uint64((i + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        out *= np.uint64(0x9FB21C651E98DF25)
    return np.unique(_mixed(out))


def least_overlap(k: int, threshold: float, risk: float = 2e-8) -> int:
    """The most values that may be demanded of two sketches at the threshold, at this risk of missing a pair."""
    if threshold >= 1:
        return k
    below, c = 0.0, 0
    while True:
        below += exp(lgamma(k + 1) - lgamma(c + 1) - lgamma(k - c + 1) + c * log(threshold) + (k - c) * log1p(-threshold))
        if below > risk:
            return c
        c += 1


def _digest(members: np.ndarray) -> bytes | None:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in sliced(batches):
            sizes, digests, flat, ends = [], [], [], [0]
            for text in text_bytes(batch.column(1)):
                s = shingle_set(text, width, memo)
                sizes.append(len(s))
                digests.append(_digest(s))
                flat.append(s[:k])
                ends.append(ends[-1] + min(k, len(s)))
                if len(memo) > _MEMO:
                    memo.clear()
            values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), sketch], ["id", "n", "digest", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        thrifty(run), "id long, n long, digest binary, sketch array<long>"
    )


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(digest, members) of every (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in sliced(batches):
            sets, digests = [], []
            for text in text_bytes(batch.column(1)):
                s = shingle_set(text, width, memo)
                digests.append(_digest(s))
                sets.append(s.tobytes())
                if len(memo) > _MEMO:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["digest", "members"])

    return docs.mapInArrow(thrifty(run), "digest binary, members binary")


def _members(column: pa.Array) -> list[np.ndarray]:
    """The sets of a binary column, without copies."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _confirmed(pairs: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of (a, b, sa, sb) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SET_ROWS):
            links = []
            for p, q in zip(_members(batch.column(2)), _members(batch.column(3)), strict=True):
                common = len(np.intersect1d(p, q, assume_unique=True))
                links.append(100 * common >= per_cent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(links, pa.bool_()))

    return pairs.mapInArrow(thrifty(run), "a long, b long")


def _plausible(x: Column, y: Column, k: int, c: int, per_cent: int) -> Column:
    """The union-sketch estimate allows the threshold; exact where the union is smaller than k."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(x, y)))
    return F.when(F.size(union) < k, shared * 100 >= F.size(union) * per_cent).otherwise(shared >= c)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    per_cent: int = 80,
    k: int = 64,
    k_lists: int = 1024,
    exact: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    ``k`` values of every document nominate nodes; of nominated nodes ``k_lists`` make the lists.
    """
    if exact:
        k = k_lists = 1 << 30
    sketches = materialize(_sketches(docs, id_col, text_col, width, k), "near-sketches", arrow_rows=TEXT_ROWS)
    # a node is a set, whatever the ids that hold it; its number is fixed by being written
    grouped = sketches.filter("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    # ids that several different texts share
    held = sketches.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count("digest").alias("full"), F.min("digest").alias("d1"), F.max("digest").alias("d2"))
    twins = materialize(held.filter("d1 <> d2 OR (full > 0 AND full < rows)").select("id"), "near-twins")
    some_twins = twins.limit(1).count() > 0
    classes, tables = _classes(docs, id_col, text_col, width, per_cent, k, k_lists, exact, nodes)
    if some_twins:  # one id's texts are one document
        own = sketches.filter("digest IS NOT NULL").join(twins, "id").select("id", "digest").distinct().join(nodes.select("digest", "node"), "digest")
        at = own.select("id", "node") if classes is None else own.join(classes, "node", "left").select("id", F.coalesce("label", "node").alias("node"))
        at = materialize(at.distinct(), "near-own")
        hub = at.groupBy("id").agg(F.min("node").alias("hub"))
        edges = at.join(hub, "id").select(F.col("node").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct()
        joined = connected_components(edges).select(F.col("id").alias("from"), F.col("label").alias("to"))
        if classes is None:
            classes = joined.select(F.col("from").alias("node"), F.col("to").alias("label"))
        else:
            lone = joined.join(classes.select(F.col("node").alias("from")), "from", "left_anti").select(F.col("from").alias("node"), F.col("to").alias("label"))
            classes = classes.join(joined, classes["label"] == joined["from"], "left").select("node", F.coalesce("to", "label").alias("label")).unionByName(lone)
    keyed = nodes.select("digest", "least", "node")
    if classes is None:
        keyed = keyed.select("digest", F.col("least").alias("component"))
    else:
        known = materialize(keyed.join(classes, "node", "left").select("digest", "least", F.coalesce("label", "node").alias("label")), "near-known")
        lowest = known.groupBy("label").agg(F.min("least").alias("component"))
        keyed = materialize(known.join(lowest, "label").select("digest", "component"), "near-components")
        discard(known)
    rows = sketches.select("id", "n", "digest").join(keyed, "digest", "left")
    if some_twins:  # a row without words goes with the other rows of its id
        mine = at.join(nodes.select("node", "digest"), "node").join(keyed, "digest").groupBy("id").agg(F.min("component").alias("same"))
        rows = rows.join(F.broadcast(mine) if mine.count() <= BROADCAST_IDS else mine, "id", "left").withColumn("component", F.coalesce("component", "same"))
    discard(*tables)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _ranked(values: DataFrame, per_cent: int, c: int) -> DataFrame:
    """(value, node, n, m, rank, lone): the values (node, n, m, value) that another node holds too and
    that stand early enough in their node's order, rare ones first, to prove a similar partner.

    ``rank`` counts the node's values that it holds alone (``lone`` of them) first: they are the rarest.
    """
    often = materialize(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "near-often")
    shared = values.join(often, "value")
    mine = W.partitionBy("node")
    need = F.least(F.ceil(F.col("n") * per_cent / 100.0), F.lit(c))
    ranked = shared.withColumns({"row": F.row_number().over(mine.orderBy("df", "value")), "lone": F.col("m") - F.count(F.lit(1)).over(mine)})
    out = materialize(ranked.withColumn("rank", F.col("row") + F.col("lone")).filter(F.col("rank") <= F.col("m") - need + 1).select("value", "node", "n", "m", "rank", "lone"), "near-ranked")
    discard(often)
    return out


def _mixed_lists(placed: DataFrame, by: str) -> DataFrame:
    """(value): lists with members of different ``by``."""
    ends = placed.groupBy("value").agg(F.min(by).alias("l1"), F.max(by).alias("l2"))
    return materialize(ends.filter("l1 <> l2").select("value"), "near-mixed")


def _involved(nodes: DataFrame, per_cent: int, c: int) -> DataFrame:
    """(node): nodes that are on a list with another one."""
    values = nodes.select("node", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    lists = _ranked(values, per_cent, c)
    twice = _mixed_lists(lists, "node")
    out = materialize(lists.select("value", "node").join(twice, "value").select("node").distinct(), "near-involved")
    discard(lists, twice)
    return out


def _may_meet(x: str, y: str, per_cent: int, k: int, c: int) -> Column:
    """Rows x and y of one list prove that their nodes can reach the threshold, sizes considered.

    Where both sets are whole, they need per_cent / (100 + per_cent) of their sizes' sum in common.
    """
    f = lambda p, name: F.col(f"{p}{name}")
    whole = (f(x, "n") <= k) & (f(y, "n") <= k)
    need = F.when(whole, F.ceil((f(x, "n") + f(y, "n")) * per_cent / (100.0 + per_cent))).otherwise(c)
    sizes = F.least(f(x, "n"), f(y, "n")) * 100 >= F.greatest(f(x, "n"), f(y, "n")) * per_cent
    return sizes & (f(x, "rank") <= f(x, "m") - need + 1) & (f(y, "rank") <= f(y, "m") - need + 1)


def _retained(sets: DataFrame, k: int) -> DataFrame:
    """(node, n, m, value) of the k smallest members of every full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SET_ROWS):
            members = [x.view(np.int64) for x in _members(batch.column(1))]
            sizes = np.array([len(x) for x in members], np.int64)
            held = np.minimum(sizes, k)
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), held)
            values = np.concatenate([x[:k] for x in members]) if members else np.empty(0, np.int64)
            columns = [nodes, np.repeat(sizes, held), np.repeat(held, held), values]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "n", "m", "value"])

    return sets.select("node", "members").mapInArrow(thrifty(run), "node long, n long, m long, value long")


FIELDS = ("node", "n", "m", "rank", "label")


def _side(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select("value", *[F.col(c).alias(f"{prefix}{c}") for c in FIELDS])


def _linked(pairs: DataFrame, short: DataFrame, sets: DataFrame, k: int, c: int, per_cent: int) -> DataFrame | None:
    """The pairs (a, b) that are links, or None: estimated on the sketches, confirmed on the full sets.

    Only the sketches and sets of nodes that are in a pair are moved.
    """

    def of_nodes(table: DataFrame, of: DataFrame, n: int) -> DataFrame:
        ids = of.select(F.col("a").alias("node")).unionByName(of.select(F.col("b").alias("node"))).distinct()
        return table.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "node", "left_semi")

    n_pairs = pairs.count()
    if not n_pairs:
        return None
    sketches = of_nodes(short.select("node", "sketch"), pairs, n_pairs)
    sketch = lambda x, y: sketches.select(F.col("node").alias(x), F.col("sketch").alias(y))
    likely = pairs.join(sketch("a", "x"), "a").join(sketch("b", "y"), "b").filter(_plausible(F.col("x"), F.col("y"), k, c, per_cent)).select("a", "b")
    likely = materialize(likely, "near-likely")
    n_likely = likely.count()
    if not n_likely:
        discard(likely)
        return None
    whole = of_nodes(sets, likely, n_likely)
    member = lambda x, y: whole.select(F.col("node").alias(x), F.col("members").alias(y))
    loaded = likely.join(member("a", "sa"), "a").join(member("b", "sb"), "b")
    found = materialize(_confirmed(loaded.select("a", "b", "sa", "sb"), per_cent), "near-links", arrow_rows=SET_ROWS)
    discard(likely)
    if found.limit(1).count():
        return found
    discard(found)
    return None


def _classes(docs, id_col, text_col, width, per_cent, k, k_lists, exact, nodes) -> tuple[DataFrame | None, list[DataFrame]]:
    """(node, label) of the nodes that may be linked, or None; and the tables that may go once that is read."""
    c, c_lists = (k, k) if exact else (least_overlap(k, per_cent / 100), least_overlap(k_lists, per_cent / 100))
    involved = _involved(nodes, per_cent, c)
    n_involved = involved.count()
    if not n_involved:
        discard(involved)
        return None, []
    few = max(1, n_involved // 50_000)  # partitions for tables of about a row per nominated node
    chosen = nodes.join(F.broadcast(involved) if n_involved <= BROADCAST_IDS else involved, "node", "left_semi")
    short = materialize(chosen.select("node", "digest", "least", "sketch"), "near-short")
    wanted = short.select(F.col("least").alias("id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(wanted) if n_involved <= BROADCAST_IDS else wanted, "id", "left_semi")
    whole = _full_sets(texts, width).join(short.select("digest", "node"), "digest").select("node", "members").dropDuplicates(["node"])
    sets = materialize(whole, "near-sets", arrow_rows=TEXT_ROWS)
    retained = materialize(_retained(sets, k_lists), "near-retained", arrow_rows=SET_ROWS)
    lists = _ranked(retained, per_cent, c_lists)
    discard(retained)
    labels = materialize(involved.coalesce(few).select("node", F.col("node").alias("label")), "near-labels")
    tried, pivots = None, 1
    while True:
        placed = lists.join(labels, "node")
        held = placed.groupBy("value", "label").agg(F.count(F.lit(1)).alias("held"))
        mixed = held.join(held.groupBy("value").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("value"), "value")
        mixed = materialize(mixed, "near-mixed")
        placed = materialize(placed.join(mixed, ["value", "label"]), "near-placed")
        discard(mixed)
        if not placed.limit(1).count():
            discard(placed)
            break
        # the node with the fewest values of its own is the likeliest centre of its list; later on the classes with the
        # fewest members in the list come first, as a list ends with the last class but one: one pivot from each of several parts
        order = F.struct("lone", "node") if pivots == 1 else F.struct("held", F.xxhash64("node"), "node")
        part = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots))
        best = placed.groupBy("value", part.alias("part")).agg(F.min(F.struct(order.alias("by"), *FIELDS)).alias("p"))
        chosen = materialize(best.select("value", *[F.col(f"p.{x}").alias(x) for x in FIELDS]), "near-pivots")
        met = _side(placed, "i").join(_side(chosen, "o"), "value").filter("inode <> onode AND ilabel <> olabel").filter(_may_meet("i", "o", per_cent, k_lists, c_lists))
        pairs = met.select(F.least("inode", "onode").alias("a"), F.greatest("inode", "onode").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs.coalesce(few), "near-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = _linked(pairs, short, sets, k, c, per_cent)
        # what has been a pivot has met all of its list
        rest = materialize(placed.drop("label", "held").join(chosen.select("value", "node"), ["value", "node"], "left_anti"), "near-lists")
        if found is not None:
            ends = lambda df, x: df.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x)
            between = ends(ends(found, "a"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
            merged = connected_components(between, few).select(F.col("id").alias("label"), F.col("label").alias("to"))
            renewed = materialize(labels.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")).coalesce(few), "near-labels")
            discard(labels, found)
            labels = renewed
        discard(placed, chosen, lists)
        lists, pivots = rest, 2 * pivots
    discard(sets, lists, involved, short)
    return labels, [labels]


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose id represents its class, columns unchanged.

    The ids that go are broadcast while they are few enough, and joined by key beyond that.
    """
    gone_id = unused_name(docs.columns, "near_id")
    gone = materialize(near_duplicates(docs, id_col=id_col, **how).filter("NOT kept").select(F.col(id_col).alias(gone_id)).distinct(), "near-gone")
    away = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(away, F.col(f"`{id_col}`") == F.col(gone_id), "left_anti")
