"""Exact top-k search by inner product: one KD-tree per shard, best-first.

Equal vectors are stored once, with their k + 1 smallest ids: no other copy can rank. The
different vectors are dealt to shards by median splits: a round fits up to ``DEPTH`` levels of
them to a sample of each shard that is too large (``SAMPLE_ROWS`` rows of it, on the executors),
and rounds go on until no shard is. Each shard's KD-tree is built once, by median splits down to
small leaves, every node with the tight bounding box of its points, and stored.

The bound of a box for a query is the greatest inner product any point in it could have.
A query first searches the shard with the greatest root bound. The k-th score found there
travels with the query: only shards whose root bound reaches it are searched further, and in
a tree the node with the greatest bound comes first until that bound falls below the k-th
score. A bound equal to it is still explored, as ties go to the smaller id.

Scale: query blocks meet the trees that they must search by key, each task holding one tree and
about ``BLOCK`` queries. Root boxes are broadcast, ``TREES`` of them at a time: with more
trees the queries are read once for each lot, and bounds and k-th scores hold across lots.
Results per tree are k rows a query at most.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no
part, nor do rows without an id. Vectors meet only vectors of their length. Rows that are equal
in id and vector count once; rows of one id with different vectors are candidates each. A query
is never its own result. Fewer than k candidates: all. Ties go to the smaller id. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalign.llm._util import discard, materialize

SAMPLE_ROWS = 4096
SHARD_ROWS = 32_768
LEAF_ROWS = 128
BLOCK = 8_192
TREES = 20_000
#: Levels of median splits that a round fits to a shard.
DEPTH = 6
ROUNDS = 40
_LARGE = 1 << 53


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * component) of the usable vectors, as integers."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = rows.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).filter(fine)
    v = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return usable.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64) if n else np.empty((0, 0), np.int64)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b for integers: in floating point where no sum can leave its integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[-1] < _LARGE:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


class KDTree:
    """points (n, d) in leaf order; nodes as rows of first, last, left, right; boxes lo and hi."""

    def __init__(self, points: np.ndarray, ids: list[list[int]], nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.points, self.ids, self.nodes, self.lo, self.hi = points, ids, nodes.tolist(), lo, hi
        self.most = float(np.abs(points).max()) if points.size else 0.0
        self.real = None

    @classmethod
    def build(cls, points: np.ndarray, ids: list[list[int]], leaf: int = LEAF_ROWS) -> KDTree:
        order, nodes, lo, hi = np.arange(len(points)), [], [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            first, last, parent, side = stack.pop()
            inside = points[order[first:last]]
            me = len(nodes)
            nodes.append([first, last, -1, -1])
            lo.append(inside.min(0))
            hi.append(inside.max(0))
            if parent >= 0:
                nodes[parent][2 + side] = me
            wide = hi[-1] - lo[-1]
            if last - first > leaf and wide.max() > 0:
                axis, mid = int(wide.argmax()), (last - first) // 2
                order[first:last] = order[first:last][np.argpartition(inside[:, axis], mid)]
                stack += [(first, first + mid, me, 0), (first + mid, last, me, 1)]
        return cls(points[order], [ids[i] for i in order], np.array(nodes), np.array(lo), np.array(hi))

    def _arrays(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """points, lo and hi: in floating point where no sum can leave its integers."""
        if self.most * float(np.abs(q).max(initial=0)) * q.shape[-1] >= _LARGE:
            return self.points, self.lo, self.hi
        if self.real is None:
            self.real = tuple(x.astype(np.float64) for x in (self.points, self.lo, self.hi))
        return self.real

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Of every node's box, for one query or for queries in rows."""
        _, lo, hi = self._arrays(q)
        q = q.astype(hi.dtype)
        return np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T

    def search(self, me: int, q: np.ndarray, k: int, kth: int | None, bounds: np.ndarray | None = None) -> list[tuple[int, int]]:
        """The best (score, id) here that may be among the k best of all; kth is the k-th score known so far."""
        points, nodes, best = self._arrays(q)[0], self.nodes, []  # best: heap of (score, -id), the worst first
        bounds = (self.bounds(q) if bounds is None else bounds).tolist()
        q = q.astype(points.dtype)
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            floor = best[0][0] if len(best) == k and (kth is None or best[0][0] > kth) else kth
            if floor is not None and -bound < floor:
                break
            first, last, left, right = nodes[node]
            if left >= 0:
                for child in (left, right):
                    if floor is None or bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            scores = points[first:last] @ q
            near = np.flatnonzero(scores >= floor) if floor is not None else np.arange(last - first)
            if len(near) > 1:
                near = near[np.argsort(-scores[near], kind="stable")]
            for i in near.tolist():
                score = int(scores[i])
                if len(best) == k and score < best[0][0]:
                    break
                for other in self.ids[first + i]:
                    if other != me:
                        entry = (score, -other)
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
        return [(s, -i) for s, i in best]


def _splits(sample: np.ndarray, depth: int) -> tuple[list[int], list[int]]:
    """Axes and values of the median splits of a complete binary tree, in heap order; what is below the value goes left."""
    axes: list[int] = []
    values: list[int] = []
    groups = [sample]
    for _ in range(depth):
        below = []
        for g in groups:
            axis, value = 0, _LARGE
            if len(g) > 1 and (wide := g.max(0) - g.min(0)).max() > 0:
                axis = int(wide.argmax())
                column = np.sort(g[:, axis])
                value = int(column[len(column) // 2])
                if value == column[0]:  # both sides get something
                    value = int(column[np.searchsorted(column, value, "right")])
            axes.append(axis)
            values.append(value)
            below += [g[g[:, axis] < value], g[g[:, axis] >= value]]
        groups = below
    return axes, values


def _dealt(different: DataFrame, shard_rows: int) -> DataFrame:
    """(v, ids, dim, shard): shards of at most about twice ``shard_rows`` different vectors."""
    placed = materialize(different.withColumn("shard", F.lit("s")), "topk-placed")

    def fit(table: pa.Table) -> pa.Table:
        wanted = table["n"][0].as_py() // shard_rows
        axes, values = _splits(_matrix(table["v"]), max(1, min(DEPTH, wanted.bit_length())))
        kinds = pa.list_(pa.int64())
        return pa.table({"dim": table["dim"].slice(0, 1), "shard": table["shard"].slice(0, 1), "axes": pa.array([axes], kinds), "cuts": pa.array([values], kinds)})

    for _ in range(ROUNDS):
        large = placed.groupBy("dim", "shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * shard_rows)
        large = materialize(large, "topk-large")
        if not large.limit(1).count():
            discard(large)
            break
        drawn = F.pmod(F.xxhash64("v", "shard"), F.lit(1 << 20)) <= F.lit(float(SAMPLE_ROWS << 20)) / F.col("n")
        sample = placed.join(large, ["dim", "shard"]).filter(drawn).select("dim", "shard", "n", "v")
        plans = materialize(sample.groupBy("dim", "shard").applyInArrow(fit, "dim int, shard string, axes array<long>, cuts array<long>"), "topk-splits")
        # down the heap: node n goes to 2n + 1, or 2n + 2 where the component reaches the value
        step = lambda n, _: F.when(n >= F.size("axes"), n).otherwise(
            2 * n + 1 + (F.get("v", F.get("axes", n).cast("int")) >= F.get("cuts", n)).cast("int")
        )
        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), step)
        shard = F.when(F.col("axes").isNull(), F.col("shard")).otherwise(F.concat("shard", F.lit("."), leaf.cast("string")))
        dealt = placed.join(plans, ["dim", "shard"], "left").select("v", "ids", "dim", shard.alias("shard"))
        renewed = materialize(dealt, "topk-placed")
        discard(placed, large, plans)
        placed = renewed
    return placed


TREE = "tree string, dim int, lo array<long>, hi array<long>, points binary, counts binary, ids binary, nodes binary, los binary, his binary"


def build_trees(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One stored tree per row: its name, root box, points in leaf order, ids, nodes and boxes."""
    ranked = vectors.distinct().withColumn("copy", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("copy") <= k + 1)
    different = ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v"))
    placed = _dealt(different, shard_rows)
    # (a shard that no split can divide is cut by a hash)
    loads = placed.groupBy("dim", "shard").agg((F.count(F.lit(1)) / F.lit(4 * shard_rows)).cast("int").alias("cuts"))
    cut = placed.join(loads, ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("cuts") + 1))

    def pack(table: pa.Table) -> pa.Table:
        key = f"{table['dim'][0].as_py()}/{table['shard'][0].as_py()}/{table['part'][0].as_py()}"
        tree = KDTree.build(_matrix(table["v"]), table["ids"].to_pylist())
        blob = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
        return pa.table({
            "tree": [key], "dim": pa.array([tree.points.shape[1]], pa.int32()), "lo": [tree.lo[0].tolist()], "hi": [tree.hi[0].tolist()],
            "points": blob(tree.points, "<i8"), "counts": blob([len(x) for x in tree.ids], "<i4"), "ids": blob([i for x in tree.ids for i in x], "<i8"),
            "nodes": blob(tree.nodes, "<i4"), "los": blob(tree.lo, "<i8"), "his": blob(tree.hi, "<i8"),
        })

    out = materialize(cut.groupBy("dim", "shard", "part").applyInArrow(pack, TREE), "topk-trees")
    discard(placed)
    return out


def load_tree(dim: int, points: bytes, counts: bytes, ids: bytes, nodes: bytes, los: bytes, his: bytes) -> KDTree:
    flat, ends = np.frombuffer(ids, "<i8"), np.cumsum(np.frombuffer(counts, "<i4"))
    rows = lambda x: np.frombuffer(x, "<i8").reshape(-1, dim)
    return KDTree(rows(points), [x.tolist() for x in np.split(flat, ends[:-1])], np.frombuffer(nodes, "<i4").reshape(-1, 4), rows(los), rows(his))


def _search(wanted: DataFrame, trees: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query_id, id, score) of every wanted (query_id, v, kth, tree)."""
    asked = materialize(wanted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "topk-asked")
    pairs = asked.select(F.col("tree").alias("of"), F.col("block").alias("part")).distinct()
    copies = pairs.join(trees.drop("lo", "hi"), F.col("of") == F.col("tree")).drop("tree")
    parts = ("dim", "points", "counts", "ids", "nodes", "los", "his")

    def run(queries: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and held.num_rows:
            tree = load_tree(*(held[c][0].as_py() for c in parts))
            ids, kths, vectors = queries["query_id"].to_pylist(), queries["kth"].to_pylist(), _matrix(queries["v"])
            for at in range(0, len(ids), 64):
                some = vectors[at : at + 64]
                for me, q, kth, b in zip(ids[at : at + 64], some, kths[at : at + 64], tree.bounds(some), strict=True):
                    out += [(me, other, score) for score, other in tree.search(me, q, k, kth, b)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "id", "score"])

    return asked.groupBy("tree", "block").cogroup(copies.groupBy("of", "part")).applyInArrow(run, "query_id long, id long, score long")


def _chosen(asked: DataFrame, boxes: list[tuple], first: bool) -> DataFrame:
    """Of (query_id, v, kth, home): the tree with the greatest bound, or all but the home that reach the kth; with the bound."""
    shared = asked.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list] = {}
        for tree, dim, lo, hi in shared.value:
            by_dim.setdefault(dim, []).append((tree, lo, hi))
        held = {d: ([t for t, _, _ in x], np.array([lo for _, lo, _ in x]), np.array([hi for _, _, hi in x])) for d, x in by_dim.items()}
        for batch in batches:
            rows = []
            for me, v, kth, home in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if len(v) in held:
                    names, lo, hi = held[len(v)]
                    q = np.array(v, np.int64)
                    bounds = _dot(hi, np.maximum(q, 0)) + _dot(lo, np.minimum(q, 0))
                    for i in [int(bounds.argmax())] if first else np.flatnonzero(bounds >= kth).tolist() if kth is not None else range(len(names)):
                        if names[i] != home:
                            rows.append((me, v, kth, names[i], int(bounds[i])))
            columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "v", "kth", "tree", "bound"])

    return asked.select("query_id", "v", "kth", "home").mapInArrow(run, "query_id long, v array<long>, kth long, tree string, bound long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank from 1, id, score) for queries (id, v) against vectors (id, v)."""
    trees = build_trees(vectors, k, shard_rows)
    asked = materialize(queries.select(F.col("id").alias("query_id"), "v").distinct(), "topk-queries")
    blocks, lots = max(1, -(-asked.count() // BLOCK)), max(1, -(-trees.count() // TREES))
    roots = trees.select("tree", "dim", "lo", "hi", F.pmod(F.xxhash64("tree"), F.lit(lots)).alias("lot"))

    def choose(rows: DataFrame, first: bool) -> DataFrame:
        out = None
        for lot in range(lots):
            boxes = [(r["tree"], r["dim"], r["lo"], r["hi"]) for r in roots.filter(F.col("lot") == lot).collect()]  # about TREES of them
            mine = _chosen(rows, boxes, first)
            out = mine if out is None else out.unionByName(mine)
        if first and lots > 1:
            one = W.partitionBy("query_id", "v").orderBy(F.col("bound").desc(), "tree")
            out = out.withColumn("r", F.row_number().over(one)).filter("r = 1").drop("r")
        return out.drop("bound")

    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    start = asked.select("query_id", "v", F.lit(None).cast("long").alias("kth"), F.lit("").alias("home"))
    homes = materialize(choose(start, True), "topk-homes")
    home = materialize(_search(homes, trees, k, blocks), "topk-home")
    kth = home.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    bounded = homes.select("query_id", "v", F.col("tree").alias("home")).join(kth, "query_id", "left").select("query_id", "v", "kth", "home")
    found = home.unionByName(_search(choose(bounded, False), trees, k, blocks))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
