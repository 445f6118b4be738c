"""Second-order factorisation machine over hashed binary features.

score(x) = sigmoid(b + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2)), the pairwise
interactions by the sum-of-squares identity, in time linear in the features of a text.

Training takes a bounded sample of labelled rows (``max_rows``, chosen by a hash of the id,
so that reruns agree). Their features are computed on the executors and reduced there to
hash ids; the driver keeps the features whose share among label 1 differs from that among
label 0 by more than chance, and fits by AdaGrad. The fitted model is a few thousand rows.
Scoring covers every row and whole text, in one pass without a shuffle.

Defined cases: null texts count as empty; labels other than 0 and 1 are no labels; with no
usable label the model is its bias, 0.5; ties between features go to the smaller hash id; the
order of the rows and their partitions have no influence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalign.llm._util import in_arrow, sliced, thrifty

BUCKETS = 1 << 20


@dataclass(frozen=True)
class FMConfig:
    """``max_rows`` bounds the training sample; ``max_features`` the model."""

    rank: int = 8
    max_rows: int = 12_000
    max_features: int = 6_000
    min_rows: int = 6
    least_z: float = 4.0
    epochs: int = 12
    batch: int = 256
    rate: float = 0.08
    l2: float = 2e-4
    seed: int = 7


@dataclass(frozen=True)
class FMModel:
    """Weights of the kept features; ``index`` maps a hash id to its row."""

    bias: float
    index: dict[int, int]
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: list[int]) -> float:
        z = self.bias
        if rows:
            s = self.v[rows]
            total = s.sum(0)
            z += float(self.w[rows].sum() + 0.5 * (total @ total - (s * s).sum()))
        return float(1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, z)))))


def _csr(feature_lists: list[np.ndarray], index: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    rows, starts = [], [0]
    for ids in feature_lists:
        rows.append(np.array([index[i] for i in ids.tolist() if i in index], np.int64))
        starts.append(starts[-1] + len(rows[-1]))
    return (np.concatenate(rows) if rows else np.empty(0, np.int64)), np.array(starts)


def select_features(lists: list[np.ndarray], y: np.ndarray, cfg: FMConfig) -> list[int]:
    """Hash ids whose rates differ between the labels, most significant first."""
    if not lists:
        return []
    everything = np.bincount(np.concatenate(lists), minlength=BUCKETS)
    positive = [x for x, label in zip(lists, y, strict=True) if label]
    ones = np.bincount(np.concatenate(positive), minlength=BUCKETS) if positive else np.zeros(BUCKETS, np.int64)
    n, n1 = len(y), max(1.0, float(y.sum()))
    n0 = max(1.0, n - n1)
    p1, p0, p = (ones + 0.5) / (n1 + 1), (everything - ones + 0.5) / (n0 + 1), (everything + 0.5) / (n + 1)
    z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    z[everything < cfg.min_rows] = 0
    kept = np.flatnonzero(z >= cfg.least_z)
    return kept[np.argsort(-z[kept], kind="stable")][: cfg.max_features].tolist()


def _sums(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """Column sums of ``values`` by group."""
    out = np.empty((groups, values.shape[1]))
    for f in range(values.shape[1]):
        out[:, f] = np.bincount(group, values[:, f], groups)
    return out


def fit(lists: list[np.ndarray], labels: np.ndarray, cfg: FMConfig) -> FMModel:
    """Logistic loss, AdaGrad. Without rows, or with one label only, the model is its bias."""
    y = np.asarray(labels, np.float64)
    kept = select_features(lists, y, cfg)
    index = {h: i for i, h in enumerate(kept)}
    d, k, rng = len(kept), cfg.rank, np.random.default_rng(cfg.seed)
    base = (y.sum() + 0.5) / (len(y) + 1.0)
    bias, w, v = float(np.log(base / (1 - base))), np.zeros(d), rng.normal(0, 0.03, (d, k))
    if not d:
        return FMModel(bias, index, w, v)
    flat, starts = _csr(lists, index)
    gb, gw, gv = 1e-6, np.full(d, 1e-6), np.full((d, k), 1e-6)
    for _ in range(cfg.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), cfg.batch):
            mine = order[at : at + cfg.batch]
            sizes = starts[mine + 1] - starts[mine]
            owner = np.repeat(np.arange(len(mine)), sizes)
            offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids = flat[np.repeat(starts[mine], sizes) + offset]
            vx = v[ids]
            total = _sums(owner, vx, len(mine))
            squares = np.bincount(owner, (vx * vx).sum(1), len(mine))
            z = bias + np.bincount(owner, w[ids], len(mine)) + 0.5 * ((total * total).sum(1) - squares)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[mine]) / len(mine)
            grad_b = err.sum()
            gb += grad_b * grad_b
            bias -= cfg.rate * grad_b / np.sqrt(gb)
            touched, back = np.unique(ids, return_inverse=True)
            e = err[owner]
            grad_w = np.bincount(back, e, len(touched)) + cfg.l2 * w[touched]
            gw[touched] += grad_w**2
            w[touched] -= cfg.rate * grad_w / np.sqrt(gw[touched])
            inner = (total[owner] - vx) * e[:, None]
            grad_v = _sums(back, inner, len(touched)) + cfg.l2 * v[touched]
            gv[touched] += grad_v**2
            v[touched] -= cfg.rate * grad_v / np.sqrt(gv[touched])
    return FMModel(float(bias), index, w, v)


#: Makes a function from a text to its distinct hash ids; called once per task.
Extractor = Callable[[], Callable[[str], "set[int]"]]


def train(rows: DataFrame, extractor: Extractor, cfg: FMConfig, id_col: str, text_col: str, label_col: str) -> FMModel:
    """Fit on at most about ``cfg.max_rows`` rows (id, text, label 0/1)."""
    labelled = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)")
    n = labelled.select("id").count()
    share = min(1.0, cfg.max_rows / max(1, n))
    chosen = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = extractor()
        for batch in sliced(batches):
            packed = [np.array(sorted(features(t or "")), np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["id", "label", "features"])

    schema = T.StructType([T.StructField("id", rows.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("features", T.BinaryType())])
    sample = sorted(((str(r["id"]), r["label"], bytes(r["features"])) for r in chosen.mapInArrow(thrifty(run), schema).toLocalIterator()))
    return fit([np.frombuffer(f, np.int32) for _, _, f in sample], np.array([x for _, x, _ in sample]), cfg)


def score(docs: DataFrame, model: FMModel, extractor: Extractor, text_col: str, out: str = "score") -> DataFrame:
    """``docs`` with the model's probability of label 1 for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.index, model.w, model.v))  # plain values: workers have no package
    columns = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = FMModel(*shared.value)
        features = extractor(set(held.index))
        at = columns.index(text_col)
        for batch in sliced(batches):
            scores = [held.score([held.index[i] for i in features(t or "")]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*columns, out])

    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField(out, T.DoubleType())])
    return in_arrow(docs.select(*[F.col(f"`{c}`") for c in columns]), thrifty(run), schema)
