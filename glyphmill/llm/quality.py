"""Quality classifier: a generalised additive model with pairwise interactions.

Texts are described by a few numbers, each cut into quantile bins. Boosting goes round the
features in a cycle and fits one shallow tree of a single feature at a time to the logistic
gradient; the sum of a feature's trees is a lookup table by bin. The pairs of features that reduce
the remaining loss most then get tables of two dimensions by the same kind of cycle. A score is the
sum of a handful of table entries, taken for whole batches at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, unit_hash

NAMES = ["log_bytes", "upper", "digit", "sign", "mark", "space", "newline", "mean_word", "wide", "repeated_bytes", "bar"]
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "sign": b"#$%&*+/<=>@^_~{}[]\\", "mark": b".,;:!?'\"()-", "space": b" \t", "newline": b"\n\r", "bar": b"|"}


def describe(texts: list[str | None]) -> np.ndarray:
    """(text, feature): shares of byte classes and shapes; zeros for a null or empty text."""
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((len(raw), len(NAMES)), np.float32)
    live = np.flatnonzero(sizes)
    if not len(live):
        return out
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = sizes[live]
    start = np.cumsum(n) - n
    share = lambda flags: np.add.reduceat(flags, start, dtype=np.int64) / n
    f = {"log_bytes": np.log1p(n)}
    for name, chars in CLASSES.items():
        table = np.zeros(256, np.uint8)
        table[list(chars)] = 1
        f[name] = share(table[data])
    f["wide"] = share((data >= 0x80).view(np.uint8))
    blanks = (f["space"] + f["newline"]) * n
    f["mean_word"] = n / (blanks + 1)
    same = np.zeros(len(data), np.uint8)
    same[1:] = data[1:] == data[:-1]
    same[start] = 0
    f["repeated_bytes"] = share(same)
    out[live] = np.stack([f[k] for k in NAMES], 1)
    return out


@dataclass
class Model:
    """cuts: by feature; tables: by feature, log odds by bin; pairs: (feature, feature, coarse cuts of both, table)."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cut, x[:, j], side="right")]
        for i, j, ci, cj, table in self.pairs:
            out += table[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def newton(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The values by bin of a regression tree over ordered bins with sums g, h, grown best split first."""
    edges = [(0, len(g))]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]

    def best(lo: int, hi: int) -> tuple[float, int]:
        k = np.arange(lo + 1, hi)
        if not len(k):
            return 0.0, lo
        s = gain(cg[k] - cg[lo], ch[k] - ch[lo]) + gain(cg[hi] - cg[k], ch[hi] - ch[k]) - gain(cg[hi] - cg[lo], ch[hi] - ch[lo])
        return float(s.max()), int(k[s.argmax()])

    while len(edges) < leaves:
        (value, at), i = max((best(*e), i) for i, e in enumerate(edges))
        if value <= 1e-9:
            break
        lo, hi = edges.pop(i)
        edges += [(lo, at), (at, hi)]
    out = np.zeros(len(g))
    for lo, hi in edges:
        out[lo:hi] = newton(cg[hi] - cg[lo], ch[hi] - ch[lo])
    return out


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def train(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 120, rate: float = 0.1, n_pairs: int = 4, pair_bins: int = 8, pair_rounds: int = 60) -> Model:
    """Cyclic boosting of single features, then of the most helpful pairs. Without both classes the model is a constant."""
    n, d = x.shape if x.ndim == 2 else (0, len(NAMES))
    mean = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
    model = Model(float(np.log(mean / (1 - mean))), [np.empty(0)] * d, [np.zeros(1)] * d, [])
    if not n or y.min() == y.max():
        return model
    model.cuts = [quantile_cuts(x[:, j], bins) for j in range(d)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    z = np.full(n, model.bias)
    for _ in range(rounds):
        for j in range(d):
            p = sigmoid(z)
            size = len(model.tables[j])
            step = rate * shallow_tree(np.bincount(at[j], y - p, size), np.bincount(at[j], p * (1 - p), size))
            model.tables[j] = model.tables[j] + step
            z += step[at[j]]
    coarse = [quantile_cuts(x[:, j], pair_bins) for j in range(d)]
    cell = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
    p = sigmoid(z)
    found = []
    for i, j in itertools.combinations(range(d), 2):
        k, size = cell[i] * (len(coarse[j]) + 1) + cell[j], (len(coarse[i]) + 1) * (len(coarse[j]) + 1)
        found.append((gain(np.bincount(k, y - p, size), np.bincount(k, p * (1 - p), size)).sum(), i, j))
    chosen = [(i, j) for _, i, j in sorted(found, reverse=True)[:n_pairs]]
    grids = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen]
    for _ in range(pair_rounds):
        for grid, (i, j) in zip(grids, chosen):
            p = sigmoid(z)
            k = cell[i] * grid.shape[1] + cell[j]
            g, h = (np.bincount(k, v, grid.size).reshape(grid.shape) for v in (y - p, p * (1 - p)))
            rows = shallow_tree(g.sum(1), h.sum(1), 2)  # a split of the first feature, then one of the second on either side
            step = np.zeros_like(grid)
            for side in np.unique(rows):
                here = rows == side
                step[here] = rate * shallow_tree(g[here].sum(0), h[here].sum(0), 2)
            grid += step
            z += step[cell[i], cell[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], grid) for grid, (i, j) in zip(grids, chosen)]
    return model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, seed: int = 9) -> Model:
    """Train on at most max_rows labelled rows, those with the smallest hashes of doc_id; a doc_id with several labels is good only if all say so."""
    own = pick(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    n = own.count()
    own = own.withColumn("u", unit_hash(F.col("doc_id"), seed=seed))
    if n > max_rows:
        own = own.filter(F.col("u") < 1.1 * max_rows / n)
    # about 1.1 max_rows ids at most, whatever the size of labels
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id"), F.col("text").cast("string"))
    joined = texts.join(F.broadcast(own), "doc_id").select("text", "quality", "u")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                x = describe(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), part.column(1), part.column(2)], ["x", "quality", "u"])

    rows = joined.mapInArrow(numbers, "x array<float>, quality int, u double").toPandas()
    rows["key"] = [tuple(v) for v in rows["x"]]
    rows = rows.sort_values(["u", "key"], kind="stable").head(max_rows)
    x = np.array([list(v) for v in rows["x"]], np.float32).reshape(-1, len(NAMES))
    return train(x, (rows["quality"].to_numpy() > 0).astype(float))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """doc_id, quality (probability that it is good), keep (quality >= threshold), one row for each row.

    A null or empty text has all features zero, quality 0 and isn't kept. Repeated rows are judged
    alike. Labels of one class only, or none, give a constant. Extra columns are ignored; texts are
    read whole.
    """
    model = model or fit(docs, labels)
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = handle.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                x = describe(part.column(1).to_pylist())
                p = np.where(x[:, 0] > 0, sigmoid(own.log_odds(x)), 0.0).round(6)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(p >= threshold) if len(p) else pa.array([], pa.bool_())], ["doc_id", "quality", "keep"])

    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return base.mapInArrow(judge, "doc_id long, quality double, keep boolean")
