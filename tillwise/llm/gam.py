"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a row of shape features (``features.FEATURES``). Cyclic
boosting visits the features in turn and adds a shallow tree on that feature
alone to its lookup table; then the strongest pairs of features get a table
each, grown from trees that split both. A score is the logistic of the
intercept plus one table entry per feature and pair, so scoring is a vectorised
sum of bin look-ups.

Fitting reads at most ``sample_rows`` labelled rows (those with the smallest
hash of their id), one per id and label; their feature rows, some hundred bytes
each, are the only thing that reaches the driver. Scoring reads every text whole.

Null and empty texts score as texts of zero words. Without labelled rows, or
with one class only, every score is the smoothed share of class 1. Null labels
and null ids are not learned from; of the rows of a repeated id the one of
smallest features counts, once per label. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm import text as tx
from tillwise.llm.features import FEATURES, document_features


@dataclass(frozen=True)
class Params:
    sample_rows: int = 12_000
    bins: int = 32
    rounds: int = 120
    pair_rounds: int = 60
    pairs: int = 6
    rate: float = 0.15
    leaf_weight: float = 4.0  # least sum of second derivatives in a leaf


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int64)
        for f, edges in enumerate(self.edges):
            out[:, f] = np.searchsorted(edges, x[:, f], side="right")
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, values in enumerate(self.tables):
            total += values[b[:, f]]
        for (f, g), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram in two (0: none)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - all_g**2 / (all_h + 1)
    gain[(left_h < least) | (right_h < least)] = 0
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Leaf value per bin of a tree with at most three leaves."""
    borders = [0, len(g)]
    _, cut = _best_cut(g, h, least)
    if cut:
        borders.insert(1, cut)
        found = [(*_best_cut(g[a:b], h[a:b], least), a) for a, b in ((0, cut), (cut, len(g)))]
        gain, inner, base = max(found)
        if gain:
            borders = sorted({*borders, base + inner})
    out = np.empty(len(g))
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Best tree that cuts both axes of a joint histogram once: gain, values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts_g = [cg[:-1, :-1], cg[:-1, -1:] - cg[:-1, :-1], cg[-1:, :-1] - cg[:-1, :-1], cg[-1, -1] - cg[:-1, -1:] - cg[-1:, :-1] + cg[:-1, :-1]]
    parts_h = [ch[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1], ch[-1, -1] - ch[:-1, -1:] - ch[-1:, :-1] + ch[:-1, :-1]]
    out = np.zeros(g.shape)
    if not parts_g[0].size:
        return 0.0, out
    gain = sum(x**2 / (y + 1) for x, y in zip(parts_g, parts_h, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    gain[np.minimum.reduce(parts_h) < least] = 0
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[i, j] <= 0:
        return 0.0, out
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, cols] = _leaf(float(parts_g[k][i, j]), float(parts_h[k][i, j]))
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, p: Params | None = None) -> Model:
    """Fit on feature rows and 0/1 labels."""
    p = p or Params()
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    model = Model(float(np.log(share / (1 - share))), [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1], method="higher")) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(p.rounds):
        for f, values in enumerate(model.tables):
            g, h = slopes()
            step = p.rate * _tree(np.bincount(b[:, f], g, len(values)), np.bincount(b[:, f], h, len(values)), p.leaf_weight)
            values += step
            total += step[b[:, f]]

    def joint(f: int, k: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.tables[f]), len(model.tables[k])
        cell = b[:, f] * shape[1] + b[:, k]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    g, h = slopes()
    gains = sorted(((_quadrants(*joint(f, k, g, h), p.leaf_weight)[0], f, k) for f in range(x.shape[1]) for k in range(f)), reverse=True)
    model.pairs = [(f, k) for gain, f, k in gains[: p.pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.tables[f]), len(model.tables[k]))) for f, k in model.pairs]
    for _ in range(p.pair_rounds):
        for (f, k), values in zip(model.pairs, model.pair_tables, strict=True):
            _, step = _quadrants(*joint(f, k, *slopes()), p.leaf_weight)
            values += p.rate * step
            total += p.rate * step[b[:, f], b[:, k]]
    return model


def featured(docs: DataFrame, id_column: str, text_column: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the feature row of each text."""
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "x array<double>"])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                x = document_features(tx.words_of(data, offsets))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), lists], names=[*keep, "x"])

    return docs.select(*keep, text_column).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", params: Params | None = None) -> Model:
    """Fit on labelled documents; ``labels``: the rows that may be learned from."""
    p = params or Params()
    usable = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).select(F.col(id_column), F.col(label_column).cast("int").alias("y_")).distinct()
    sample = usable.orderBy(F.xxhash64(id_column), id_column, "y_").limit(p.sample_rows)
    # At most sample_rows ids: the side that is sent out has a fixed bound.
    rows = docs.select(id_column, text_column).join(F.broadcast(sample), id_column)
    found = featured(rows, id_column, text_column, [id_column, "y_"]).groupBy(id_column, "y_").agg(F.min("x").alias("x")).collect()
    found.sort(key=lambda r: (r[0], r[1], r[2]))
    x = np.array([r[2] for r in found]).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r[1] for r in found], float), p)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (1 if score >= 0.5) of each row."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                s = model.score(document_features(tx.words_of(data, offsets)))
                yield pa.RecordBatch.from_arrays([rows.column(id_column), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_column, "score", "predicted"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int")


def passing(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model does not reject."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                s = model.score(document_features(tx.words_of(data, offsets)))
                yield from pa.Table.from_batches([rows]).filter(pa.array(s >= 0.5)).to_batches()

    return docs.mapInArrow(run, schema)
