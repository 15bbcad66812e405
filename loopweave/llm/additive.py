"""Quality classifier (operator 1): a generalised additive model with pairwise interactions.

Cyclic boosting: in turn, every feature gets one shallow tree on the residuals, which is added to that feature's lookup
table; then the strongest pairs of features get tables of two dimensions in the same way. A score is an intercept, one
table entry for each feature and one for each pair: additions of looked-up values, for many rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows
from .statistics import FEATURES, features
from .tokens import slices


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)]
        out = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            out += t[bins[f]]
        for f, g, t in self.pairs:
            out += t[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _steps(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float, ridge: float) -> np.ndarray:
    """A tree of ``leaves`` leaves over ordered bins: the value of every bin."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = (g[m] - g[a]) ** 2 / (h[m] - h[a] + ridge) + (g[b] - g[m]) ** 2 / (h[b] - h[m] + ridge) - worth(a, b)
            gain[(h[m] - h[a] < least) | (h[b] - h[m] < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), int(m[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _quarters(grad: np.ndarray, hess: np.ndarray, least: float, ridge: float) -> tuple[float, np.ndarray]:
    """A tree of depth two over a grid, split once each way: its gain and the value of every cell."""
    g = np.zeros((grad.shape[0] + 1, grad.shape[1] + 1))
    h = g.copy()
    g[1:, 1:], h[1:, 1:] = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    gt, ht = g[-1, -1], h[-1, -1]
    top, left = slice(1, -1), slice(1, -1)
    a, b = (g[top, left], h[top, left]), (g[top, -1:] - g[top, left], h[top, -1:] - h[top, left])
    c = (g[-1:, left] - a[0], h[-1:, left] - a[1])
    d = (gt - a[0] - b[0] - c[0], ht - a[1] - b[1] - c[1])
    gain = sum(x**2 / (y + ridge) for x, y in (a, b, c, d)) - gt**2 / (ht + ridge)
    gain = np.where(np.minimum.reduce([a[1], b[1], c[1], d[1]]) < least, -1, gain)
    if not gain.size or gain.max() <= 0:
        return 0.0, np.zeros(grad.shape)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(grad.shape)
    for (x, y), rows, cols in ((a, slice(0, i + 1), slice(0, j + 1)), (b, slice(0, i + 1), slice(j + 1, None)), (c, slice(i + 1, None), slice(0, j + 1)), (d, slice(i + 1, None), slice(j + 1, None))):
        out[rows, cols] = -x[i, j] / (y[i, j] + ridge)
    return float(gain.max()), out


def fit(x: np.ndarray, y: np.ndarray, cycles: int = 150, pair_cycles: int = 60, n_pairs: int = 6, max_bins: int = 64, grid: int = 12, leaves: int = 4, rate: float = 0.15, least: float = 2.0, ridge: float = 1.0) -> AdditiveModel:
    """Without labelled rows the model gives 0.5 for everything; with one class only, that class's smoothed share."""
    n, k = x.shape
    share = (y.sum() + 1) / (n + 2)
    model = AdditiveModel([], [], intercept=float(np.log(share / (1 - share))))
    for f in range(k):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, max_bins + 1)[1:-1])) if n else np.empty(0)
        model.edges.append(cuts)
        model.tables.append(np.zeros(len(cuts) + 1))
        model.coarse.append(np.arange(len(cuts) + 1) * grid // (len(cuts) + 1))
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(model.edges)]
    raw = np.full(n, model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return p - y, p * (1 - p)

    for _ in range(cycles):
        for f in range(k):
            if len(model.edges[f]) == 0:
                continue
            grad, hess = slopes()
            step = rate * _steps(*(np.bincount(bins[f], w, len(model.tables[f])) for w in (grad, hess)), leaves, least, ridge)
            model.tables[f] += step
            raw += step[bins[f]]
    small = [model.coarse[f][bins[f]] for f in range(k)]

    def grids(f, g):
        return (np.bincount(small[f] * grid + small[g], w, grid * grid).reshape(grid, grid) for w in slopes())

    gains = sorted(((_quarters(*grids(f, g), least, ridge)[0], f, g) for f in range(k) for g in range(f + 1, k)), reverse=True)
    model.pairs = [(f, g, np.zeros((grid, grid))) for gain, f, g in gains[:n_pairs] if gain > 0]
    for _ in range(pair_cycles):
        for f, g, t in model.pairs:
            step = rate * _quarters(*grids(f, g), least, ridge)[1]
            t += step
            raw += step[small[f], small[g]]
    return model


def feature_table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of (id, label, text) rows, made where the texts are. ``rows`` is a bounded sample."""
    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1), pa.array([features(t)[1] for t in part.column(2).to_pylist()], pa.list_(pa.float64()))], ["id", "label", "x"])

    got = sorted((tuple(r) for r in rows.mapInArrow(run, "id string, label int, x array<double>").collect()), key=lambda r: (r[0], r[1], r[2]))
    x = np.array([r[2] for r in got], float).reshape(len(got), len(FEATURES))
    return x, np.array([r[1] for r in got], float)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, most_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text", model: AdditiveModel | None = None) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``.

    ``model`` is fitted on at most ``most_labelled`` labelled rows (the documented bound of the training sample) unless it
    is given. A null text scores as the empty one; repeated rows stay; an empty table gives an empty one; without labels
    every score is 0.5. Only the features of the sample and the tables of the model (a few KB) pass the driver.
    """
    if model is None:
        x, y = feature_table(training_rows(docs, labels, "quality", most_labelled, id_col, text_col))
        model = fit(x, y)

    def run(batches):
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            got = np.array([features(t)[1] for t in texts], float)
            score = model.score(got) if model.edges else np.full(len(got), 1 / (1 + np.exp(-model.intercept)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
