"""Quality rules (operator 2): fixed base rules, then gradient-boosted trees over document statistics.

The trees are grown on histograms with monotonic constraints (more symbols, repeats, duplicate lines or capitals never
raise a document's score) and flattened into node arrays, so that a block of rows walks all trees by array lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .additive import feature_table
from .labelled import training_rows
from .statistics import FEATURES, Base, features
from .tokens import slices

#: Direction of the score as a feature grows; others are free.
MONOTONE = {"symbols_a_word": -1, "repeat_share": -1, "dup_line_share": -1, "upper_share": -1, "bars_a_word": -1, "calls_a_word": -1}


@dataclass
class Forest:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):  # leaves lead to themselves
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        raw = self.intercept + self.value[at].sum(1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 80, depth: int = 3, rate: float = 0.15, max_bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Forest | None:
    """None without rows of both classes."""
    if not len(y) or y.min() == y.max():
        return None
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, max_bins + 1)[1:-1])) for f in range(k)]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    wide = max(len(e) for e in edges) + 1
    flat = bins + np.arange(k) * wide
    usable = np.arange(wide - 1)[None, :] < np.array([len(e) for e in edges])[:, None]
    sign = np.array([monotone.get(f, 0) for f in range(k)])
    share = (y.sum() + 1) / (n + 2)
    raw = np.full(n, np.log(share / (1 - share)))
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        gt, ht = grad[rows].sum(), hess[rows].sum()
        value = float(np.clip(-gt / (ht + ridge), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        if level == depth or len(rows) < 4:
            raw[rows] += rate * value
            return me
        g, h = (np.bincount(flat[rows].ravel(), np.repeat(w[rows], k), k * wide).reshape(k, wide).cumsum(1)[:, :-1] for w in (grad, hess))
        vl, vr = np.clip(-g / (h + ridge), low, high), np.clip(-(gt - g) / (ht - h + ridge), low, high)
        gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
        gain[~usable | (h < least) | (ht - h < least) | (sign[:, None] * (vr - vl) < 0)] = -1
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] <= 1e-9:
            raw[rows] += rate * value
            return me
        middle = float(vl[f, b] + vr[f, b]) / 2
        below = (low, middle) if sign[f] > 0 else (middle, high) if sign[f] < 0 else (low, high)
        above = (middle, high) if sign[f] > 0 else (low, middle) if sign[f] < 0 else (low, high)
        go = bins[rows, f] <= b
        a = grow(rows[go], grad, hess, level + 1, *below)
        c = grow(rows[~go], grad, hess, level + 1, *above)
        nodes[me] = [f, edges[f][b], a, c, 0.0]
        return me

    start = float(raw[0])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
    cols = list(zip(*nodes, strict=True))
    return Forest(*(np.array(c, t) for c, t in zip(cols, (int, float, int, int, float), strict=True)), np.array(roots), depth, start)


def trained(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Forest | None:
    x, y = feature_table(training_rows(docs, labels, "quality", most_labelled, id_col, text_col))
    return fit(x, y, {FEATURES.index(f): s for f, s in MONOTONE.items()})


def _judged(texts: list[bytes], forest: Forest | None, cut: float) -> tuple[list[Base], np.ndarray, np.ndarray]:
    got = [features(t) for t in texts]
    score = forest.score(np.array([x for _, x in got], float)) if forest and got else np.ones(len(got))
    failed = np.array([b.failed for b, _ in got], bool)
    return [b for b, _ in got], score, ~failed & (score >= cut)


def quality_rules(docs: DataFrame, labels: DataFrame, cut: float = 0.3, most_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for each row.

    ``kept`` is false where the base rules fail, else whether the forest's score reaches ``cut``. The forest learns from
    at most ``most_labelled`` labelled rows, the documented bound of its sample; without rows of both labels everything
    that passes the base rules is kept. A null text has no words, so it fails; repeated rows stay, each judged alike; an
    empty table gives an empty one.
    """
    forest = trained(docs, labels, most_labelled, id_col, text_col)

    def run(batches):
        for part in slices(batches):
            b, score, kept = _judged(part.column(1).to_pylist(), forest, cut)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[i] for x in b], pa.int64()) for i in range(5)), pa.array([x.failed for x in b], pa.bool_()), pa.array(kept), pa.array(score)], ["id", *Base._fields, "base_failed", "kept", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
           .mapInArrow(run, f"id {kind}, {', '.join(f'{f} long' for f in Base._fields)}, base_failed boolean, kept boolean, score double"))
    return out.withColumnRenamed("id", id_col)


def kept_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.3, most_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that ``quality_rules`` keeps; judged where they are, without a shuffle. Null and
    empty texts fail the base rules, so they go; repeated rows stay or go together; an empty table gives an empty one; extra
    columns may have any names. Without labels of both classes whatever passes the base rules stays."""
    forest = trained(docs, labels, most_labelled, id_col, text_col)

    def run(batches):
        for part in slices(batches):
            at = part.schema.get_field_index(text_col)
            texts = [t.encode() if isinstance(t, str) else t or b"" for t in part.column(at).to_pylist()]
            yield part.filter(pa.array(_judged(texts, forest, cut)[2]))

    return docs.mapInArrow(run, docs.schema)
