"""Nearest neighbours by vantage-point trees against brute force, and the odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.llm import vantage

ROWS = "vec_id long, embedding array<float>, id string, shard string, dim string, score string"


def brute(rows, asked, k):
    """Every pair in double precision, components summed in order."""
    out = {}
    for q in asked:
        scores = []
        for i, v in rows.items():
            if i != q and len(v) == len(rows[q]):
                total = 0.0
                for a, b in zip(rows[q], v, strict=True):
                    total += a * b
                scores.append((-total, i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def searched(df, k, *args, **options):
    rows = vantage.usable(df, "vec_id", "embedding")
    out = {}
    for r in vantage.nearest(rows.where(F.col("id") % 5 == 0), rows, k, *args, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard_rows, block_rows", [(10_000, 10_000), (90, 40)])
def test_factor_one_is_brute_force(spark, monkeypatch, shard_rows, block_rows):
    """Ties, equal and opposite vectors, several lengths, and rows that take no part; one shard and several."""
    monkeypatch.setattr(vantage, "LEAF_ROWS", 8)
    rng = np.random.default_rng(1)
    vectors = {k: rng.integers(-3, 4, 6).astype(float) for k in range(400)} | {k: np.array([1.0, 2, 0, 0, 0, 0]) for k in range(400, 520)} | {k: rng.normal(size=3) for k in range(520, 523)}
    vectors = {k: [float(np.float32(c)) for c in v] for k, v in vectors.items()}
    odd = [None, [], [0.0] * 6, [float("nan")] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("inf")] + [0.0] * 5]
    rows = [(k, v) for k, v in vectors.items()] + [(1_000 + 5 * k, v) for k, v in enumerate(odd)] + [(None, [1.0] * 6), (7, vectors[7]), (10, vectors[10])]
    df = spark.createDataFrame([(k, v, "x", "x", "x", "x") for k, v in rows], ROWS)
    kept = {k: v for k, v in vectors.items() if any(v)}
    got = searched(df, 12, shard_rows=shard_rows, block_rows=block_rows)
    assert got == brute(kept, [k for k in kept if k % 5 == 0], 12)
    assert len(got[520]) == 2


def test_empty_and_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "", "", "", "")], ROWS)
    assert searched(df, 20) == {} and searched(df.limit(0), 20) == {}
    two = df.union(spark.createDataFrame([(3, [-1.0, 0.5], "", "", "", "")], ROWS))
    assert searched(two, 20) == {0: [(3, -1.0)]}
    with pytest.raises(ValueError, match="relaxed"):
        vantage.nearest(df, df, factor=0.5)


def test_of_one_id_the_smallest_vector_stays(spark):
    df = spark.createDataFrame([(k, v, "", "", "", "") for k, v in [(0, [1.0, 1.0]), (0, [1.0, 2.0]), (1, [4.0, 0.0]), (1, [3.0, 9.0])]], ROWS)
    assert searched(df, 20) == {0: [(1, 12.0)]}


def test_pruning_and_recall():
    """On clustered rows the exact search takes few products, and a larger factor takes fewer at a recall of 0.9 or more."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 6_000)] + 0.05 * rng.normal(size=(6_000, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    ids = np.arange(6_000)
    order, nodes = vantage.build(x)
    tree = vantage.Tree(ids[order], x[order], nodes)
    assert sorted(order) == list(ids)
    full = x[:300] @ x.T
    full[np.arange(300), np.arange(300)] = -9
    want = [set(r) for r in np.argsort(-full, 1)[:, :20]]
    shares, recalls = [], []
    for factor in (1.0, 2.0):
        found, _, products = tree.search(ids[:300], x[:300], 20, factor)
        shares.append(products / (300 * 6_000))
        recalls.append(np.mean([len(w & set(f)) for w, f in zip(want, found, strict=True)]) / 20)
    assert recalls[0] == 1 and recalls[1] >= 0.9 and shares[0] < 0.3 and shares[1] < shares[0], (recalls, shares)
