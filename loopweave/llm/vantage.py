"""Approximate nearest neighbours (operator 11): a vantage-point tree in each shard, searched by blocks of queries.

Rows are dealt into shards by a hash of their id, and each shard is one tree. Largest inner products become smallest distances
by one more coordinate: with M the longest row of a shard, a row x gets sqrt(M^2 - |x|^2), and a query is scaled to length M with
0 there, so that distance^2 = 2 M^2 - 2 M <q, x> / |q|. A node's vantage point halves its rows by distance; it keeps the least
and largest distance of each half. By the triangle inequality no row of a half is nearer to a query than ``gap``, the distance of the
query's own distance from that range. A half is left out if ``factor`` * gap is beyond the query's k-th nearest so far: with factor 1
nothing that belongs in the result is lost, with larger ones the search is approximate and cheaper.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, scratch, written

#: Rows of a shard and queries of a block, about: what one task holds.
SHARD_ROWS, BLOCK_ROWS = 8_192, 2_048
LEAF_ROWS = 128
#: The factor that loses nothing.
EXACT = 1.0


#: A node: its rows, its vantage row (none in a leaf), ranges of distance of its halves, numbers of their nodes.
NODE = np.dtype([("begin", "<i8"), ("end", "<i8"), ("vantage", "<i8"), ("range", "<f8", (2, 2)), ("below", "<i8", (2,))])


def _lift(x: np.ndarray) -> tuple[float, np.ndarray]:
    """Length of the longest row, and the coordinate that makes every row as long."""
    square = (x * x).sum(1)
    most = float(np.sqrt(square.max(initial=0.0)))
    return most, np.sqrt(np.maximum(most**2 - square, 0.0))


def build(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of the vantage-point tree of the rows of ``x``: each node's rows are together in ``order``, and its vantage row
    is a place in it."""
    most, lift = _lift(x)
    order, nodes = np.arange(len(x)), []
    todo = [(0, len(x), -1, 0)]
    while todo:
        begin, end, above, side = todo.pop()
        if above >= 0:
            nodes[above]["below"][side] = len(nodes)
        node = {"begin": begin, "end": end, "vantage": -1, "range": np.zeros((2, 2)), "below": [-1, -1]}
        nodes.append(node)
        if end - begin <= leaf_rows:
            continue
        rows = order[begin:end]
        # the row farthest from the one farthest from the first lies at the edge, from where distances differ most
        edge = rows[0]
        for _ in range(2):
            edge = rows[np.argmin(x[rows] @ x[edge] + lift[rows] * lift[edge])]
        away = np.sqrt(np.maximum(2 * most**2 - 2 * (x[rows] @ x[edge] + lift[rows] * lift[edge]), 0.0))
        half = len(rows) // 2
        split = np.argpartition(away, half)  # by rank, so equal rows halve as well
        order[begin:end], away = rows[split], away[split]
        node["vantage"], node["range"] = edge, np.array([[away[:half].min(), away[:half].max()], [away[half:].min(), away[half:].max()]])
        todo += [(begin, begin + half, len(nodes) - 1, 0), (begin + half, end, len(nodes) - 1, 1)]
    out = np.array([tuple(n[f] for f in NODE.names) for n in nodes], NODE)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    inner = out["vantage"] >= 0
    out["vantage"][inner] = place[out["vantage"][inner]]
    return order, out


class Tree:
    """A built tree: rows ``x`` with numbers ``ids`` in its order, and its ``nodes``."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, nodes: np.ndarray):
        self.ids, self.x, self.nodes = ids, x, nodes
        self.most, _ = _lift(x)

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(numbers, scores) of up to ``k`` rows for each query, best first, -1 where there are fewer; and how many products of a
        query and a row were taken. A row with the query's own number is none of its candidates."""
        self.k, self.factor, self.products = k, factor, 0
        self.q, self.query_ids = q, ids
        self.unit = q / np.sqrt((q * q).sum(1))[:, None]
        self.length = np.sqrt((q * q).sum(1))
        self.best, self.found = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        if len(q):
            self.home = np.full(len(q), -1)
            self._descend(0, np.arange(len(q)))
            self._visit(0, np.arange(len(q)))
        return self.found, self.best, self.products

    def _reach(self, rows: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far, with room for rounding."""
        worst = self.best[rows, -1]
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(worst), np.sqrt(np.maximum(2 * self.most**2 - 2 * self.most * worst / self.length[rows], 0.0)), np.inf) + 1e-6 * self.most

    def _gaps(self, node: np.void, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For both halves of a node: how far each query is from them at least; and the half that is nearer."""
        away = np.sqrt(np.maximum(2 * self.most**2 - 2 * self.most * (self.unit[rows] @ self.x[node["vantage"]]), 0.0))
        gap = np.maximum(np.maximum(node["range"][:, :1] - away, away - node["range"][:, 1:]), 0.0)
        return gap, (gap[1] < gap[0]) | (gap[1] == gap[0]) & (away > node["range"][0, 1])

    def _descend(self, number: int, rows: np.ndarray) -> None:
        """Each query's first leaf, always by the nearer half."""
        node = self.nodes[number]
        if node["vantage"] < 0:
            self.home[rows] = number
            return self._leaf(node, rows)
        _, outer = self._gaps(node, rows)
        for side, some in ((0, rows[~outer]), (1, rows[outer])):
            if len(some):
                self._descend(node["below"][side], some)

    def _visit(self, number: int, rows: np.ndarray) -> None:
        """Every other leaf that the bounds do not leave out, for all queries at once."""
        node = self.nodes[number]
        if node["vantage"] < 0:
            return self._leaf(node, rows[self.home[rows] != number])
        gap, _ = self._gaps(node, rows)
        for side in (0, 1):
            some = rows[self.factor * gap[side] <= self._reach(rows)]
            if len(some):
                self._visit(node["below"][side], some)

    def _leaf(self, node: np.void, rows: np.ndarray) -> None:
        x, ids = self.x[node["begin"] : node["end"]], self.ids[node["begin"] : node["end"]]
        self.products += len(rows) * len(x)
        about = self.q[rows] @ x.T
        slack = 1e-9 * self.length[rows] * self.most
        r, c = np.nonzero((about >= (self.best[rows, -1] - slack)[:, None]) & (self.query_ids[rows][:, None] != ids[None, :]))
        if not len(r):
            return
        # scores are summed in the order of the components, as a plain loop does
        score = np.zeros(len(r))
        left, right = self.q[rows].T, x.T
        for d in range(len(left)):
            score += left[d][r] * right[d][c]
        some = np.unique(r)
        back = np.searchsorted(some, r)
        own = rows[some]
        who = np.concatenate([np.repeat(np.arange(len(some)), self.k), back])
        number, value = np.concatenate([self.found[own].ravel(), ids[c]]), np.concatenate([self.best[own].ravel(), score])
        order = np.lexsort((number, -value, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], np.arange(len(some)))[who[order]]
        order = order[place < self.k]
        self.found[own], self.best[own] = number[order].reshape(-1, self.k), value[order].reshape(-1, self.k)


def _matrix(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)


def _one_each(rows: pa.Table) -> pa.Table:
    """One row of each id: that of the smallest vector."""
    ids = rows.column("id").to_numpy()
    if len(np.unique(ids)) == len(ids):
        return rows
    order = np.lexsort((*_matrix(rows, "vector").T[::-1], ids))
    return rows.take(pa.array(order[np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])]))


def _index(rows: pa.Table) -> pa.Table:
    rows = _one_each(rows)
    x = _matrix(rows, "vector")
    order, nodes = build(x)
    return pa.table({"dim": rows.column("dim").slice(0, 1), "shard": rows.column("shard").slice(0, 1), "ids": pa.array([rows.column("id").to_numpy()[order]]), "vectors": [x[order].astype("<f8").tobytes()], "nodes": [nodes.tobytes()]})


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, dim) of the rows that take part: an id, and a vector of finite components, not all zero."""
    v = F.col("vector")
    wrong = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & ~wrong & F.exists(v, lambda c: c != 0)).withColumn("dim", F.size(v))


def _dealt(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def nearest(queries: DataFrame, points: DataFrame, k: int = 20, factor: float = EXACT, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` rows of ``points`` for each row of ``queries`` (both: id, vector, dim, as
    ``usable`` gives them), by falling inner product in double precision, ties by the smaller id, ranks from 1.

    Rows with the query's id are not its candidates. Of several rows of one id that with the smallest vector stays. Vectors of
    different lengths never meet. Equal vectors are all in the index and tie by id. Null, zero and non-finite vectors were left out by
    ``usable``; a query without candidates has no rows; empty tables give an empty one. ``factor`` 1 is exact, up to 1e-9 of rounding in the bounds.

    Every shard's tree is built once and written, then meets every block of queries: n / ``shard_rows`` times m / ``block_rows`` tasks, each
    of which holds one shard and one block. A task's results are k rows a query; the best k of all shards are chosen by rank. The result is written.
    """
    if factor < 1:
        raise ValueError(f"factor {factor}: pruning is relaxed by factors of 1 and more")
    with scratch():
        shards, blocks = _dealt(points.count(), shard_rows), _dealt(queries.count(), block_rows)
        hashed = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
        index = points.withColumn("shard", hashed(shards, 1)).groupBy("dim", "shard").applyInArrow(_index, "dim int, shard int, ids array<long>, vectors binary, nodes binary")
        index = written(index, "index").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = queries.withColumn("block", hashed(blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

        def search(shard: pa.Table, block: pa.Table) -> pa.Table:
            if not shard.num_rows or not block.num_rows:
                return pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
            block = _one_each(block)
            ids, q = block.column("id").to_numpy(), _matrix(block, "vector")
            x = np.frombuffer(shard.column("vectors")[0].as_py(), "<f8").reshape(-1, q.shape[1])
            tree = Tree(shard.column("ids")[0].values.to_numpy(), x, np.frombuffer(shard.column("nodes")[0].as_py(), NODE))
            found, score, _ = tree.search(ids, q, k, factor)
            some = np.isfinite(score)
            return pa.table({"query_id": np.repeat(ids, some.sum(1)), "vec_id": found[some], "score": score[some]})

        key = ["dim", "shard", "block"]
        found = asked.groupBy(*key).cogroup(index.groupBy(*key)).applyInArrow(lambda block, shard: search(shard, block), "query_id long, vec_id long, score double")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return keep(written(found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest"))


#: Every pair, for what factor 1 returns.
SQL = """with v as (select vec_id, embedding::double[] as e from embeddings),
ok as (select * from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, p.vec_id as vec_id, list_inner_product(q.e, p.e) as score from ok q join ok p on q.vec_id % 20 = 0 and q.vec_id <> p.vec_id)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 20"""
