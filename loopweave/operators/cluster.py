"""Clustering: complete linkage of structures below a distance threshold, and density clustering of vectors."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, keep, scratch, written
from .geometry import block_count, near_pairs
from .graph import components

#: Vectors whose spanning tree is built in one task; of more, cells of about this size are compared, as far as bounds ask for it.
TREE_BLOCK = 4_096
#: Rows of a ball within a cell, and rows by which cells are laid out, for each of them.
BALL_ROWS, LAID_OUT = 32, 32
#: Partitions at most that cells are dealt to.
TASKS = 2_000
#: Groups of cells whose pairs are the tasks of a round, and the most cells of a group; where these do not suffice there are more groups.
GROUPS, GROUP_CELLS = 12, 16
#: Edges of a component that one task links; larger components are linked in distributed rounds, with the same result.
TASK_EDGES = 100_000
#: Rounds before what is left is parted into components again.
ROUNDS = 4
#: Rows of one density clustering at most: its hierarchy is one object in one task, and the driver holds a row for each cell.
DENSITY_ROWS = 1_000_000


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with its place in ascending ``order`` from 0, without one task that sees all rows: rows are dealt by range, each
    range is numbered, and starts after the sizes of the ranges before it (one row for each)."""
    dealt = written(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").count()
    before = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_within")).cast("int")).drop("_range", "_before", "_within")


def complete_linkage(n: int, edges: list[tuple[int, int, float]], threshold: float) -> np.ndarray:
    """Cluster of each of ``n`` items, named by its first item. ``edges`` (a, b, distance) holds the distances that exist;
    others are infinite. Two clusters merge while all distances between them are below the threshold, nearest first, ties by
    the clusters' first items. A cluster's neighbours are those that both its parts had, at the larger distance."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    heap = []
    for a, b, d in edges:
        if d < threshold:
            near[a][b] = near[b][a] = d
            heap.append((d, min(a, b), max(a, b)))
    heapq.heapify(heap)
    into = list(range(n))  # the cluster that a merged one went into, always of a smaller first item
    while heap:
        d, a, b = heapq.heappop(heap)
        if into[a] != a or into[b] != b or near[a].get(b) != d:
            continue
        into[b] = a
        both = {c: max(x, near[b][c]) for c, x in near[a].items() if c != b and c in near[b]}
        for c in near[a].keys() | near[b].keys():
            near[c].pop(a, None)
            near[c].pop(b, None)
        near[a], near[b] = both, {}
        for c, x in both.items():
            near[c][a] = x
            heapq.heappush(heap, (x, min(a, c), max(a, c)))
    owner = np.array(into)
    for k in range(n):
        owner[k] = owner[owner[k]]
    return owner


def _link(within: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(node, first): complete linkage below ``threshold`` of (component, a, b, d), one component a task."""
    def link(rows):
        a, b, d = rows.column("a").to_pylist(), rows.column("b").to_pylist(), rows.column("d").to_pylist()
        items = sorted(set(a) | set(b))
        place = {x: k for k, x in enumerate(items)}
        owner = complete_linkage(len(items), [(place[x], place[y], z) for x, y, z in zip(a, b, d, strict=True)], threshold)
        kind = rows.schema.field("a").type
        return pa.table({"node": pa.array(items, kind), "first": pa.array([items[o] for o in owner], kind)})

    return within.groupBy("component").applyInArrow(link, f"node {kind}, first {kind}")


def _reciprocal(edges: DataFrame) -> DataFrame:
    """(node, first, parts): merges of one round over (a, b, d), each ``parts`` clusters that become one, named by the first.

    Edges are in the order of distance, then the clusters' names, smaller one first. Complete linkage is reducible in that order: after
    a merge its edges are no earlier than the earlier ones of its parts, so two clusters that are each other's first
    choice merge sooner or later whatever else does, and all such pairs may merge at once. The same holds for more clusters
    that are all equally near to each other and farther from all others; they merge in one step however many they are.
    """
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "d"), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), "d"))))
    by_length = ends.groupBy("u", "d").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    choice = written(by_length.groupBy("u").agg(F.min(F.struct("d", "n", "v")).alias("e")).select("u", "e.d", "e.n", "e.v"), "choice")
    pairs = choice.groupBy(F.least("u", "v").alias("first"), F.greatest("u", "v").alias("b"), "d").agg(F.count("*").alias("sides")).where("sides = 2")
    pairs = pairs.select("first", F.lit(2).cast("long").alias("parts"), F.array("first", "b").alias("nodes"))
    # as many clusters as one has nearest ones and itself, all with the same smallest of these
    group = ["first", "n", "d"]
    some = choice.where("n > 1").withColumn("first", F.least("u", "v"))
    alike = some.groupBy(*group).agg(F.count("*").alias("parts")).where("parts = n + 1")
    members = written(some.join(alike, group).select("u", "first", "d", "parts"), "alike")
    if members.isEmpty():
        return pairs.select(F.explode("nodes").alias("node"), "first", "parts")
    one, two = members.select(F.col("u").alias("a"), "first", "d", "parts"), members.select(F.col("u").alias("b"), "first", "d", "parts")
    met = edges.join(one, ["a", "d"]).join(two, ["b", "first", "d", "parts"]).groupBy("first", "d", "parts").agg(F.count("*").alias("met"))
    whole = met.where("met = parts * (parts - 1) / 2").select("first", "d")
    wide = members.join(whole, ["first", "d"]).select(F.col("u").alias("node"), "first", "parts")
    alone = pairs.select(F.explode("nodes").alias("node"), "first", "parts").join(wide.select("node"), "node", "left_anti").select("node", "first", "parts")
    return wide.union(alone)


def _contracted(edges: DataFrame, step: DataFrame) -> DataFrame:
    """Edges after the merges of ``step``: the largest distance of the parts, where all parts have one."""
    one = step.select(F.col("node").alias("a"), F.col("first").alias("fa"), F.col("parts").alias("na"))
    two = step.select(F.col("node").alias("b"), F.col("first").alias("fb"), F.col("parts").alias("nb"))
    named = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("fa", "a").alias("fa"), F.coalesce("fb", "b").alias("fb"), "d", (F.coalesce("na", F.lit(1)) * F.coalesce("nb", F.lit(1))).alias("all")).where("fa <> fb")
    met = named.groupBy(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max("all").alias("all"))
    return met.where("n = all").select("a", "b", "d")


def linked(pairs: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    """(item, first) of the items of ``pairs`` (a, b, d; each pair once) that merge, by complete linkage below ``threshold``; ``first`` is
    the first item of the cluster. Rows of a pair that is there twice count once, with the larger distance.

    Components of the pairs below the threshold do not interact. One of up to ``most`` edges (``TASK_EDGES``) is linked in one task. Larger
    ones are linked in rounds in which all reciprocal choices merge (see ``_reciprocal``), and are parted into components again now and then, as
    edges go with every merge. Both give the result of merging one pair at a time, ties included. Every round is joins
    and aggregations that are written; no task holds a component.
    """
    most = TASK_EDGES if most is None else most
    kind = pairs.schema["a"].dataType.simpleString()
    edges = pairs.where((F.col("d") < threshold) & (F.col("a") != F.col("b"))).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("d"))
    merges = []
    while True:
        edges = written(edges, "edges")
        held = written(edges.join(components(edges.select("a", "b")), F.col("a") == F.col("node")).select("component", "a", "b", "d"), "held")
        sizes = written(held.groupBy("component").count(), "sizes")
        largest = sizes.agg(F.max("count")).first()[0] or 0
        large = sizes.where(F.col("count") > most).select("component")
        small = held if largest <= most else held.join(large, "component", "left_anti")
        merges.append(written(_link(small, threshold, kind).where("node <> first"), "merges"))
        if largest <= most:
            break
        edges = held.join(large, "component", "left_semi").select("a", "b", "d")
        for _ in range(ROUNDS):
            edges = written(edges, "edges")
            step = written(_reciprocal(edges), "step")
            merges.append(step.where("node <> first").select("node", "first"))
            edges = _contracted(edges, step)
    if len(merges) == 1:
        return merges[0].select(F.col("node").alias("item"), "first")
    # a cluster goes into another one once at most and keeps the smaller name, so merges are trees towards first items
    forest = reduce(DataFrame.union, merges).select(F.col("node").alias("a"), F.col("first").alias("b"))
    return written(components(forest).select(F.col("node").alias("item"), F.col("component").alias("first")), "owner")


def structural_clusters(structs: DataFrame, threshold: float = 1.25) -> DataFrame:
    """(structure_id, seq_no, structural_cluster, representative) by complete linkage of loop distances, strictly below
    ``threshold``. Labels count clusters by their first member in input order, which is also the representative; pairs that
    cannot be compared never meet.

    All members of a cluster are nearer to each other than the threshold, so a cluster lies within a connected component of
    the pairs below it, and components do not interact. Pairs come from ``near_pairs``, clusters from ``linked``. The result is
    written.
    """
    with scratch():
        pairs = written(near_pairs(structs, threshold).select(F.col("si").alias("a"), F.col("sj").alias("b"), F.col("rmsd").alias("d")), "pairs")
        owner = linked(pairs, threshold)
        named = written(structs.select("structure_id", "seq_no").join(owner, F.col("seq_no") == F.col("item"), "left").select("structure_id", "seq_no", F.coalesce("first", "seq_no").alias("first")), "members")
        heads = numbered(named.where("seq_no = first").select("first", F.col("structure_id").alias("representative")), "first", "structural_cluster")
        return keep(written(named.join(heads, "first").select("structure_id", "seq_no", "structural_cluster", "representative"), "clusters"))


def spanning_tree(x: np.ndarray) -> np.ndarray:
    """Edges (a, b, distance) of the Euclidean minimum spanning tree, by Prim's method; n * d memory."""
    n = len(x)
    edges = np.zeros((n - 1, 3))
    best, source, out = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    now = 0
    for k in range(n - 1):
        out[now] = False
        d = np.sqrt(((x - x[now]) ** 2).sum(1))
        closer = out & (d < best)
        best[closer], source[closer] = d[closer], now
        following = int(np.where(out, best, np.inf).argmin())
        edges[k] = source[following], following, best[following]
        now = following
    return edges


def _parted(x: np.ndarray, most: int) -> list[tuple[np.ndarray, list[tuple[int, int, float]]]]:
    """Rows of ``x`` (finite numbers) in parts of ``most`` at most, halved again and again across the coordinate in which they differ most; and the way to each
    part: (coordinate, side, border), the lower side up to the border."""
    done, todo = [], [(np.arange(len(x)), [])]
    while todo:
        rows, way = todo.pop()
        if len(rows) <= most:
            done.append((rows, way))
            continue
        c = int((x[rows].max(0) - x[rows].min(0)).argmax())
        border = float(np.median(x[rows, c]))
        low = x[rows, c] <= border
        if low.all():  # the median is the largest; where all rows are equal there is nothing to part
            low = x[rows, c] < border
            border = float(x[rows[low], c].max()) if low.any() else border
        if not low.any():
            done += [(part, way) for part in np.array_split(rows, -(-len(rows) // most))]
            continue
        todo += [(rows[low], [*way, (c, 0, border)]), (rows[~low], [*way, (c, 1, border)])]
    return done


def _balls(x: np.ndarray) -> tuple[np.ndarray, list[slice], np.ndarray, np.ndarray]:
    """An order of the rows of ``x`` in which balls are together, and the balls: places, middles, radii."""
    parts = [rows for rows, _ in _parted(x, BALL_ROWS)]
    ends = np.cumsum([len(p) for p in parts])
    where = [slice(e - len(p), e) for p, e in zip(parts, ends, strict=True)]
    middle = np.stack([x[p].mean(0) for p in parts])
    return np.concatenate(parts), where, middle, np.array([np.sqrt(((x[p] - m) ** 2).sum(1).max()) for p, m in zip(parts, middle, strict=True)])


class _Cell:
    """The rows ``at`` (numbers) of a task by balls, with factors in single precision whose products are half the squared distances, less
    than nothing."""

    def __init__(self, x: np.ndarray, at: np.ndarray, shifted: np.ndarray):
        order, self.where, self.middle, self.radius = _balls(x[at])
        self.at = at[order]
        self.starts = np.array([w.start for w in self.where])
        rows = shifted[self.at]
        half, one = -(rows * rows).sum(1, keepdims=True) / 2, np.ones((len(rows), 1))
        self.one, self.two = (np.hstack(f).astype(np.float32) for f in ([rows, half, one], [rows, one, half]))


class _Ways:
    """The nearest row of another component, as far as it may be a component's shortest way out, for the rows of a task: distance ``near`` and row ``at``."""

    def __init__(self, x: np.ndarray, comp: np.ndarray, bound: np.ndarray):
        self.x, self.comp, self.bound = x, comp, bound.copy()
        self.near, self.at = np.full(len(x), np.inf), np.full(len(x), -1)
        shifted = x - x.mean(0) if len(x) else x
        size = np.sqrt((shifted * shifted).sum(1).max(initial=0.0)) or 1.0
        # of numbers up to 1 each product is off by less than this
        self.shifted, self.size, self.slack = shifted / size, size, (x.shape[1] + 8) * 2.0**-23

    def cell(self, rows: np.ndarray) -> _Cell:
        return _Cell(self.x, rows, self.shifted)

    def _least(self, rows: np.ndarray) -> np.ndarray:
        return (-((self.bound[self.comp[rows]] / self.size) ** 2) / 2 - self.slack).astype(np.float32)

    def _taken(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        """Of the rows a and b with the products s, those pairs are measured that may be within a component's bound."""
        least, most = self._least(a), self._least(b)
        if np.isinf(least).any() or np.isinf(most).any():  # a component without a bound gets one from the products
            other = np.where(self.comp[a][:, None] != self.comp[b][None, :], s, np.float32(-np.inf))
            best = np.full(len(self.bound), -np.inf)
            np.maximum.at(best, self.comp[a], other.max(1))
            np.maximum.at(best, self.comp[b], other.max(0))
            best = (best - 3 * self.slack).astype(np.float32)
            least, most = np.maximum(least, best[self.comp[a]]), np.maximum(most, best[self.comp[b]])
        r, c = np.divmod(np.flatnonzero((s >= least[:, None]) | (s >= most[None, :])), len(b))
        r, c = a[r], b[c]
        some = self.comp[r] != self.comp[c]
        r, c = r[some], c[some]
        if not len(r):
            return
        d = np.concatenate([np.sqrt(((self.x[r[k : k + 65_536]] - self.x[c[k : k + 65_536]]) ** 2).sum(1)) for k in range(0, len(r), 65_536)])
        for one, two in ((r, c), (c, r)):
            order = np.lexsort((two, d, one))
            first = order[np.flatnonzero(np.r_[True, np.diff(one[order]) != 0])]
            row, to, length = one[first], two[first], d[first]
            closer = (length < self.near[row]) | (length == self.near[row]) & (to < self.at[row])
            self.near[row[closer]], self.at[row[closer]] = length[closer], to[closer]
            np.minimum.at(self.bound, self.comp[row[closer]], length[closer])

    def meet(self, left: _Cell, right: _Cell) -> int:
        """A cell meets another one, or itself; how many pairs were compared. A ball of rows meets the balls of the other side that, by the triangle
        inequality, may hold a row within the bound of a component on either side; what is found tightens the bounds. Balls of one and the same component do not meet."""
        pairs, same = 0, left is right
        gap = np.maximum(np.stack([np.sqrt(((right.middle - m) ** 2).sum(1)) for m in left.middle]) - left.radius[:, None] - right.radius[None, :], 0.0) * (1 - 1e-9)
        low, high = np.minimum.reduceat(self.comp[right.at], right.starts), np.maximum.reduceat(self.comp[right.at], right.starts)
        first = np.full(len(left.where), -1)
        if same:
            for w in left.where:
                self._taken(left.at[w], left.at[w], left.one[w] @ left.two[w].T)
                pairs += (w.stop - w.start) ** 2

        def asked(i: int) -> np.ndarray:
            own = self.comp[left.at[left.where[i]]]
            reach = np.maximum(np.maximum.reduceat(self.bound[self.comp[right.at]], right.starts), self.bound[own].max())
            some = np.flatnonzero((gap[i] <= reach) & ~((low == high) & (low == own.min()) & (low == own.max())))
            return some[some > i] if same else some

        # first the nearest ball of each, then all that are within the bounds as they are by then
        for turn in (0, 1):
            for i in np.argsort(gap.min(1), kind="stable"):
                some = asked(i)
                if len(some) and turn == 0:
                    first[i] = some[gap[i][some].argmin()]
                    some = first[i : i + 1]
                some = some[some != first[i]] if turn else some
                if len(some):
                    w = left.where[i]
                    if some[-1] - some[0] < 1.25 * len(some):  # most of a stretch: it is not copied
                        to = slice(right.where[some[0]].start, right.where[some[-1]].stop)
                    else:
                        to = np.concatenate([np.arange(right.where[j].start, right.where[j].stop) for j in some])
                    b = right.at[to]
                    self._taken(left.at[w], b, left.one[w] @ right.two[to].T)
                    pairs += (w.stop - w.start) * len(b)
        return pairs


def leaving(x: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(distance, row) of the nearest row of another component for each row, between the rows ``left`` and ``right`` (the same, or
    none in common), and how many pairs were compared. ``bound`` holds for each component a length that its shortest way out does
    not exceed; what cannot be as short is left out. Of equal lengths the smaller row wins.

    Products in single precision leave out what is too far by more than their error; differences in double precision measure the others."""
    ways = _Ways(x, comp, bound)
    one = ways.cell(left)
    pairs = ways.meet(one, one if left is right else ways.cell(right))
    return ways.near, ways.at, pairs


def _shortest(keys: pa.Array, names: np.ndarray, comp: np.ndarray, near: np.ndarray, at: np.ndarray) -> tuple:
    """(component, other, d, a, b): the shortest way out of each component and where it leads; rows are in the order of keys."""
    some = np.flatnonzero(np.isfinite(near))
    d, a, b = near[some], np.minimum(some, at[some]), np.maximum(some, at[some])
    order = np.lexsort((b, a, d, comp[some]))
    first = order[np.flatnonzero(np.r_[True, np.diff(comp[some][order]) != 0])] if len(order) else order
    return names[comp[some[first]]], names[comp[at[some[first]]]], d[first], keys.take(pa.array(a[first])), keys.take(pa.array(b[first]))


def _celled(points: DataFrame, n: int, rows: int) -> DataFrame:
    """``points`` (key, vector) with ``cell``, of about ``rows`` rows: halves across coordinates, laid out on a sample of ``LAID_OUT`` rows for each
    cell (those with the smallest hashes of their keys). All rows are dealt; a cell that turns out too large, of equal vectors for instance, is cut by hashes."""
    cells = -(-n // rows)
    sample = points.orderBy(F.xxhash64("key"), "key").limit(cells * LAID_OUT).select("vector").toPandas()["vector"]
    parts = _parted(np.array([list(v) for v in sample], float), LAID_OUT)
    ways = [way for _, way in parts]

    def deal(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cell = np.zeros(len(x), np.int32)
            for k, way in enumerate(ways):
                inside = np.ones(len(x), bool)
                for c, side, border in way:
                    inside &= (x[:, c] > border) if side else (x[:, c] <= border)
                cell[inside] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["key", "vector", "cell"])

    dealt = written(points.mapInArrow(deal, f"key {points.schema['key'].dataType.simpleString()}, vector array<double>, cell int"), "dealt")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("cuts")).orderBy("cell").collect()  # one row a cell
    first = np.cumsum([0, *(r.cuts for r in sizes)]).tolist()
    starts = points.sparkSession.createDataFrame([(r.cell, f, r.cuts) for r, f in zip(sizes, first, strict=False)], "cell int, start int, cuts int")
    return dealt.join(F.broadcast(starts), "cell").select("key", "vector", (F.col("start") + F.pmod(F.xxhash64("key"), F.col("cuts"))).cast("int").alias("cell"))


def distributed_tree(points: DataFrame, n: int, rows: int | None = None, compared: list | None = None) -> DataFrame:
    """(a, b, d): the Euclidean minimum spanning tree of ``n`` (key, vector) rows, by Boruvka's rounds over cells with bounds.

    Rows are dealt into cells of about ``rows`` (``TREE_BLOCK``) near rows. In each round a cell finds the shortest way out of each component among its own rows;
    these, and the distances of the cells' middle rows, bound every component's shortest way out. Two cells meet only if the least
    distance that their rows can have, by the triangle inequality, is within the bound of a component in one of them; inside,
    balls of rows are left out likewise (``leaving``). The shortest of all ways join components, and at least half of these
    vanish. Edges are ordered by length, then keys, so ties cannot close a circle, and bounds keep ties: the tree is that of all pairs.

    Cells meet in tasks of two groups of cells, ``GROUPS`` of them unless a group had more than ``GROUP_CELLS`` cells. Vectors are dealt once, to the pairs of
    their group, and stay on the executors' disks; a round moves names of components and their bounds, and nothing is dealt by pairs of cells. The driver holds one row a
    cell. ``compared`` gets the number of compared pairs of each round.
    """
    spark, rows = points.sparkSession, rows or TREE_BLOCK
    kind = points.schema["key"].dataType.simpleString()
    placed = _celled(points, n, rows)

    def gather(group):
        group = group.sort_by("key")
        x = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        middle = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        radius = float(np.sqrt(((x - x[middle]) ** 2).sum(1).max()))
        return pa.table({"cell": group.column("cell").slice(0, 1), "middle": pa.array([middle], pa.int32()), "radius": [radius], "at": [x[middle].tolist()],
                         "keys": pa.array([group.column("key").to_pylist()], pa.list_(group.schema.field("key").type)), "vectors": pa.array([x.tobytes()], pa.binary())})

    cells = written(placed.groupBy("cell").applyInArrow(gather, f"cell int, middle int, radius double, at array<double>, keys array<{kind}>, vectors binary"), "cells")
    known = cells.select("cell", "middle", "radius", "at").orderBy("cell").collect()  # one row a cell
    place = {r.cell: k for k, r in enumerate(known)}
    at, radius = np.array([r.at for r in known]), np.array([r.radius for r in known])
    far = np.stack([np.sqrt(((at - p) ** 2).sum(1)) for p in at])
    gap = np.maximum(far - radius[:, None] - radius[None, :], 0.0) * (1 - 1e-9)
    names = written(cells.select("cell", F.posexplode("keys").alias("pos", "key")).withColumn("component", F.col("key")), "names")
    found_type = f"component {kind}, other {kind}, d double, a {kind}, b {kind}, compared long"
    groups = block_count(len(known), 1, GROUPS, GROUP_CELLS)
    group = {r.cell: k * groups // len(known) for k, r in enumerate(known)}
    deal = [(c, min(g, other), max(g, other)) for c, g in group.items() for other in range(groups)]
    alone, together = min(len(known), TASKS), min(groups * (groups + 1), TASKS)
    # vectors stay where they are dealt, from their table if an executor is lost
    own = cells.select("cell", "keys", "vectors").repartition(alone, "cell").persist(StorageLevel.DISK_ONLY)
    by_two = cells.select("cell", "keys", "vectors").join(F.broadcast(spark.createDataFrame(deal, "cell int, p int, q int")), "cell").repartition(together, "p", "q").persist(StorageLevel.DISK_ONLY)

    def ways_of(held, state):
        """The rows of these cells in the order of their keys, with their components' names and bounds, and the rows of each cell."""
        at = {c: k for k, c in enumerate(state.column("cell").to_pylist())}
        order = [at[c] for c in held.column("cell").to_pylist()]
        keys = [held.column("keys")[k].values for k in range(held.num_rows)]
        x = np.concatenate([np.frombuffer(held.column("vectors")[k].as_py(), "<f8").reshape(len(keys[k]), -1) for k in range(held.num_rows)])
        comp = np.concatenate([state.column("components")[k].values.to_numpy(zero_copy_only=False) for k in order])
        cell = np.repeat(held.column("cell").to_numpy(), [len(k) for k in keys])
        keys = pa.concat_arrays(keys)
        turn = np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable")
        named, comp = np.unique(comp[turn], return_inverse=True)
        bound = np.full(len(named), np.inf)
        if "bounds" in state.column_names:
            for k in order:
                bound[np.searchsorted(named, state.column("bounded")[k].values.to_numpy(zero_copy_only=False))] = state.column("bounds")[k].values.to_numpy(zero_copy_only=False)
        cell = cell[turn]
        return keys.take(pa.array(turn)), named, _Ways(x[turn], comp, bound), {c: np.flatnonzero(cell == c) for c in at}

    def result(keys, named, ways, compared):
        component, other, d, a, b = _shortest(keys, named, ways.comp, ways.near, ways.at)
        table = pa.table({"component": pa.array(component, keys.type), "other": pa.array(other, keys.type), "d": pa.array(d, pa.float64()), "a": a.cast(keys.type), "b": b.cast(keys.type), "compared": pa.array([0] * len(d), pa.int64())})
        return pa.concat_tables([table, pa.table({f.name: pa.array([compared] if f.name == "compared" else [None], f.type) for f in table.schema})])

    def within(key, state, held):
        keys, named, ways, members = ways_of(held, state)
        cell = ways.cell(members[key[0].as_py()])
        return result(keys, named, ways, ways.meet(cell, cell) if len(named) > 1 else 0)

    tree = None
    while True:
        state = written(names.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("pos", "component"))).alias("c")).select("cell", F.col("c.component").alias("components")), "state")
        # of each cell: its middle row's component, and the only one if there is one
        middle = spark.createDataFrame([(r.cell, r.middle) for r in known], "cell int, middle int")
        shape = {r.cell: r for r in state.join(F.broadcast(middle), "cell").select("cell", F.get("components", F.col("middle")).alias("middle"), (F.array_min("components") == F.array_max("components")).alias("one")).collect()}
        if len({r.middle for r in shape.values()}) == 1 and all(r.one for r in shape.values()):
            own.unpersist()
            by_two.unpersist()
            return tree
        # a task for each cell and for each pair of groups, as far as a shuffle may go: the work is not in the bytes
        local = written(state.repartition(alone, "cell").groupBy("cell").cogroup(own.groupBy("cell")).applyInArrow(within, found_type), "within")
        owner = np.array([shape[r.cell].middle for r in known], object)
        other = np.where(owner[:, None] != owner[None, :], far, np.inf).min(1)
        middles = spark.createDataFrame([(o, float(d)) for o, d in zip(owner.tolist(), other, strict=True)], f"component {kind}, d double")
        bounds = written(local.where("component is not null").select("component", "d").union(middles).groupBy("component").agg(F.min("d").alias("bound")), "bounds")
        present = written(names.select("cell", "component").distinct().join(bounds, "component", "left").groupBy("cell").agg(F.collect_list("component").alias("bounded"), F.collect_list(F.coalesce("bound", F.lit(float("inf")))).alias("bounds")), "present")
        reach = np.zeros(len(known))
        for r in present.select("cell", F.array_max("bounds").alias("reach")).collect():
            reach[place[r.cell]] = r.reach
        one = np.array([shape[r.cell].one for r in known])
        meet = (gap <= np.maximum(reach[:, None], reach[None, :])) & ~(one[:, None] & one[None, :] & (owner[:, None] == owner[None, :]))
        pairs: dict = {}
        for i, j in sorted(np.argwhere(np.triu(meet, 1)).tolist(), key=lambda e: gap[e[0], e[1]]):
            p, q = group[known[i].cell], group[known[j].cell]
            pairs.setdefault((min(p, q), max(p, q)), []).append((known[i].cell, known[j].cell, float(gap[i, j])))

        def across(key, state, held):
            if not state.num_rows or not held.num_rows:
                return pa.table({f: pa.array([], held.schema.field("keys").type.value_type if f in ("component", "other", "a", "b") else pa.float64() if f == "d" else pa.int64()) for f in ("component", "other", "d", "a", "b", "compared")})
            keys, named, ways, members = ways_of(held, state)
            made, done = {}, 0
            for i, j, least in pairs[key[0].as_py(), key[1].as_py()]:
                if least > max(ways.bound[ways.comp[members[i]]].max(), ways.bound[ways.comp[members[j]]].max()):
                    continue
                for c in (i, j):
                    if c not in made:
                        made[c] = ways.cell(members[c])
                done += ways.meet(made[i], made[j])
            return result(keys, named, ways, done)

        asked = spark.createDataFrame([(c, p, q) for c, p, q in deal if (p, q) in pairs], "cell int, p int, q int")
        told = state.join(present, "cell").join(F.broadcast(asked), "cell").repartition(together, "p", "q")
        found = written(local.union(told.groupBy("p", "q").cogroup(by_two.groupBy("p", "q")).applyInArrow(across, found_type)), "found")
        if compared is not None:
            compared.append(found.agg(F.sum("compared")).first()[0] or 0)
        best = written(found.where("component is not null").groupBy("component").agg(F.min(F.struct("d", "a", "b", "other")).alias("e")).select("component", "e.*"), "best")
        chosen = best.select("a", "b", "d").distinct()
        tree = chosen if tree is None else tree.union(chosen)
        for done in (state, local, bounds, present, found):
            discard(done)
        before = names
        names = written(names.join(_followed(best), "component").select("cell", "pos", "key", F.col("into").alias("component")), "names")
        discard(before)


def _followed(best: DataFrame) -> DataFrame:
    """(component, into): where the choices of ``best`` (component, other) end. Every component chooses one other; the only circles are two that
    choose each other, of which the smaller name stands for all that come to it. Each round doubles the steps taken."""
    back = best.select(F.col("component").alias("other"), F.col("other").alias("back"))
    first = F.when((F.col("back") == F.col("component")) & (F.col("component") < F.col("other")), F.col("component")).otherwise(F.col("other"))
    up = written(best.select("component", "other").join(back, "other").select("component", first.alias("into")), "followed")
    while True:
        further = up.select(F.col("component").alias("into"), F.col("into").alias("next"))
        up = written(up.join(further, "into").select("component", F.col("next").alias("into"), (F.col("next") != F.col("into")).alias("moved")), "followed")
        if up.where("moved").isEmpty():
            return up.select("component", "into")


def density_labels(x: np.ndarray, least: int = 3) -> np.ndarray:
    """Labels of the rows of a matrix; see ``labels_of_tree``."""
    return labels_of_tree(len(x), spanning_tree(x) if len(x) > 1 else np.empty((0, 3)), least)


def labels_of_tree(n: int, edges: np.ndarray, least: int = 3) -> np.ndarray:
    """HDBSCAN labels with min_samples 1, so that mutual reachability is the distance itself: single linkage, condensed by
    ``least``, clusters of the largest excess of mass, the root excluded. Noise is -1; with fewer rows than ``least`` all
    are 0. Clusters are numbered by their first row."""
    if n < least or n < 2:
        return np.zeros(n, int)
    edges = edges[np.argsort(edges[:, 2], kind="stable")]
    # the dendrogram: node n + k joins two nodes at the distance of the k-th edge
    head, size = np.arange(2 * n - 1), np.ones(2 * n - 1, int)
    left, right, at = np.zeros(n - 1, int), np.zeros(n - 1, int), np.zeros(n - 1)

    def root(v: int) -> int:
        while head[v] != v:
            head[v] = head[head[v]]
            v = head[v]
        return v

    for k, (a, b, d) in enumerate(edges):
        left[k], right[k], at[k] = root(int(a)), root(int(b)), d
        head[left[k]] = head[right[k]] = n + k
        size[n + k] = size[left[k]] + size[right[k]]
    density = 1.0 / np.maximum(at, max(at.max(), 1.0) * 1e-12)  # equal points have a density that is capped

    def leaves(v: int):
        stack = [v]
        while stack:
            w = stack.pop()
            if w < n:
                yield w
            else:
                stack += [left[w - n], right[w - n]]

    # condense: a split is one only if both sides have ``least`` rows; smaller sides fall out of their cluster
    parent, birth, mass, top, fallen = [-1], [0.0], [0.0], [2 * n - 2], {}
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:
            continue
        k = node - n
        sides = (left[k], right[k])
        big = [s for s in sides if size[s] >= least]
        for s in sides:
            if len(big) == 2:
                mass[c] += size[s] * (density[k] - birth[c])
                parent.append(c)
                birth.append(density[k])
                mass.append(0.0)
                top.append(s)
                stack.append((s, len(parent) - 1))
            elif size[s] >= least:
                stack.append((s, c))
            else:
                mass[c] += size[s] * (density[k] - birth[c])
    children: list[list[int]] = [[] for _ in parent]
    for c in range(1, len(parent)):
        children[parent[c]].append(c)
    chosen, worth = [False] * len(parent), list(mass)
    for c in range(len(parent) - 1, 0, -1):
        below = sum(worth[k] for k in children[c])
        if children[c] and below > mass[c]:
            worth[c] = below
        else:
            chosen[c] = True
    labels = np.full(n, -1)
    picked = []
    stack = list(children[0])
    while stack:
        c = stack.pop()
        if chosen[c]:
            picked.append(sorted(leaves(top[c])))
        else:
            stack += children[c]
    for number, rows in enumerate(sorted(picked)):
        labels[rows] = number
    return labels


def density_clusters(points: DataFrame, least: int = 3, key: str = "seq_no", vector: str = "vector") -> DataFrame:
    """``points`` (key, vector) with ``cluster``. Up to ``TREE_BLOCK`` vectors are clustered in one task. Of more, the
    spanning tree is built by all tasks, and one task gets its edges, three numbers a row; beyond ``DENSITY_ROWS`` rows are
    refused rather than cut."""
    n = points.count()
    if n > DENSITY_ROWS:
        raise ValueError(f"{n} rows; one density clustering takes {DENSITY_ROWS} at most")
    kind = points.schema[key].dataType.simpleString()
    slim = points.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))

    def whole(rows):
        rows = rows.take(pa.array(np.argsort(rows.column("key").to_numpy(zero_copy_only=False), kind="stable")))
        x = np.array(rows.column("vector").to_pylist(), float)
        return pa.table({"key": rows.column("key"), "cluster": pa.array(density_labels(x, least), pa.int32())})

    def from_edges(rows):
        a, b, d = (rows.column(c).to_numpy(zero_copy_only=False) for c in "abd")
        keys, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        edges = np.stack([place[: len(a)], place[len(a) :], d], 1)
        return pa.table({"key": pa.array(keys, rows.schema.field("a").type), "cluster": pa.array(labels_of_tree(len(keys), edges, least), pa.int32())})

    if n <= TREE_BLOCK:
        labels = slim.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(whole, f"key {kind}, cluster int")
    else:
        tree = distributed_tree(slim, n)
        labels = tree.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(from_edges, f"key {kind}, cluster int")
    return points.join(labels.withColumnRenamed("key", key), key)
