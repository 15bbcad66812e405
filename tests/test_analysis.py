"""Geometry, projection, clustering and reports."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.operators import cluster, embed, geometry, report, scale
from loopweave.plans.pipeline import Parameters, analyse
from loopweave.plans.views import residue_view

SF = "/root/testdata/sf0.001"


def turn(seed):
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else -q


def test_kabsch():
    p = np.random.default_rng(0).normal(size=(6, 3))
    assert np.allclose(geometry.kabsch_align(p, p), p, atol=1e-10)
    moved = p @ turn(1).T + 5
    assert np.allclose(geometry.kabsch_align(p, moved), moved, atol=1e-10)
    r, *_ = geometry.kabsch_transform(p, p * [1, 1, -1])
    assert np.linalg.det(r) == pytest.approx(1) and geometry.rmsd(geometry.kabsch_align(p, p * [1, 1, -1]), p * [1, 1, -1]) > 0.1
    assert np.allclose(geometry.kabsch_transform(np.empty((0, 3)), np.empty((0, 3)))[0], np.eye(3))
    with pytest.raises(ValueError):
        geometry.kabsch_transform(p, p[:3])


def test_rmsd():
    assert geometry.rmsd(np.zeros((1, 3)), np.array([[3.0, 4, 0]])) == 5
    assert geometry.rmsd(np.empty((0, 3)), np.empty((0, 3))) == 0


def structs(spark, items):
    points = "array<struct<x:double,y:double,z:double>>"
    return spark.createDataFrame([(n, k, [tuple(map(float, p)) for p in fw], [tuple(map(float, p)) for p in cdr]) for k, (n, fw, cdr) in enumerate(items)], f"structure_id string, seq_no int, fw {points}, cdr {points}")


SQUARE = [(0, 0, 0), (4, 0, 0), (4, 4, 0), (0, 4, 1)]


def test_pairs(spark):
    s = structs(spark, [("a", SQUARE, [(2, 2, 0), (3, 2, 0)]), ("b", SQUARE, [(4, 4, 0), (5, 4, 0)]), ("c", SQUARE[:2], [(1, 1, 1)]), ("d", SQUARE, []), ("e", SQUARE + [(9, 9, 9)], [(2, 2, 0), (3, 2, 0), (7, 7, 7)])])
    got = {(r.i, r.j): r.rmsd for r in geometry.pair_rmsd(s).collect()}
    assert set(got) == {("a", "b"), ("a", "e"), ("b", "e")}
    assert got["a", "b"] == pytest.approx(8**0.5) and got["a", "e"] == pytest.approx(0, abs=1e-9)
    assert {(r.i, r.j) for r in geometry.near_pairs(s, 1.0).collect()} == {("a", "e")}


def test_near_pairs_are_all_pairs_below(spark):
    rng = np.random.default_rng(3)
    items = []
    for k in range(40):
        fw, cdr = rng.normal(size=(5 + k % 3, 3)) * 0.1 + SQUARE[k % 2] + np.arange(5 + k % 3)[:, None] * [3, 1, k % 2], rng.normal(size=(2 + k % 2, 3)) * 0.6 + 4
        r = turn(k)
        items.append((f"s{k:02}", fw @ r.T + k, cdr @ r.T + k))
    s = structs(spark, items)
    every = {(r.i, r.j): r.rmsd for r in geometry.pair_rmsd(s).collect()}
    assert len(every) == 40 * 39 // 2
    for below in (0.5, 1.0, 2.0):
        near = {(r.i, r.j): r.rmsd for r in geometry.near_pairs(s, below).collect()}
        assert set(near) == {k for k, v in every.items() if v < below}
        assert all(v == pytest.approx(every[k]) for k, v in near.items())


def test_products_agree_with_singular_values():
    """Random frameworks, noisy copies, and such as leave a turn nearly or wholly open: in a plane, on a line, in one point, mirrored."""
    rng = np.random.default_rng(11)
    fw, cdr = rng.normal(0, 9, (60, 12, 3)), rng.normal(0, 6, (60, 5, 3))
    fw[10:20], cdr[10:20] = fw[10] + rng.normal(0, 0.2, (10, 12, 3)), cdr[10] + rng.normal(0, 0.2, (10, 5, 3))
    fw[19], cdr[19] = fw[10], cdr[10]
    fw[20:25, :, 2] *= 1e-4
    fw[25:30, :, 1:] *= 1e-6
    fw[30:32] = 3.0
    fw[32:40] = fw[:8] * [1, 1, -1]
    a = geometry._Cut(fw, cdr, 12, 5)
    a.factors()
    every = np.arange(60)
    got = geometry._superposed(a, a, every, every)
    x, y = (k.ravel() for k in np.meshgrid(every, every, indexing="ij"))
    want = geometry.pair_distances([fw[k] for k in x], [cdr[k] for k in x], [fw[k] for k in y], [cdr[k] for k in y]).reshape(60, 60)
    settled = np.ones(60, bool)
    settled[25:32] = False  # any turn about the line, or about the point, is as good
    assert np.abs(got - want)[np.ix_(settled, settled)].max() < 1e-9 and np.isfinite(got).all()


@pytest.mark.parametrize("find", [geometry.pair_rmsd, geometry.pair_rmsd_unaligned, lambda s: geometry.near_pairs(s, 1.25)])
def test_pairs_are_not_joined_with_coordinates(spark, find):
    """Blocks are dealt once for each other block and nothing is joined, sorted or written pair by pair."""
    s = structs(spark, [(f"s{k}", SQUARE, [(k, 0, 0)]) for k in range(5)])
    assert "Join" not in find(s)._jdf.queryExecution().executedPlan().toString()


def test_number_of_blocks_is_bounded(spark, monkeypatch):
    count = lambda n: geometry.block_count(n, geometry.BLOCK, geometry.SPLIT, geometry.WIDEST)
    assert [count(n) for n in (0, 1, 513, 10_256, 102_560, 393_216)] == [1, 1, 2, 12, 12, 12] and count(615_360) == 19
    monkeypatch.setattr(geometry, "BLOCK", 10)
    monkeypatch.setattr(geometry, "SPLIT", 3)
    monkeypatch.setattr(geometry, "TILE", 7)
    rng = np.random.default_rng(2)
    s = structs(spark, [(f"s{k}", rng.normal(size=(5 + k % 2, 3)) * 9, rng.normal(size=(2 + k % 3, 3)) * 9) for k in range(100)])
    assert all(len({(r.i, r.j) for r in rows}) == len(rows) == 4950 for rows in (geometry.pair_rmsd(s).collect(), geometry.near_pairs(s, 1e3).collect(), geometry.pair_rmsd_unaligned(s).collect()))


def test_pairs_take_little_room_in_files(spark, tmp_path):
    """Ids in a hashed order, 45,000 pairs: names leave in runs, and of the two ways of a pair the second finds its distance again."""
    rng = np.random.default_rng(4)
    s = structs(spark, [(f"s{k}", rng.normal(size=(5, 3)) * 9, rng.normal(size=(4, 3)) * 9) for k in range(300)]).repartition(7, "structure_id")
    for name, rows, most in (("pair_rmsd", geometry.pair_rmsd(s), 8.65), ("unaligned", geometry.pair_rmsd_unaligned(s), 8.65), ("centred", geometry.pair_rmsd_unaligned(s, centred=True), 8.65), ("both", report.rmsd_cells(s), 6.5)):
        rows.coalesce(1).write.parquet(path := str(tmp_path / name))
        found = {(r.i, r.j): r.rmsd for r in spark.read.parquet(path).collect()}
        assert len(found) == (300 * 300 if name == "both" else 300 * 299 // 2)
        assert all(int(i[1:]) < int(j[1:]) for i, j in found) if name != "both" else all(found[j, i] == d for (i, j), d in found.items())
        room = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet")) / len(found)
        assert room < most, (name, room)


def linkage_by_hand(d, t):
    groups = [[k] for k in range(len(d))]
    while True:
        best = min(((max(d[x, y] for x in a for y in b), a, b) for a, b in itertools.combinations(groups, 2)), default=(np.inf,), key=lambda z: z[0])
        if not best[0] < t:
            return sorted(map(sorted, groups))
        groups = [g for g in groups if g not in best[1:]] + [sorted(best[1] + best[2])]


def test_near_pairs_of_copies_of_one_fold(spark, monkeypatch):
    """Noisy copies of one fold fall into few cells: blocks split these, and the pairs whose coordinates are joined are few."""
    rng = np.random.default_rng(5)
    fw, cdr = rng.normal(0, 12, (20, 3)), rng.normal(0, 12, (30, 3))
    near = [cdr + rng.normal(0, 2, cdr.shape) for _ in range(100)]
    loops = [near[k % 100] + rng.normal(0, 0.3 if k >= 100 else 0, cdr.shape) for k in range(300)]
    s = structs(spark, [(f"s{k}", fw @ turn(k).T + k, c @ turn(k).T + k) for k, c in enumerate(loops)])
    monkeypatch.setattr(geometry, "BLOCK", 64)
    whole = {(r.i, r.j): r.rmsd for r in geometry.pair_rmsd(s).collect()}
    found = {(r.i, r.j): r.rmsd for r in geometry.near_pairs(s, 1.25).collect()}
    want = {p: d for p, d in whole.items() if d < 1.25}
    assert found.keys() == want.keys() and 0 < len(want) < 0.01 * len(whole) and all(abs(found[p] - want[p]) < 1e-9 for p in want)
    away = [np.linalg.norm(np.array(c) - fw.mean(0), axis=1) for c in loops]
    reached = sum(np.sqrt(((a - b) ** 2).mean()) < 1.25 for a, b in itertools.combinations(away, 2))
    assert reached < 0.05 * len(whole)


def test_complete_linkage_in_rounds(spark):
    """200 random graphs at once, distances of few values and of many, some components by tasks and some by rounds: the result of
    merging one pair at a time, ties included."""
    rng = np.random.default_rng(3)
    edges, want = [], {}
    for graph in range(200):
        n, ties = int(rng.integers(3, 16)), rng.integers(0, 5)
        x = rng.random((n, 2)) * 2
        d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(2))
        if ties:
            d = np.round(d * ties) / ties
        names = graph * 100 + rng.permutation(n)
        some = [(int(min(names[i], names[j])), int(max(names[i], names[j])), float(d[i, j])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.9]
        order = sorted(names.tolist())
        place = {v: k for k, v in enumerate(order)}
        owner = cluster.complete_linkage(n, [(place[a], place[b], z) for a, b, z in some], 1.1)
        want |= {v: order[owner[k]] for k, v in enumerate(order)}
        edges += some
    pairs = spark.createDataFrame(edges, "a long, b long, d double")
    for most in (20, 10_000):
        got = {r["item"]: r["first"] for r in cluster.linked(pairs, 1.1, most).collect()}
        assert {k: got.get(k, k) for k in want} == want, most


def test_many_identical_structures_are_one_cluster(spark):
    """Millions of equal distances: all merge in one step; a second group with distances of their own takes rounds."""
    pairs = spark.range(3_000).select(F.col("id").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(2_999)))).where("a < b").select("a", F.col("b").cast("long").alias("b"), F.lit(1e-9).alias("d"))
    other = spark.range(5_000, 5_200).select(F.col("id").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(5_000), F.lit(5_199)))).where("a < b").select("a", F.col("b").cast("long").alias("b"), (F.pmod(F.xxhash64("a", "b"), F.lit(10_000)) / 20_000).alias("d"))
    got = cluster.linked(pairs.union(other), 1.25, 5_000).groupBy("first").count().collect()
    assert sorted(map(tuple, got)) == [(0, 3_000), (5_000, 200)]


def test_linkage_of_nothing(spark):
    none = spark.createDataFrame([(1, 2, 3.0), (4, 4, 0.1)], "a long, b long, d double")
    assert cluster.linked(none, 1.25).count() == 0 and cluster.linked(none.limit(0), 1.25).count() == 0


def test_complete_linkage():
    assert list(cluster.complete_linkage(3, [(0, 1, 1.0), (1, 2, 1.1), (0, 2, 2.0)], 1.25)) == [0, 0, 2]
    assert list(cluster.complete_linkage(2, [(0, 1, 1.25)], 1.25)) == [0, 1]
    for seed in range(30):
        x = np.random.default_rng(seed).normal(size=(14, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        own = cluster.complete_linkage(14, [(i, j, d[i, j]) for i in range(14) for j in range(i)], 1.2)
        assert sorted([k for k in range(14) if own[k] == o] for o in set(own)) == linkage_by_hand(d, 1.2)


def test_structural_clusters(spark):
    near = [(2, 2, 0), (3, 2, 0)]
    got = cluster.structural_clusters(structs(spark, [("z", SQUARE, near), ("y", SQUARE, [(20, 2, 0), (21, 2, 0)]), ("x", SQUARE, near), ("w", SQUARE, [])]), 1.0)
    assert {r.structure_id: (r.structural_cluster, r.representative) for r in got.collect()} == {"z": (0, "z"), "x": (0, "z"), "y": (1, "y"), "w": (2, "w")}
    one = cluster.structural_clusters(structs(spark, [("a", SQUARE, near)]), 1.25).collect()
    assert [(r.structural_cluster, r.representative) for r in one] == [(0, "a")]


def test_density_labels():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (8, 3)), rng.normal(5, 0.1, (9, 3)), [[50, 50, 50]]])
    assert list(cluster.density_labels(x, 3)) == [0] * 8 + [1] * 9 + [-1]
    assert list(cluster.density_labels(np.ones((2, 5)), 3)) == [0, 0]
    assert len(cluster.density_labels(rng.normal(size=(15, 10)), 3)) == 15
    twice = np.concatenate([np.zeros((4, 2)), np.ones((4, 2))])
    assert list(cluster.density_labels(twice, 3)) == [0] * 4 + [1] * 4


def density_by_hand(x, least):
    """Single linkage by cutting: the rows that hang together without their longest link, again and again."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def parts(rows, below):
        left, out = set(rows), []
        while left:
            todo, part = [left.pop()], []
            while todo:
                r = todo.pop()
                part.append(r)
                near = {q for q in left if d[r, q] < below}
                left -= near
                todo += near
            out.append(sorted(part))
        return out

    def cut(rows):
        """The two parts of ``rows`` and the length at which they part."""
        for length in sorted({d[a, b] for a in rows for b in rows if a < b}, reverse=True):
            if len(out := parts(rows, length)) > 1:
                return length, out

    def best(rows, born):
        """The mass of the cluster that starts as ``rows``, and the labelled clusters below or it."""
        mass, alive = 0.0, rows
        while True:
            if len(alive) < 2:
                return mass, [rows]
            length, (a, b) = cut(alive)
            big = [p for p in (a, b) if len(p) >= least]
            mass += sum(len(p) for p in (a, b) if len(big) == 2 or len(p) < least) * (1 / length - born)
            if len(big) == 2:
                below = [best(p, 1 / length) for p in big]
                total = sum(m for m, _ in below)
                return (total, [c for _, cs in below for c in cs]) if total > mass else (mass, [rows])
            if not big:
                return mass, [rows]
            alive = big[0]

    whole, labels = list(range(len(x))), np.full(len(x), -1)
    while len(whole) >= 2:  # the root is never chosen: what first parts in two
        length, (a, b) = cut(whole)
        big = [p for p in (a, b) if len(p) >= least]
        if len(big) == 2:
            for k, c in enumerate(sorted(c for p in big for c in best(p, 1 / length)[1])):
                labels[c] = k
        if len(big) != 1:
            break
        whole = big[0]
    return labels


@pytest.mark.parametrize("least", [2, 3, 5])
def test_density_labels_against_cutting(least):
    """Unequal groups, noise and none of them planted as an answer."""
    for seed in range(12):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, 14, 4)
        x = np.concatenate([rng.normal(rng.uniform(-4, 4, 2), rng.uniform(0.1, 1.2), (n, 2)) for n in sizes] + [rng.uniform(-8, 8, (6, 2))])
        assert list(cluster.density_labels(x, least)) == list(density_by_hand(x, least)), (seed, least)


def test_spanning_tree_is_least():
    x = np.random.default_rng(1).normal(size=(30, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    own, total = list(range(30)), 0.0
    for w, i, j in sorted((d[i, j], i, j) for i in range(30) for j in range(i)):
        if own[i] != own[j]:
            total += w
            own = [own[i] if o == own[j] else o for o in own]
    assert cluster.spanning_tree(x)[:, 2].sum() == pytest.approx(total)


def test_distributed_tree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.2, (25, 3)), rng.normal(4, 0.2, (30, 3)), rng.normal(9, 3, (6, 3)), np.zeros((4, 3))])
    one = [r.cluster for r in cluster.density_clusters(points(spark, x)).orderBy("seq_no").collect()]
    monkeypatch.setattr(cluster, "TREE_BLOCK", 20)
    monkeypatch.setattr(cluster, "BALL_ROWS", 4)
    df = points(spark, x)
    tree = cluster.distributed_tree(df.withColumnRenamed("seq_no", "key"), len(x)).collect()
    assert len(tree) == len(x) - 1 and sum(r.d for r in tree) == pytest.approx(cluster.spanning_tree(x)[:, 2].sum())
    assert [r.cluster for r in cluster.density_clusters(df).orderBy("seq_no").collect()] == one and len(set(one)) >= 3


@pytest.mark.parametrize("kind", ["grid", "copies", "clusters"])
def test_ways_out_are_the_shortest(monkeypatch, kind):
    """Bounds leave out nothing, whatever is tied: the first of the shortest edges of all pairs, by length and then rows."""
    monkeypatch.setattr(cluster, "BALL_ROWS", 5)
    rng = np.random.default_rng(6)
    x = {"grid": rng.integers(0, 4, (90, 2)).astype(float), "copies": np.repeat(rng.normal(size=(30, 5)), 3, 0), "clusters": rng.normal(size=(6, 4))[rng.integers(0, 6, 90)] * 9 + rng.normal(size=(90, 4)) * 0.1}[kind]
    d = np.sqrt(sum((x[:, None, k] - x[None, :, k]) ** 2 for k in range(x.shape[1])))
    for comps in (90, 30, 4):
        comp = np.unique(rng.integers(0, comps, 90), return_inverse=True)[1]
        for left, right in ((np.arange(90),) * 2, (np.arange(0, 90, 2), np.arange(1, 90, 2))):
            may = np.isin(np.arange(90), left)[:, None] & np.isin(np.arange(90), right)[None, :]
            may = (may | may.T) & (comp[:, None] != comp[None, :])
            whole = np.where(may, d, np.inf)
            best = np.array([whole[comp == c].min() for c in range(comp.max() + 1)])
            same = left is right or None
            near, at, pairs = cluster.leaving(x, comp, left, left if same else right, best + 1e-9 if same is None else np.full(len(best), np.inf))
            for c in range(comp.max() + 1):
                rows = np.flatnonzero(comp == c)
                got = min(((near[r], min(r, at[r]), max(r, at[r])) for r in rows), key=lambda e: (round(e[0], 9), e[1:]))
                want = min(((whole[r, q], min(r, q), max(r, q)) for r in rows for q in range(90)), key=lambda e: (round(e[0], 9), e[1:]))
                assert got[0] == pytest.approx(want[0], abs=1e-9) and (kind == "clusters" or got[1:] == want[1:])


def test_tree_of_clusters_compares_few_pairs(spark):
    """3,000 rows in clusters: the bounds leave out most pairs, and the tree is Prim's."""
    rng = np.random.default_rng(8)
    x = rng.uniform(-50, 50, (12, 3))[rng.integers(0, 12, 3_000)] + rng.normal(size=(3_000, 3))
    compared = []
    tree = cluster.distributed_tree(points(spark, x).withColumnRenamed("seq_no", "key"), len(x), 300, compared).collect()
    want = cluster.spanning_tree(x)
    assert sorted(sorted((r.a, r.b)) for r in tree) == sorted(sorted(map(int, e[:2])) for e in want)
    assert sum(compared) < 0.2 * len(compared) * len(x) ** 2 / 2, compared


def test_cells_are_dealt_to_a_bounded_number_of_groups(spark, monkeypatch):
    """Of 25, 150 and 244 cells (1,000,000 rows) each is dealt 12, 12 and 16 times; 16 cells and more in three groups give Prim's tree, where bounds leave out little."""
    assert [cluster.block_count(n, 1, cluster.GROUPS, cluster.GROUP_CELLS) for n in (3, 25, 150, 244)] == [3, 12, 12, 16]
    monkeypatch.setattr(cluster, "GROUPS", 3)
    monkeypatch.setattr(cluster, "GROUP_CELLS", 1_000)
    x = np.random.default_rng(9).normal(size=(320, 12)) + 1e3
    tree = cluster.distributed_tree(points(spark, x).withColumnRenamed("seq_no", "key"), len(x), 20).collect()
    assert sorted(sorted((r.a, r.b)) for r in tree) == sorted(sorted(map(int, e[:2])) for e in cluster.spanning_tree(x))


def points(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "seq_no int, vector array<double>")


@pytest.mark.parametrize("method", ["umap", "tsne", "pca"])
@pytest.mark.parametrize("k", [2, 3])
def test_projection(spark, method, k):
    x = np.random.default_rng(0).normal(size=(10, 20))
    got = [[r.dim1, r.dim2, r.dim3] for r in embed.reduce_dimensions(points(spark, x), method, k).orderBy("seq_no").collect()]
    assert np.isfinite(got).all() and np.shape(got) == (10, 3) and (np.array(got)[:, k:] == 0).all()
    again = [[r.dim1, r.dim2, r.dim3] for r in embed.reduce_dimensions(points(spark, x), method, k).orderBy("seq_no").collect()]
    assert np.allclose(got, again)


@pytest.mark.parametrize("method", ["umap", "tsne"])
def test_projection_keeps_groups_and_places_the_rest(spark, method):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.3, (40, 8)), rng.normal(6, 0.3, (40, 8))])
    got = np.array([[r.dim1, r.dim2] for r in embed.reduce_dimensions(points(spark, x), method, 2, fitted=50).orderBy("seq_no").collect()])
    near = ((got[:, None] - got[None]) ** 2).sum(-1).argsort(1)[:, 1:6]
    assert ((near < 40) == (np.arange(80) < 40)[:, None]).mean() > 0.95


def test_projection_of_one_and_two_rows(spark):
    one = embed.reduce_dimensions(points(spark, np.ones((1, 5))), "umap", 2).collect()
    assert [(r.dim1, r.dim2, r.dim3) for r in one] == [(1, 1, 0)]
    for method in ("umap", "tsne", "pca"):
        two = embed.reduce_dimensions(points(spark, [[0, 0, 1], [1, 1, 0]]), method, 2).collect()
        assert np.isfinite([[r.dim1, r.dim2] for r in two]).all()


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(2).normal(size=(50, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5])
    got = np.array([[r.dim1, r.dim2, r.dim3] for r in scale.pca(points(spark, x)).orderBy("seq_no").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (x - x.mean(0)) @ vt[:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_standardize(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "k int, a double, b double")
    assert sorted((r.k, r.a, r.b) for r in scale.standardize(df, ["a", "b"]).collect()) == [(1, -1, 0), (2, 1, 0)]


def test_numbered(spark):
    df = spark.createDataFrame([(v,) for v in np.random.default_rng(0).permutation(500).tolist()], "v long")
    assert all(r.v == r.n for r in cluster.numbered(df, "v", "n").collect())


def result(spark):
    return spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("c", 0, 2.0), ("d", 1, float("nan")), ("e", 1, None), ("f", -1, 0.5)], "structure string, cluster int, hotspot_score double")


def test_summary(spark):
    got = {r.cluster: (r.members, r.representative, r.mean_hotspot) for r in report.cluster_summary(result(spark)).collect()}
    assert got == {0: (3, "b", 1.667), 1: (2, "d", None), -1: (1, "f", 0.5)}


def test_exports(spark, tmp_path):
    df = result(spark).where("cluster = 0")
    path = report.export_csv(df, tmp_path / "new" / "deep" / "r.csv")
    assert path.is_absolute() and path.read_text().splitlines()[0] == "structure,cluster,hotspot_score" and len(path.read_text().splitlines()) == 4
    assert report.export_csv(df, str(path), include_index=True).read_text().startswith(",structure")
    assert json.loads(report.to_json(df))[0] == {"structure": "a", "cluster": 0, "hotspot_score": 1.0}


def test_json_knows_no_nan(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", 1.0)], "structure string, v double")
    assert json.loads(report.to_json(df), parse_constant=pytest.fail) == [{"structure": "a", "v": None}, {"structure": "b", "v": None}, {"structure": "c", "v": 1.0}]


def test_summary_is_sorted(spark):
    df = spark.createDataFrame([(f"s{k}", k % 7 - 1, float(k)) for k in range(50)], "structure string, cluster int, hotspot_score double").repartition(5)
    assert [r.cluster for r in report.cluster_summary(df).collect()] == [-1, 0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("wrong", [{"mode": "Structural"}, {"method": "mds"}, {"n_components": 4}, {"min_cluster_size": 1}, {"min_cluster_size": 21}, {"rmsd_threshold": 0.4}, {"rmsd_threshold": 5.1}])
def test_parameters_are_checked(wrong):
    with pytest.raises(ValueError):
        Parameters(**wrong)


def test_matrix(spark):
    pairs = spark.createDataFrame([("a", "b", 1.5)], "i string, j string, rmsd double")
    assert [tuple(r) for r in report.rmsd_matrix(pairs, ["b", "a", "c"]).collect()] == [("b", 0.0, 1.5, None), ("a", 1.5, 0.0, None), ("c", None, None, 0.0)]


@pytest.mark.parametrize("mode", ["features", "structural"])
def test_analysis(spark, mode):
    view = residue_view(spark, SF).where("seq_no < 30").drop("seq_no")
    out = analyse(view, Parameters(mode=mode, method="pca", min_cluster_size=3))
    assert out.result.count() == 30 and out.summary.count() >= 1
    if mode == "structural":
        found = {r.structure: r.representative for r in out.result.collect()}
        assert len(set(found.values())) == 3 and all(int(k) // 10 == int(v) // 10 for k, v in found.items())
    assert analyse(view.where("structure_id = '1'")).result is None


def test_stream(spark, tmp_path):
    from loopweave.streaming.ingest import stream_features
    from tests.test_structures import SMALL

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdb").write_text(SMALL)
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    stream_features(spark, *args).awaitTermination()
    (tmp_path / "in" / "b.pdb").write_text(SMALL)
    (tmp_path / "in" / "c.pdb").write_text("nothing")
    stream_features(spark, *args).awaitTermination()
    assert sorted(r.structure_id for r in spark.read.parquet(str(tmp_path / "out/features")).collect()) == ["a", "b"]
    assert [r.structure_id for r in spark.read.parquet(str(tmp_path / "out/errors")).collect()] == ["c"]


def test_heatmap_has_every_cell(spark):
    rng = np.random.default_rng(5)
    whole = [(rng.normal(size=(6, 3)), rng.normal(size=(n, 3))) for n in (4, 5, 4)]
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.linalg.det(turn)
    whole[2] = tuple(p @ turn.T + 7 for p in whole[0])
    made = [*whole, (rng.normal(size=(2, 3)), rng.normal(size=(4, 3)))]
    rows = [(f"s{k}", k, *([tuple(map(float, q)) for q in p] for p in s)) for k, s in enumerate(made)]
    df = spark.createDataFrame(rows, f"structure_id string, seq_no int, fw {geometry.POINTS}, cdr {geometry.POINTS}")
    found = report.rmsd_cells(df).collect()
    got = {(r.i, r.j): r.rmsd for r in found}
    assert len(found) == len(got) == 16
    for a in range(4):
        assert got[f"s{a}", f"s{a}"] == 0
        for b in range(a):
            want = geometry.pair_distances([made[b][0]], [made[b][1]], [made[a][0]], [made[a][1]])[0]
            assert got[f"s{a}", f"s{b}"] == got[f"s{b}", f"s{a}"]
            assert got[f"s{a}", f"s{b}"] == pytest.approx(want, abs=1e-6) if a < 3 else got[f"s{a}", f"s{b}"] is None
    assert got["s0", "s2"] == pytest.approx(0, abs=1e-6)


def test_heatmap_query_covers_all_structures(spark):
    from loopweave.plans import registry

    cells = registry.QUERIES["rmsd_heatmap"](spark, "/root/testdata/sf0.001")
    row = cells.agg({"*": "count", "i": "max"}).first()
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert row["count(1)"] == n * n


def test_nearest_rows_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 30)
    x = np.random.default_rng(1).normal(size=(100, 5))
    got = {r.i: [e.j for e in r.near] for r in embed.nearest(points(spark, x).select(F.col("seq_no").cast("long").alias("i"), "vector"), 100, 7).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert [got[k] for k in range(100)] == d.argsort(1)[:, :7].tolist()


def test_rows_are_dealt_to_a_bounded_number_of_blocks(spark, monkeypatch):
    """Twelve blocks at 10 and at 600 thousand rows, for the nearest rows and for the graph; tiles within a block change nothing, ties included."""
    for size in (embed.BLOCK, embed.HELD):
        assert [embed.block_count(n, size, embed.SPLIT, embed.WIDEST) for n in (900, 102_560, 615_360)] == [1, 12, 12]
    for name, value in (("BLOCK", 5), ("SPLIT", 3), ("TILE", 8)):
        monkeypatch.setattr(embed, name, value)
    x = np.random.default_rng(1).integers(0, 4, (100, 3)).astype(float)
    rows = points(spark, x).select(F.col("seq_no").cast("long").alias("i"), "vector")
    got = {r.i: [(e.d, e.j) for e in r.near] for r in embed.nearest(rows, 100, 7).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert got == {k: [(d[k, j], j) for j in np.lexsort((range(100), d[k]))[:7].tolist()] for k in range(100)}


def test_no_copy_is_the_neighbour_of_all_its_copies(spark, monkeypatch):
    """Of 200 equal rows each chooses those that follow it in a circle, over several blocks; the default is the smallest ids."""
    monkeypatch.setattr(embed, "BLOCK", 40)
    x = np.tile(np.random.default_rng(4).normal(size=6) * 100, (200, 1))
    rows = points(spark, x).select(F.col("seq_no").cast("long").alias("i"), "vector")
    got = {r.i: [(e.d, e.j) for e in r.near] for r in embed.nearest(rows, 200, 5, spread=True).collect()}
    # beyond the last id the circle starts again, so ids that follow are those of the next steps modulo 200
    assert got == {i: [(0.0, (i + s) % 200) for s in range(1, 6)] for i in range(200)}
    got = {r.i: [e.j for e in r.near] for r in embed.nearest(rows, 200, 5).collect()}
    assert got == {i: [j for j in range(6) if j != i][:5] for i in range(200)}


def test_edges_pull_as_one_by_one():
    rng = np.random.default_rng(3)
    rows, cols, p = np.sort(rng.choice(np.r_[0:20, 25:40], 300)), rng.integers(0, 90, 300), rng.random(300)
    for k in (2, 3):
        y, around = rng.normal(size=(40, k)), rng.normal(size=(50, k))
        want = np.zeros((40, k))
        for r, c, w in zip(rows, cols, p, strict=True):
            gap = y[r] - np.r_[y, around][c]
            want[r] += w * gap / (1 + gap @ gap)
        assert np.allclose(embed._Pull(rows, cols, p)(y, around), want, atol=1e-12)


def test_blocks_of_a_layout_have_a_partition_each(spark):
    """One partition holds two of twelve blocks numbered from 0, and its task takes twice as long in each round."""
    dealt = lambda numbers, to: spark.createDataFrame([(k,) for k in numbers], "block int").repartition(to, "block").select(F.spark_partition_id()).distinct().count()
    assert dealt(range(12), 24) < 12
    for blocks in (1, 3, 12, 16):
        numbers = embed._numbers(spark, blocks)
        assert len(numbers) == dealt(numbers, blocks) == blocks


@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_nearest_of_many_tiles(spark, monkeypatch, shift):
    """Lists are sorted late and distances are measured in the end; 120 copies and near ties are settled exactly, also far from the origin."""
    for name, value in (("BLOCK", 150), ("SPLIT", 2), ("TILE", 16)):
        monkeypatch.setattr(embed, name, value)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(180, 6)), np.tile(rng.normal(size=6), (120, 1)), rng.normal(size=6) + rng.normal(size=(100, 6)) * 1e-6])[rng.permutation(400)] + shift
    got = {r.i: [(e.d, e.j) for e in r.near] for r in embed.nearest(points(spark, x).select(F.col("seq_no").cast("long").alias("i"), "vector"), 400, 9).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert got == {k: [(d[k, j], j) for j in np.lexsort((range(400), d[k]))[:9].tolist()] for k in range(400)}


def test_charges_of_parts_add_up():
    y = np.random.default_rng(5).normal(size=(400, 2)) * [9, 3]
    grid = embed.Grid(y.min(0), y.max(0))
    parts = sum(grid.charges(p) for p in np.array_split(y, 7))
    assert np.allclose(parts, grid.charges(y), atol=1e-9)
    assert np.allclose(grid.push(y, grid.field(parts)), embed.plane_push(y)[0], atol=1e-9)
    assert np.isfinite(grid.push(y * 3, grid.field(parts))).all()


def test_repulsion_in_space_from_a_sample(spark, monkeypatch):
    monkeypatch.setattr(embed, "HELD", 60)
    monkeypatch.setattr(embed, "DRAWN", 75)
    group = np.arange(150) % 2
    x = np.array([[0.0] * 8, [6.0] * 8])[group] + np.random.default_rng(0).normal(0, 0.3, (150, 8))
    got = np.array([[r.dim1, r.dim2, r.dim3] for r in embed.reduce_dimensions(points(spark, x), "tsne", 3, fitted=50).orderBy("seq_no").collect()])
    near = ((got[:, None] - got[None]) ** 2).sum(-1).argsort(1)[:, 1:6]
    assert (group[near] == group[:, None]).mean() > 0.95 and np.isfinite(got).all()


def test_repulsion_in_the_plane():
    y = np.random.default_rng(2).normal(size=(500, 2)) * [30, 4]
    push, norm = embed.plane_push(y)
    want = embed._tsne_push(0, y)
    assert norm == pytest.approx(want[1], rel=5e-3) and ((push - want[0]) ** 2).sum() < 0.02**2 * (want[0] ** 2).sum()


@pytest.mark.parametrize(("method", "k"), [("umap", 3), ("tsne", 2), ("tsne", 3)])
def test_rows_beyond_one_task_keep_groups_of_their_own(spark, monkeypatch, method, k):
    """The last group has no row among the fifty with the smallest hashes."""
    monkeypatch.setattr(embed, "BLOCK", 50)
    monkeypatch.setattr(embed, "HELD", 60)
    first = {r.k for r in spark.range(150).select(F.col("id").cast("int").alias("k")).orderBy(F.xxhash64("k"), "k").limit(50).collect()}
    late = [q for q in range(150) if q not in first][:20]
    rng = np.random.default_rng(0)
    group = np.arange(150) % 2
    group[late] = 2
    x = np.array([[0.0] * 8, [6.0] * 8, [3.0, -3.0] * 4])[group] + rng.normal(0, 0.3, (150, 8))
    got = np.array([[r.dim1, r.dim2, r.dim3] for r in embed.reduce_dimensions(points(spark, x), method, k, fitted=50).orderBy("seq_no").collect()])
    near = ((got[:, None] - got[None]) ** 2).sum(-1).argsort(1)[:, 1:6]
    assert (group[near] == group[:, None])[late].mean() > 0.95 and (group[near] == group[:, None]).mean() > 0.95
    assert np.isfinite(got).all() and (got[:, k:] == 0).all()
