"""M1, M3, M4 and M7 for every experiment at once, against numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codescope.operators import keyed as K
from codescope.operators import neighbours as NB

POINTS = "experiment_id int, solution_id bigint, vector array<double>"


def points(sizes, width=6, seed=1, blobs=3):
    r = np.random.default_rng(seed)
    out, i = [], 0
    for g, n in enumerate(sizes):
        centres = r.normal(size=(blobs, width)) * 5
        for _ in range(n):
            out.append((g, i, [float(x) for x in centres[r.integers(blobs)] + r.normal(size=width)]))
            i += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, POINTS).repartition(5)


def lloyd(ids, v, k=3, restarts=10, seed=42):
    """Labels by the definition: seeded farthest-first starts, Lloyd to a standstill, lowest cost."""
    best = None
    for r in range(restarts):
        centres = [v[min(range(len(ids)), key=lambda i: (hashlib.md5(f"{seed + r}:{ids[i]}".encode()).hexdigest(), ids[i]))]]
        while len(centres) < k:
            d = np.min([((v - c) ** 2).sum(1) for c in centres], 0)
            centres.append(v[int(d.argmax())])
        centres = np.array(centres)
        for _ in range(100):
            own = ((v[:, None] - centres) ** 2).sum(2).argmin(1)
            centres = np.array([v[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
        d = ((v[:, None] - centres) ** 2).sum(2)
        cost = d.min(1).sum()
        if best is None or cost < best[0] - 1e-9:
            best = cost, d.argmin(1)
    number = {}
    return [number.setdefault(c, len(number)) for c in best[1]]


@pytest.mark.parametrize("block", [4096, 7])
def test_kmeans_by_equals_lloyd(spark, monkeypatch, block):
    rows = points([40, 1, 2, 25, 3])
    monkeypatch.setattr(K.in_blocks, "__defaults__", (block,))
    got = {(r.experiment_id, r.solution_id): r.cluster for r in K.kmeans_by(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for g in range(5):
        own = [(i, v) for e, i, v in rows if e == g]
        assert [got[g, i] for i, _ in own] == lloyd([i for i, _ in own], np.array([v for _, v in own]))


def test_kmeans_by_copies_and_empty(spark):
    rows = [(1, i, [1.0, 2.0]) for i in range(9)] + [(1, 9, None), (None, 10, [0.0, 0.0])]
    got = K.kmeans_by(frame(spark, rows)).collect()
    assert sorted((r.solution_id, r.cluster) for r in got) == [(i, 0) for i in range(9)]
    assert K.kmeans_by(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [4096, 6])
def test_pca_by_equals_numpy(spark, monkeypatch, block):
    rows = points([50, 1, 2, 31], seed=4)
    monkeypatch.setattr(K.in_blocks, "__defaults__", (block,))
    got = {r.solution_id: (r.x, r.y) for r in K.pca_by(frame(spark, rows)).collect()}
    for g in range(4):
        ids, v = [i for e, i, _ in rows if e == g], np.array([v for e, _, v in rows if e == g])
        c = v - v.mean(0)
        xy = np.array([got[i] for i in ids])
        if len(ids) == 1:
            assert (xy == 0).all()
            continue
        _, s, vt = np.linalg.svd(c, full_matrices=False)
        axes = vt[:2] * np.where(vt[:2][range(2), np.abs(vt[:2]).argmax(1)] < 0, -1, 1)[:, None]
        live = s[:2] > 1e-9  # two rows have one direction
        assert np.allclose(xy[:, live], (c @ axes.T)[:, live], atol=1e-9) and np.allclose(xy[:, ~live], 0, atol=1e-9)


def test_axes_satisfy_the_eigen_equation(spark):
    """|C v - lambda v| is at rounding level for every group."""
    rows = points([60, 45], seed=9)
    for r in K.principal_axes(K.in_blocks(frame(spark, rows), "experiment_id", "solution_id", "vector", 8)).collect():
        v = np.array([x for e, _, x in rows if e == r.group])
        cov = np.cov(v.T)
        for value, axis in zip(r.values, np.array(r.axes).reshape(2, -1)):
            assert np.abs(cov @ axis - value * axis).max() < 1e-9 * np.trace(cov)


def test_one_entry_vectors(spark):
    got = {r.solution_id: (r.x, r.y) for r in K.pca_by(frame(spark, [(1, 1, [2.0]), (1, 2, [4.0]), (1, 3, [9.0])])).collect()}
    assert got == {1: (-3.0, 0.0), 2: (-1.0, 0.0), 3: (4.0, 0.0)}


def brute_nearest(ids, v, k):
    out = {}
    for a, x in zip(ids, v):
        d = sorted((float(np.sqrt(((x - y) ** 2).sum())), b) for b, y in zip(ids, v) if b != a)[:k]
        out[a] = [(b, n + 1, round(z, 9)) for n, (z, b) in enumerate(d)]
    return out


@pytest.mark.parametrize("block", [1024, 9])
def test_nearest_equals_brute_force(spark, monkeypatch, block):
    rows = points([70, 1, 5, 16])
    rows += [(4, 1000 + i, [1.0] * 6) for i in range(30)]  # copies: ties go to the smaller id
    monkeypatch.setattr(NB, "BLOCK", block)
    got = {}
    for r in NB.nearest(frame(spark, rows)).collect():
        got.setdefault(r.solution_id, []).append((r.neighbour, r.rank, round(r.distance, 9)))
    for g in range(5):
        own = [(i, v) for e, i, v in rows if e == g]
        for i, want in brute_nearest([i for i, _ in own], [np.array(v) for _, v in own], 15).items():
            assert sorted(got.get(i, []), key=lambda x: x[1]) == want


def test_descent_finds_nearly_all_neighbours(spark):
    """Vectors without any structure are the hardest case; the share of true neighbours is at least 0.95."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        F.col("vec_id").alias("solution_id"), F.col("embedding").cast("array<double>").alias("vector"))
    found = NB.descend(v).cache()
    assert found.count() == 15 * v.count() and NB.recall(v, found) >= 0.95
    assert found.where("neighbour = solution_id").count() == 0
    assert found.groupBy("solution_id").agg(F.countDistinct("neighbour").alias("n"), F.max("rank").alias("m")).where("n <> 15 OR m <> 15").count() == 0


def test_descent_small_and_empty(spark):
    rows = points([9])
    got = {}
    for r in NB.descend(frame(spark, rows)).collect():
        got.setdefault(r.solution_id, []).append((r.neighbour, r.rank, round(r.distance, 9)))
    want = brute_nearest([i for _, i, _ in rows], [np.array(v) for *_, v in rows], 15)
    assert {i: sorted(x, key=lambda y: y[1]) for i, x in got.items()} == want
    assert NB.descend(frame(spark, [])).count() == 0


def test_descent_over_many_leaves(spark, monkeypatch):
    """Leaves far smaller than the table: starts and rounds together still find nearly all neighbours."""
    monkeypatch.setattr(NB, "LEAF", 250)
    r = np.random.default_rng(7)
    v = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(r.normal(size=(3000, 24)).round(3))], POINTS).repartition(5)
    found = NB.descend(v).cache()
    assert found.count() == 15 * 3000 and NB.recall(v, found) >= 0.99
    assert found.where("neighbour = solution_id").count() == 0


def test_descent_of_copies(spark, monkeypatch):
    """A vector held by more rows than a leaf has is dealt to many leaves; its copies are neighbours at distance 0."""
    monkeypatch.setattr(NB, "LEAF", 64)
    rows = points([300]) + [(0, 1000 + i, [1e8] * 5 + [0.5]) for i in range(700)]
    got = NB.descend(frame(spark, rows)).where("solution_id >= 1000").collect()
    assert len(got) == 700 * 15 and {(r.distance, r.neighbour >= 1000) for r in got} == {(0.0, True)}
    trees = NB._trees(spark.createDataFrame([(i, v) for _, i, v in rows], "id bigint, vector array<double>"), 1000, 6, 42)
    leaves = [np.bincount(NB._codes(np.array([v for *_, v in rows]), np.array([i for _, i, _ in rows]), *t)) for t in trees]
    assert max(x.max() for x in leaves) <= 3 * 64


def test_one_leaf_is_exact_with_ties_and_repeated_ids(spark):
    rows = points([60], seed=4) + [(0, 500 + i, [2.0] * 6) for i in range(40)]
    got = {}
    for r in NB.descend(frame(spark, rows + rows[:7])).collect():
        got.setdefault(r.solution_id, []).append((r.neighbour, r.rank, round(r.distance, 9)))
    want = brute_nearest([i for _, i, _ in rows], [np.array(v) for *_, v in rows], 15)
    twice = {i for _, i, _ in rows[:7]}
    assert {i: sorted(x, key=lambda y: y[1]) for i, x in got.items() if i not in twice} == {i: x for i, x in want.items() if i not in twice}
    for i in twice:  # a row that comes twice is its own nearest, as ever
        assert [x[0] for x in sorted(got[i], key=lambda y: y[1])] == sorted([i, *(x[0] for x in want[i][:14])], key=[i, *(x[0] for x in want[i])].index)


def test_descent_ships_only_what_is_new(spark):
    """Rows with nothing new around them ship no vectors; numbers exact in single precision travel so."""
    graph = spark.createDataFrame([(1, 2, 0.5, False), (2, 1, 0.5, False), (3, 4, 0.1, True), (4, 3, 0.1, False), (5, 1, 2.0, False)], NB.LISTS)
    got = {(r.id, r.neighbour, r.fresh) for r in NB._around(graph, 2).collect()}
    assert got == {(3, 4, True), (4, 3, True)}


def test_cluster_maps_join_every_embedded_solution(spark):
    rows = points([20, 12])
    sol = spark.createDataFrame([(e, i, f"m{i % 3}", i // 4) for e, i, _ in rows] + [(0, 999, "m0", 1)],
                                "experiment_id int, solution_id bigint, model string, prompt_id int")
    got = K.cluster_maps(sol, frame(spark, rows).select("solution_id", "vector")).collect()
    assert sorted(r.solution_id for r in got) == [i for _, i, _ in rows] and {r.cluster for r in got} == {0, 1, 2}
