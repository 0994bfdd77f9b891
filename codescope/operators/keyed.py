"""M1, M3 and M7 for every group (experiment) at once: keyed k-means and principal components.

The rows of a group are dealt to blocks of about ``BLOCK`` rows, so a group that holds a third of all rows is many tasks. What all
blocks of a group need (its mean, centres or axes) is a small row that is cogrouped with each of them; what they
return are sums, reduced with partial aggregation. One job serves all groups, whatever their number.

Vectors of one group have one width. Rows without a group, id or vector are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codescope.sources.scratch import materialise

BLOCK = 4096
RESTARTS, SEED = 10, 42
MOST_ROUNDS = 100
STILL = 1e-9


def in_blocks(points: DataFrame, group: str, id_col: str, vec_col: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``group, block, id, vector`` (doubles), dealt to blocks by a hash of the id, and the ``group, block`` there are; both written."""
    p = points.select(F.col(group).alias("group"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector")).dropna()
    sizes = p.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = materialise(p.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks"), "blocked")
    return rows, materialise(rows.select("group", "block").distinct(), "blocks")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), len(flat) // max(len(lists), 1))


def lists(rows: np.ndarray) -> pa.Array:
    rows = np.asarray(rows, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def with_blocks(points: tuple[DataFrame, DataFrame], per_group: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(block's rows, its group's rows of per_group)`` for every block of :func:`in_blocks`, as Arrow tables."""
    rows, blocks = points
    every = per_group.join(blocks, "group")
    return rows.groupBy("group", "block").cogroup(every.groupBy("group", "block")).applyInArrow(fn, schema)


def _sum(name: str):
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(name))))


# ------------------------------------------------------------------ M3
def principal_axes(points: tuple[DataFrame, DataFrame], components: int = 2) -> DataFrame:
    """``group, mean, values, axes`` of :func:`in_blocks` rows: eigenvalues and unit axes (one after the other) of the sample covariance.

    Products are centred in the blocks and summed row by row of the matrix; a task then holds one group's matrix, of the vectors'
    width squared. The largest absolute loading of an axis is positive.
    """
    means = materialise(points[0].groupBy("group").agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("vector")))).alias("mean"), F.count(F.lit(1)).alias("n")), "means")

    def products(rows: pa.Table, mean: pa.Table) -> pa.Table:
        v = matrix(rows.column("vector")) - np.array(mean.column("mean")[0].as_py())
        m = v.T @ v
        return pa.table({"group": rows.column("group").take(pa.array([0] * len(m))),
                         "i": np.arange(len(m)), "row": lists(m)})

    kind = dict(points[0].dtypes)["group"]
    rows = with_blocks(points, means, products, f"group {kind}, i bigint, row array<double>").groupBy("group", "i").agg(_sum("row").alias("row"))

    def axes(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        values, vectors = np.linalg.eigh(matrix(t.column("row")) / max(t.column("n")[0].as_py() - 1, 1))
        order = np.argsort(-values, kind="stable")[:components]
        a = vectors[:, order].T
        a *= np.where(a[np.arange(len(a)), np.abs(a).argmax(1)] < 0, -1.0, 1.0)[:, None]
        return pa.table({"group": t.column("group")[:1], "mean": t.column("mean")[:1], "values": lists(np.maximum(values[order], 0)[None]),
                         "axes": lists(a.reshape(1, -1))})

    return materialise(rows.join(means, "group").groupBy("group").applyInArrow(
        axes, f"group {kind}, mean array<double>, values array<double>, axes array<double>"), "axes")


def pca_by(points: DataFrame, group: str = "experiment_id", id_col: str = "solution_id", vec_col: str = "vector") -> DataFrame:
    """M3 per group: ``group, id, x, y``. A lone row is at (0, 0); vectors of one entry have y = 0."""
    blocked = in_blocks(points, group, id_col, vec_col)
    kinds = dict(blocked[0].dtypes)

    def scores(rows: pa.Table, fit: pa.Table) -> pa.Table:
        v = matrix(rows.column("vector")) - np.array(fit.column("mean")[0].as_py())
        a = np.array(fit.column("axes")[0].as_py()).reshape(-1, v.shape[1])
        xy = v @ a.T
        return pa.table({"group": rows.column("group"), "id": rows.column("id"), "x": xy[:, 0],
                         "y": xy[:, 1] if xy.shape[1] > 1 else np.zeros(len(xy))})

    found = with_blocks(blocked, principal_axes(blocked), scores, f"group {kinds['group']}, id {kinds['id']}, x double, y double")
    return found.select(F.col("group").alias(group), F.col("id").alias(id_col), "x", "y")


# ------------------------------------------------------------------ M1
def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    return np.stack([((v - c) ** 2).sum(1) for c in centres], 1)


def _by_run(centres: pa.Table) -> list[tuple[int, np.ndarray]]:
    t = centres.sort_by([("r", "ascending"), ("c", "ascending")])
    r, m = t.column("r").to_numpy(), matrix(t.column("centre"))
    return [(int(x), m[r == x]) for x in np.unique(r)]


def spread_starts(points: tuple[DataFrame, DataFrame], k: int, restarts: int, seed: int) -> DataFrame:
    """``group, r, c, centre``: for each restart a row chosen by a seeded hash, then ``k - 1`` times the row farthest from those chosen.

    Ties go to the smallest id. A group of fewer rows, or of fewer distinct ones, repeats a start.
    """
    kinds = dict(points[0].dtypes)
    first = points[0].groupBy("group").agg(*[F.min_by("vector", F.struct(F.md5(F.concat_ws(":", F.lit(seed + r), "id").cast("binary")), "id")).alias(f"s{r}")
                                          for r in range(restarts)])
    centres = materialise(first.select("group", F.posexplode(F.array(*[f"s{r}" for r in range(restarts)])).alias("r", "centre")).select(
        "group", "r", F.lit(0).alias("c"), "centre"), "starts")

    def far(rows: pa.Table, have: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        v, ids, out = matrix(rows.column("vector")), rows.column("id"), []
        for r, m in _by_run(have):
            d = _distances(v, m).min(1)
            out.append((r, int(d.argmax()), float(d.max())))
        at = pa.array([i for _, i, _ in out])
        return pa.table({"group": rows.column("group").take(pa.array([0] * len(out))), "r": pa.array([r for r, _, _ in out], pa.int32()),
                         "d": [d for *_, d in out], "id": ids.take(at), "centre": rows.column("vector").take(at)})

    for c in range(1, k):
        found = with_blocks(points, centres, far, f"group {kinds['group']}, r int, d double, id {kinds['id']}, centre array<double>")
        # the farthest; of equal ones the smallest id
        top = found.groupBy("group", "r").agg(F.max("d").alias("d")).join(found, ["group", "r", "d"]).groupBy("group", "r").agg(
            F.min_by("centre", "id").alias("centre"))
        centres = materialise(centres.unionByName(top.select("group", "r", F.lit(c).alias("c"), "centre")), "starts")
    return centres


def kmeans_by(points: DataFrame, group: str = "experiment_id", id_col: str = "solution_id", vec_col: str = "vector", k: int = 3,
              restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """M1 per group: ``group, id, cluster`` of the restart with the lowest cost (ties: the first).

    Lloyd rounds over all groups and restarts together, until no centre moves. An empty cluster keeps its centre. Clusters
    are numbered by their smallest member; ties between centres go to the first.
    """
    blocked = in_blocks(points, group, id_col, vec_col)
    kinds = dict(blocked[0].dtypes)
    centres = spread_starts(blocked, k, restarts, seed)

    def sums(rows: pa.Table, have: pa.Table) -> pa.Table:
        v, out = matrix(rows.column("vector")), []
        for r, m in _by_run(have):
            d = _distances(v, m)
            own = d.argmin(1)
            for c in range(len(m)):
                mine = own == c
                out.append((r, c, int(mine.sum()), float(d[mine, c].sum()), v[mine].sum(0)))
        return pa.table({"group": rows.column("group").take(pa.array([0] * len(out))), "r": pa.array([o[0] for o in out], pa.int32()),
                         "c": pa.array([o[1] for o in out], pa.int32()), "n": [o[2] for o in out], "cost": [o[3] for o in out],
                         "total": lists(np.array([o[4] for o in out]))})

    schema = f"group {kinds['group']}, r int, c int, n bigint, cost double, total array<double>"
    for _ in range(MOST_ROUNDS):
        step = with_blocks(blocked, centres, sums, schema).groupBy("group", "r", "c").agg(
            F.sum("n").alias("n"), F.sum("cost").alias("cost"), _sum("total").alias("total"))
        moved = step.join(centres, ["group", "r", "c"]).withColumn("next", F.when(F.col("n") > 0, F.transform("total", lambda x: x / F.col("n"))).otherwise(F.col("centre")))
        shift = F.aggregate(F.zip_with("next", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)
        moved = materialise(moved.select("group", "r", "c", "cost", F.col("next").alias("centre"), shift.alias("shift")), "centres")
        centres = moved.select("group", "r", "c", "centre")
        if (moved.agg(F.max("shift")).first()[0] or 0.0) <= STILL:
            break
    best = moved.groupBy("group", "r").agg(F.sum("cost").alias("cost")).groupBy("group").agg(F.min_by("r", F.struct("cost", "r")).alias("r"))

    def labels(rows: pa.Table, have: pa.Table) -> pa.Table:
        (_, m), = _by_run(have)
        return pa.table({"group": rows.column("group"), "id": rows.column("id"), "c": pa.array(_distances(matrix(rows.column("vector")), m).argmin(1), pa.int32())})

    found = materialise(with_blocks(blocked, centres.join(best, ["group", "r"]), labels, f"group {kinds['group']}, id {kinds['id']}, c int"), "labels")
    order = found.groupBy("group", "c").agg(F.min("id").alias("first"))  # at most k rows of a group
    order = order.withColumn("cluster", F.row_number().over(Window.partitionBy("group").orderBy("first")) - 1).drop("first")
    return found.join(order, ["group", "c"]).select(F.col("group").alias(group), F.col("id").alias(id_col), "cluster")


# ------------------------------------------------------------------ M7
def cluster_maps(solutions: DataFrame, vectors: DataFrame, k: int = 3, group: str = "experiment_id") -> DataFrame:
    """M7 per group: ``group, solution_id, model, prompt_id, x, y, cluster`` of the embedded solutions of every experiment."""
    points = materialise(solutions.select(group, "solution_id").join(vectors.select("solution_id", "vector"), "solution_id"), "points")
    return (solutions.select(group, "solution_id", "model", "prompt_id").join(pca_by(points, group), [group, "solution_id"])
            .join(kmeans_by(points, group, k=k), [group, "solution_id"]))
