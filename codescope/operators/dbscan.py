"""M2: DBSCAN with cosine distance, exact, over blocks of vectors.

1. Unit-normalise; two vectors of one width are neighbours where 1 - u·v ≤ eps.
2. Vectors are dealt to blocks of about ``BLOCK``; a task has two of them and compares all their rows by a matrix product, in
   slices. Products within ``SLACK`` of the threshold are summed again in order. The work is the square of the
   vectors, as at eps of 0.5 and more no index rules much out; what tasks return is linear in their blocks, never pairs.
3. Core points: neighbourhood size (self included) ≥ min_samples, from counts of each task.
4. Clusters: each task gives the connected components of its core rows as stars; they are joined by star contraction (rounds
   grow with the logarithm of a component's size), each round a written table.
5. Numbering: clusters ordered by their smallest core id (0, 1, …), ranked
   with the distributed prefix-sum rank, not a one-partition window.
6. Border points take the smallest-numbered adjacent cluster; others -1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.operators.components import components
from codescope.operators.describe import average_rank
from codescope.operators.keyed import in_blocks, matrix
from codescope.sources.scratch import materialise

BLOCK, SLICE = 4096, 512
SLACK = 1e-9


def _adjacent(u: np.ndarray, v: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of ``u`` and ``v`` are neighbours; doubtful products are summed entry by entry."""
    out = np.zeros((len(u), len(v)), bool)
    with np.errstate(invalid="ignore", over="ignore"):
        for k in range(0, len(u), SLICE):
            far = 1.0 - u[k:k + SLICE] @ v.T
            out[k:k + SLICE] = far <= eps
            x, y = np.nonzero(np.abs(far - eps) <= SLACK)
            dot = np.zeros(len(x))
            for j in range(u.shape[1]):
                dot += u[k + x, j] * v[y, j]
            out[k + x, y] = 1.0 - dot <= eps
    return out


def _met(rows: DataFrame, eps: float, fn, schema: str) -> DataFrame:
    """``fn(left, right, adjacent)`` for every two blocks of ``rows`` (``group, block, id, vector`` and more), as Arrow tables.

    ``left`` and ``right`` are the rows of the two blocks (one block with itself: the same); rows of one id are not adjacent.
    """
    rows = rows.join(F.broadcast(rows.groupBy("group").agg(F.max("block").alias("last"))), "group")  # a row for each width
    more = [c for c in rows.columns if c not in ("group", "block", "last")]
    low = rows.select("group", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), F.lit(0).alias("side"), *more)
    high = rows.where("block > 0").select("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block") - 1)).alias("i"),
                                          F.col("block").alias("j"), F.lit(1).alias("side"), *more)

    def run(t: pa.Table) -> pa.Table:
        alone = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        side = t.column("side").to_numpy()
        left = t.take(pa.array(np.flatnonzero(side == 0)))
        right = left if alone else t.take(pa.array(np.flatnonzero(side == 1)))
        near = _adjacent(matrix(left.column("vector")), matrix(right.column("vector")), eps) if left.num_rows and right.num_rows else \
            np.zeros((left.num_rows, right.num_rows), bool)
        ids = [x.column("id").to_numpy() for x in (left, right)]
        near &= ids[0][:, None] != ids[1]
        return fn(left, right, near)

    return low.unionByName(high).groupBy("group", "i", "j").applyInArrow(run, schema)


def _degrees(left: pa.Table, right: pa.Table, near: np.ndarray) -> pa.Table:
    found = [pa.table({"id": left.column("id"), "k": near.sum(1).astype(np.int64)})]
    if right is not left:
        found.append(pa.table({"id": right.column("id"), "k": near.sum(0).astype(np.int64)}))
    return pa.concat_tables(found)


def _stars(left: pa.Table, right: pa.Table, near: np.ndarray) -> pa.Table:
    """Links of every row to a first row of its component among these rows."""
    seen, met = np.zeros(near.shape[0], bool), np.zeros(near.shape[1], bool)
    a, b = [], []
    ids, others = left.column("id").to_numpy(), right.column("id").to_numpy()
    for x in np.flatnonzero(near.any(1)):
        if seen[x]:
            continue
        seen[x], front = True, np.array([x])
        while len(front):
            new = np.flatnonzero(near[front].any(0) & ~met)
            met[new] = True
            b.append(others[new])
            front = np.flatnonzero(near[:, new].any(1) & ~seen)
            seen[front] = True
            b.append(ids[front])
            a.append(np.full(len(new) + len(front), ids[x]))
    none = [ids[:0]]
    return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})


def _touched(left: pa.Table, right: pa.Table, near: np.ndarray) -> pa.Table:
    """The smallest cluster next to each row without one."""
    out = []
    for rows, cores, adjacent in ((left, right, near), (right, left, near.T)):
        c = cores.column("cluster").to_numpy(zero_copy_only=False).astype(float)  # rows without a cluster: NaN
        lone = np.flatnonzero(rows.column("cluster").is_null().to_numpy(zero_copy_only=False))
        c = np.where(np.isnan(c), np.inf, c)
        best = np.array([np.min(c[adjacent[x]], initial=np.inf) for x in lone], float)
        hit = np.isfinite(best)
        out.append(pa.table({"id": rows.column("id").take(pa.array(lone[hit])), "cluster": best[hit].astype(np.int32)}))
    return pa.concat_tables(out)


def dbscan(df: DataFrame, id_col: str = "solution_id", vec_col: str = "vector", eps: float = 0.5,
           min_samples: int = 2) -> DataFrame:
    """(id, cluster) with -1 for noise. Fewer points than min_samples → all -1."""
    ids = df.select(F.col(id_col).alias("id"))
    n = ids.count()
    if n < min_samples:
        return ids.select(F.col("id").alias(id_col), F.lit(-1).alias("cluster"))
    norm = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda a, v: a + v * v))
    # zero vectors: no neighbours but themselves
    units = df.select(F.col(id_col).alias("id"), F.when(norm > 0, F.transform(vec_col, lambda v: v / norm)).alias("u")).where("u IS NOT NULL")
    rows, _ = in_blocks(units.withColumn("width", F.size("u")), "width", "id", "u", BLOCK)
    kind = dict(rows.dtypes)["id"]
    deg = _met(rows, eps, _degrees, f"id {kind}, k bigint").groupBy(F.col("id").alias("a")).agg(F.sum("k").alias("k"))
    core = materialise(ids.join(deg, ids["id"] == deg["a"], "left")
                       .select("id", ((F.coalesce("k", F.lit(0)) + 1) >= min_samples).alias("is_core")), "dbscan-core")
    core_ids = core.where("is_core").select("id")
    linked = components(_met(rows.join(core_ids, "id", "left_semi"), eps, _stars, f"a {kind}, b {kind}")).withColumnRenamed("node", "id")
    labels = materialise(core_ids.join(linked, "id", "left").select("id", F.coalesce("label", "id").alias("label")),
                         "dbscan-labels")
    roots = labels.select("label").distinct()
    numbered = average_rank(roots, "label", None, "_r").select(
        "label", (F.col("_r") - 1).cast("int").alias("cluster"))
    core_cl = materialise(labels.join(numbered, "label").select("id", "cluster"), "dbscan-clusters")
    border = ids.limit(0).withColumn("cluster", F.lit(0))
    if core.where("NOT is_core").limit(1).count():
        known = rows.join(core_cl.distinct(), "id", "left")
        border = _met(known, eps, _touched, f"id {kind}, cluster int").groupBy("id").agg(F.min("cluster").alias("cluster"))
    assigned = core_cl.unionByName(border)
    return (ids.join(assigned, "id", "left")
               .select(F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster")))
