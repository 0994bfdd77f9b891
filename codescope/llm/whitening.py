"""Whitening of embeddings by a weighted multiplicity covariance.

Vectors become whole numbers ``x = floor(SCALE * c) + OFFSET``, so equal vectors meet exactly:

* **Group.** Rows with one ``x`` vector are one row with its multiplicity (partial counts before the shuffle, so a vector that
  a third of all rows share is a row for each task). The fit weights are the multiplicities, or one (``weight``).
* **Fit.** Sums ``S`` and the weight ``n`` are exact decimals. Tasks subtract ``S / n`` (whole part in whole numbers, the rest
  in doubles) and multiply their weighted centred rows as matrices; the products, one for each task, are folded
  ``FOLD`` at a time in task order, so the driver receives one matrix of the vectors' width squared, whatever the input.
  Its eigenvectors are found there.
* **Whiten.** Each distinct vector once, in Arrow batches. A second fold over the whitened vectors, centred again, checks
  their covariance against the identity.
* **Join back** by :func:`~codescope.llm.common.join_copies`: vectors of very many rows by a bounded broadcast, the others by a shuffle.

Defined results: null and empty vectors, and vectors with null or non-finite entries, are left out (an empty one has no
component); so are those with an entry whose ``x`` does not fit 62 bits. Vectors of another width are a fit of their own. A component
whose eigenvalue is no more than ``FLAT`` of the largest has no direction of its own: its ``whitened`` is null and
it does not count in the identity check. ``deviation`` is null where it does not fit a long. Repeated rows and ids
give a row each; a missing id stays missing. An empty table gives an empty frame; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import join_copies, map_batches, materialise, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
FOLD = 16
FLAT = 1e-12
STEP = 4096  # rows multiplied at a time

SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, x, d`` of the usable rows of ``vec_id, embedding``."""
    c = F.transform("embedding", lambda e: e.cast("double") * F.lit(float(SCALE)))
    rows = rows.select("vec_id", c.alias("c")).where(
        (F.size("c") > 0) & F.forall("c", lambda e: F.coalesce(F.abs(e) < F.lit(float(1 << 62)), F.lit(False))))  # NaN is the largest
    return rows.select("vec_id", F.transform("c", lambda e: F.floor(e) + OFFSET).alias("x"), F.size("c").alias("d"))


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The weight ``n`` and the weighted sums per dimension of ``x, w``, exact."""
    per = vectors.select(F.posexplode("x").alias("i", "v"), "w").groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)") * F.col("w").cast("decimal(18,0)")).cast("decimal(38,0)").alias("s"), F.sum("w").alias("n"))
    found = sorted(per.collect(), key=lambda r: r.i)  # a row for each dimension
    return int(found[0].n), [int(r.s) for r in found]


def centre(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``x - s / n`` in doubles, the whole part taken off in whole numbers."""
    return (x - np.array([v // n for v in s])).astype(float) - np.array([(v % n) / n for v in s])


def folded(vectors: DataFrame, rows_of, width: int) -> np.ndarray:
    """The sum over all rows of ``w * row * row'``, where ``rows_of(batch)`` are the centred rows of ``vectors`` (..., w last)."""

    def product(batches):
        total = np.zeros((width, width))
        for b in batches:
            for k in range(0, b.num_rows, STEP):
                part = b.slice(k, STEP)
                rows = rows_of(part)
                total += rows.T @ (rows * part.column(part.num_columns - 1).to_numpy()[:, None])
        yield {"m": [total.ravel()]}

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"part": t.column("group")[:1], "m": _added(t)})

    part = F.shiftright(F.monotonically_increasing_id(), 33).alias("part")  # the task
    found = materialise(map_batches(vectors, product, "m array<double>").select(part, "m"), "products")
    while found.count() > 1:
        found = materialise(found.withColumn("group", F.floor(F.col("part") / FOLD)).groupBy("group").applyInArrow(
            add, "part bigint, m array<double>"), "products")
    return np.array(found.first().m).reshape(width, width)


def _added(t: pa.Table) -> pa.Array:
    """The sum of at most ``FOLD`` products, in the order of their parts."""
    rows = _matrix(t.sort_by("part").column("m"))
    total = rows[0].copy()
    for r in rows[1:]:
        total += r
    return pa.array([total], pa.list_(pa.float64()))


def deviations(x: np.ndarray, n: int, s: list[int]) -> list:
    """Sum over dimensions of ``(n * x - s) ** 2`` for each row, exact; None where it exceeds a long."""
    far = max(abs(int(x.min()) * n - max(s)), abs(int(x.max()) * n - min(s))) if x.size else 0
    if far * far * x.shape[1] < 1 << 63:
        d = x * n - np.array(s)
        return (d * d).sum(1).tolist()
    d = x.astype(object) * n - np.array(s, dtype=object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(1)]


def fit(vectors: DataFrame, components: int):
    """``n, s``, eigenvalues and unit eigenvectors by falling eigenvalue, and the shares of the trace."""
    n, s = sums(vectors)
    width = len(s)
    cov = folded(vectors.select("x", "w"), lambda b: centre(_matrix(b.column(0)), n, s), width) / n
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(cov))
    return n, s, np.maximum(values[order], 0.0), axes[:, order], [float(v) / trace if trace > 0 else 0.0 for v in values[order]]


def whitened(vectors: DataFrame, n: int, s: list[int], values: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``x, copies, w, deviation, z``: every distinct vector projected on the components, over the roots of their eigenvalues."""
    flat = values <= FLAT * values[0] if values[0] > 0 else np.ones(len(values), bool)
    scaled = axes / np.sqrt(np.where(flat, 1.0, values))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, STEP):
                part = b.slice(k, STEP)
                x = _matrix(part.column(0))
                z = centre(x, n, s) @ scaled
                yield {"x": part.column(0), "copies": part.column(1), "w": part.column(2), "deviation": deviations(x, n, s),
                       "z": pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(
                           np.where(flat, np.nan, z).ravel(), from_pandas=True))}

    return map_batches(vectors.select("x", "copies", "w"), run,
                       "x array<bigint>, copies bigint, w bigint, deviation bigint, z array<double>")


def identity_error(found: DataFrame, n: int, live: list[int]) -> float:
    """Largest absolute entry of the covariance of the whitened vectors, centred again, minus the identity."""
    if not live:
        return 0.0
    means = found.agg(*[F.sum(F.col("z")[j] * F.col("w")).alias(f"m{j}") for j in live]).first()
    mean = np.array([m / n for m in means])
    cov = folded(found.select("z", "w"), lambda b: _matrix(b.column(0))[:, live] - mean, len(live)) / n
    return float(np.abs(cov - np.eye(len(live))).max())


def whiten(rows: DataFrame, weight: str = "one", components: int = COMPONENTS) -> DataFrame:
    """One row of ``SCHEMA`` for each usable row of ``rows`` (``vec_id, embedding``) and component.

    ``weight``: ``"one"`` fits over distinct vectors, ``"count"`` over all rows (a vector weighs its multiplicity).
    """
    spark = rows.sparkSession
    whole = materialise(whole_vectors(rows), "whole")
    out = spark.createDataFrame([], SCHEMA)
    for width in sorted(r.d for r in whole.select("d").distinct().collect()):  # a table has one width, as a rule
        own = whole.where(F.col("d") == width).select("vec_id", "x")
        distinct = materialise(own.groupBy("x").agg(F.count("*").alias("copies")), "distinct")
        vectors = distinct.select("x", "copies", (F.col("copies") if weight == "count" else F.lit(1).cast("bigint")).alias("w"))
        n, s, values, axes, shares = fit(vectors, components)
        found = materialise(whitened(vectors, n, s, values, axes), "whitened")
        live = [j for j, v in enumerate(values) if v > FLAT * values[0]]
        error = identity_error(found, n, live)
        total = whole.where(F.col("d") == width).count()
        joined = join_copies(own, found, "x", total)
        out = out.unionByName(joined.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
            F.element_at(F.array(*[F.lit(v) for v in shares]), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")))
    return out


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every usable embedding, fitted over the distinct vectors."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
