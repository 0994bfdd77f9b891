"""M4 neighbour graph: the nearest vectors of every vector, exactly or by neighbour descent.

* :func:`nearest` compares all pairs within a group (experiment): the group is dealt to blocks, a task has two of them and
  returns at most ``k`` neighbours of each row; lists of a row meet in a bounded top-k. Its work is the square of the group.
* :func:`descend` is for large sets, whose work is about linear. Seeded random trees deal the rows to leaves of at most about
  ``LEAF`` rows; a leaf is one group of rows, compared whole, so a vector travels once for each tree and every row starts with its
  nearest rows of ``TREES`` leaves. In each round the rows around a row (its list, and the best that list it) are compared with each
  other, where one of the two is new, and each list keeps the nearest; rows with nothing new around them ship nothing. Lists are cut
  in each task before the shuffle, so a row that very many others list sends few entries from a task. Vectors whose numbers are all
  exact in single precision travel so; distances are computed in double precision from them.

Distances are Euclidean, in double precision, from differences. Ties go to the smaller id; copies of a vector are neighbours at
distance 0. Ids are unique; rows without a group, id or vector are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescope.operators.keyed import in_blocks, matrix
from codescope.sources.scratch import materialise

K = 15
BLOCK = 1024
#: Neighbour descent: random trees to start from, rows of a leaf, rows that the trees' cuts are taken from, and rounds.
TREES, LEAF, FIT, ROUNDS = 16, 8192, 16_384, 8
#: Entries that a list holds during the descent, for each one wanted.
ROOM = 2
#: A round that changes a smaller share of the entries wanted is the last.
SETTLED = 0.002


def nearest(points: DataFrame, group: str = "experiment_id", id_col: str = "solution_id", vec_col: str = "vector", k: int = K) -> DataFrame:
    """``group, id, neighbour, rank, distance``: the ``min(k, n - 1)`` nearest rows of each row's group, exact."""
    rows, _ = in_blocks(points, group, id_col, vec_col, BLOCK)
    kinds = dict(rows.dtypes)
    last = rows.groupBy("group").agg(F.max("block").alias("last"))
    rows = rows.join(last, "group")
    low = rows.select("group", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), F.lit(0).alias("side"), "id", "vector")
    high = rows.where("block > 0").select("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block") - 1)).alias("i"),
                                          F.col("block").alias("j"), F.lit(1).alias("side"), "id", "vector")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("id", "ascending")])
        ids, v = t.column("id").combine_chunks(), matrix(t.column("vector"))
        cut, n = int((t.column("side").to_numpy() == 0).sum()), t.num_rows
        same = cut == n
        out = []
        for a, b in ((slice(0, cut), slice(0, n) if same else slice(cut, n)),) + (() if same else ((slice(cut, n), slice(0, cut)),)):
            for x in range(a.start, a.stop):
                d = ((v[b] - v[x]) ** 2).sum(1)
                if same:
                    d[x] = np.inf
                top = np.argsort(d, kind="stable")[:k]
                top = top[d[top] < np.inf]
                out.append((np.full(len(top), x), b.start + top, np.sqrt(d[top])))
        x, y, d = (np.concatenate(c) for c in zip(*out))
        return pa.table({"group": t.column("group").take(pa.array(np.zeros(len(x), np.int64))), "id": ids.take(pa.array(x)),
                         "neighbour": ids.take(pa.array(y)), "distance": d})

    found = low.unionByName(high).groupBy("group", "i", "j").applyInArrow(
        run, f"group {kinds['group']}, id {kinds['id']}, neighbour {kinds['id']}, distance double")
    order = Window.partitionBy("group", "id").orderBy("distance", "neighbour")  # k entries from each block
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("group").alias(group), F.col("id").alias(id_col), "neighbour", "rank", "distance")


# ------------------------------------------------------------------ neighbour descent
LISTS = "id bigint, neighbour bigint, distance double, fresh boolean"
PLACED = f"{LISTS}, place int"


def _run(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` where ``fn(batches)`` yields tuples of columns."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return df.mapInArrow(run, T._parse_datatype_string(schema))


def _whole_keys(batches) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by the first column, cut where it changes."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        k = int(np.searchsorted(key, key[-1]))
        if k == 0 and rest and rest[-1].column(0)[0].as_py() == key[0]:
            rest.append(b)
            continue
        whole = pa.concat_batches([*rest, b.slice(0, k)])
        if whole.num_rows:
            yield whole
        rest = [b.slice(k)]
    if rest:
        yield pa.concat_batches(rest)


def _shortest(ids, nbrs, d, fresh, k: int):
    """The ``k`` nearest entries of each id; an entry that comes twice is not new."""
    order = np.lexsort((fresh, nbrs, ids))
    ids, nbrs, d, fresh = (x[order] for x in (ids, nbrs, d, fresh))
    once = np.ones(len(ids), bool)
    once[1:] = (ids[1:] != ids[:-1]) | (nbrs[1:] != nbrs[:-1])
    ids, nbrs, d, fresh = (x[once] for x in (ids, nbrs, d, fresh))
    order = np.lexsort((nbrs, d, ids))
    ids, nbrs, d, fresh = (x[order] for x in (ids, nbrs, d, fresh))
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    keep = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids)))) < k
    return ids[keep], nbrs[keep], d[keep], fresh[keep]


def _cut(entries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest entries of each id with their places from 0: first in each batch, then over all."""

    def of(b):
        return [c.to_numpy(zero_copy_only=False) for c in b.columns]

    def placed(batches):
        for b in _whole_keys(batches):
            ids, nbrs, d, fresh = _shortest(*of(b), k)
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            yield ids, nbrs, d, fresh, (np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))).astype(np.int32)

    own = _run(entries, lambda batches: (_shortest(*of(b), k) for b in batches), LISTS)
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartition(parts, "id").sortWithinPartitions("id")
    return _run(dealt, placed, PLACED)


def _along(v: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Places along an axis, to the last bit the same for copies in whatever batch (those of a matrix product are not)."""
    return (v * axis).sum(1)


def _codes(v: np.ndarray, ids: np.ndarray, axes: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The leaf of each row in one tree: a cut for each node of a level; rows on a cut go by a bit of their id, so copies spread."""
    code = np.zeros(len(v), np.int64)
    for level, cut in enumerate(cuts):
        x, at = _along(v, axes[level]), cut[code]
        code = 2 * code + ((x > at) | ((x == at) & (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63 - level) & np.uint64(1) > 0)))
    return code


def _trees(rows: DataFrame, n: int, width: int, seed: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """``(axes, cuts)`` of each tree; a node is cut at the median of its rows among ``FIT`` rows, a fixed number, by a hash of their ids."""
    depth = max(0, int(np.ceil(np.log2(n / LEAF))))
    if not depth:
        return [(np.zeros((0, width)), [])]  # one leaf holds all rows
    some = rows.orderBy(F.xxhash64("id")).limit(FIT).collect()
    ids, v = np.array([r.id for r in some]), np.array([r.vector for r in some], float)
    out = []
    for axes in np.random.default_rng(seed).standard_normal((TREES, depth, width)):
        cuts = []
        for level in range(depth):
            code, x = _codes(v, ids, axes[:level], cuts), _along(v, axes[level])
            order = np.lexsort((x, code))
            ends = np.searchsorted(code[order], np.arange(2 ** level + 1))
            middle = np.minimum((ends[:-1] + ends[1:]) // 2, len(x) - 1)
            cuts.append(np.where(np.diff(ends) > 0, x[order][middle], 0.0))
        out.append((axes, cuts))
    return out


def _nearest_in(ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple]:
    """Entries of the ``k`` nearest rows of each row of a leaf, whose rows are in the order of ids; ties go to the smaller id.

    A few more than ``k`` are chosen by a matrix product about the leaf's mean and then compared by differences.
    """
    n, sound = len(ids), np.isfinite(v).all(1)
    about = v - (v[sound].mean(0) if sound.any() else 0)
    square = (about * about).sum(1)
    blur = 1e-12 * max(square[sound].max(initial=0), 1e-300)
    most = min((k + 8) * np.unique(ids, return_counts=True)[1].max(), n - 1)  # rows that repeat an id are one neighbour
    for lo in range(0, n if most else 0, 512):
        m = about[lo:lo + 512]
        near = square - 2 * (m @ about.T)
        near[np.isnan(near)] = np.inf
        own = np.arange(len(m))
        near[own, lo + own] = np.inf
        last = np.partition(near, most - 1, axis=1)[:, most - 1:most]
        nearer = near < last - blur
        tied = (near <= last + blur) & ~nearer
        x, y = np.nonzero(nearer | tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= most - nearer.sum(1, keepdims=True)))
        x, y = lo + x[x + lo != y], y[x + lo != y]
        yield _shortest(ids[x], ids[y], np.sqrt(((v[x] - v[y]) ** 2).sum(1)), np.ones(len(x), bool), k)


def _starts(rows: DataFrame, n: int, width: int, k: int, seed: int) -> DataFrame:
    """Entries between rows that share a leaf of a random tree: the ``k`` nearest of each row and leaf."""
    trees = _trees(rows, n, width, seed)

    def deal(batches):
        for b in batches:
            ids, v = b.column(0).to_numpy(), matrix(pa.chunked_array([b.column(1)])).astype(float)
            for t, (axes, cuts) in enumerate(trees):
                yield _codes(v, ids, axes, cuts) * len(trees) + t, b.column(0), b.column(1)

    def close(batches):
        for b in _whole_keys(batches):
            leaf, ids, v = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(pa.chunked_array([b.column(2)])).astype(float)
            first = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
            for lo, hi in zip(first, np.append(first[1:], len(leaf))):
                for part in np.array_split(np.arange(lo, hi), -(-(hi - lo) // (2 * LEAF))):  # a leaf is twice the size only by chance
                    yield from _nearest_in(ids[part], v[part], k)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _run(rows, deal, f"leaf bigint, id bigint, vector {dict(rows.dtypes)['vector']}").repartition(parts, "leaf")
    return _run(dealt.sortWithinPartitions("leaf", "id"), close, LISTS)


def _around(graph: DataFrame, k: int) -> DataFrame:
    """``id, neighbour, fresh``: the rows of each list and the ``k`` nearest that list its row, where any is new."""
    both = graph.select("id", "neighbour", "distance", "fresh", F.lit(False).alias("back")).unionByName(graph.select(
        F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), "distance", "fresh", F.lit(True).alias("back")))

    def of(b):
        return [c.to_numpy(zero_copy_only=False) for c in b.columns]

    def nearest_back(batches):
        """A task's nearest of each row, as a row may be listed by very many."""
        for b in batches:
            *entries, back = of(b)
            for some, of_back in ((tuple(x[~back] for x in entries), False), (_shortest(*(x[back] for x in entries), k), True)):
                yield *some, np.full(len(some[0]), of_back)

    def run(batches):
        for b in _whole_keys(batches):
            *entries, back = of(b)
            ids, nbrs, _, fresh = (np.concatenate(x) for x in zip([x[~back] for x in entries], _shortest(*(x[back] for x in entries), k)))
            order = np.lexsort((~fresh, nbrs, ids))  # a row on both sides is new if either says so
            ids, nbrs, fresh = ids[order], nbrs[order], fresh[order]
            once = np.concatenate([[True], (ids[1:] != ids[:-1]) | (nbrs[1:] != nbrs[:-1])])
            ids, nbrs, fresh = ids[once], nbrs[once], fresh[once]
            live = np.isin(ids, ids[fresh])
            yield ids[live], nbrs[live], fresh[live]

    schema = f"{LISTS}, back boolean"
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _run(both, nearest_back, schema).repartition(parts, "id").sortWithinPartitions("id")
    return _run(dealt, run, "id bigint, neighbour bigint, fresh boolean")


def _compared(graph: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """New entries between rows around a row, where they would enter a list of ``k``."""
    worst = graph.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("worst"))
    info = rows.join(worst, "id", "left").select(F.col("id").alias("neighbour"), "vector", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))

    def run(batches):
        for b in _whole_keys(batches):
            at, ids, fresh, worst = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            v = matrix(pa.chunked_array([b.column(3)])).astype(float)
            square, out = (v * v).sum(1), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            for lo, hi in zip(start, np.append(start[1:], len(at))):
                new = fresh[lo:hi]
                m = v[lo:hi]
                near = square[lo:hi, None] + square[lo:hi] - 2 * (m @ m.T) <= (worst[lo:hi, None] * (1 + 1e-9)) ** 2
                x, y = np.nonzero(near & (new[:, None] | new) & ~np.eye(hi - lo, dtype=bool))
                d = np.sqrt(((m[x] - m[y]) ** 2).sum(1))
                keep = d < worst[lo + x]
                out.append((ids[lo + x[keep]], ids[lo + y[keep]], d[keep]))
            x, y, d = (np.concatenate(c) for c in zip(*out))
            yield _shortest(x, y, d, np.ones(len(x), bool), k)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _around(graph, k).join(info, "neighbour").select("id", "neighbour", "fresh", "vector", "worst")
    return _run(met.repartition(parts, "id").sortWithinPartitions("id"), run, LISTS)


def descend(points: DataFrame, id_col: str = "solution_id", vec_col: str = "vector", k: int = K, seed: int = 42, room: int = ROOM) -> DataFrame:
    """``id, neighbour, rank, distance``: about the ``min(k, n - 1)`` nearest rows of each row, by neighbour descent.

    Ids are whole numbers. Its share of true neighbours is not exact; measure it with :func:`recall`.
    """
    rows = materialise(points.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vector")).dropna(), "rows")
    one, n = rows.first(), rows.count()
    if one is None:
        return rows.select(F.col("id").alias(id_col), F.col("id").alias("neighbour"), F.lit(0).alias("rank"), F.lit(0.0).alias("distance"))
    if not rows.where(F.exists("vector", lambda x: x.cast("float").cast("double") != x)).limit(1).count():
        rows = rows.withColumn("vector", F.col("vector").cast("array<float>"))
    wide = k * room
    graph = materialise(_cut(_starts(rows, n, len(one.vector), k, seed), wide), "lists")
    for _ in range(ROUNDS if n > LEAF else 0):  # a single leaf has compared all rows
        old = graph.select("id", "neighbour", "distance", F.lit(False).alias("fresh"))
        graph = materialise(_cut(old.unionByName(_compared(graph, rows, wide)), wide), "lists")
        of, new = graph.where(F.col("place") < k).agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if new <= SETTLED * of:
            break
    return graph.where(F.col("place") < k).select(F.col("id").alias(id_col), "neighbour", (F.col("place") + 1).alias("rank"), "distance")


def recall(points: DataFrame, found: DataFrame, id_col: str = "solution_id", vec_col: str = "vector", k: int = K, asked: int = 200) -> float:
    """The share of the true ``k`` nearest of ``asked`` rows (a fixed number, by a hash) that ``found`` has."""
    rows = points.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vector")).dropna()
    some = rows.orderBy(F.xxhash64("id")).limit(asked).collect()
    who, q = np.array([r.id for r in some], np.int64), np.array([r.vector for r in some])

    def run(batches):
        for b in batches:
            ids, v = b.column(0).to_numpy(), matrix(pa.chunked_array([b.column(1)]))
            out = []
            for a, x in zip(who, q):
                d = np.sqrt(((v - x) ** 2).sum(1))
                d[ids == a] = np.inf
                top = np.lexsort((ids, d))[:k]
                top = top[d[top] < np.inf]
                out.append((np.full(len(top), a), ids[top], d[top]))
            x, y, d = (np.concatenate(c) for c in zip(*out))
            yield x, y, d, np.zeros(len(x), bool)

    true = _cut(_run(rows, run, LISTS), k)
    hit = true.join(found.select(F.col(id_col).cast("bigint").alias("id"), "neighbour"), ["id", "neighbour"], "left_semi").count()
    return hit / max(true.count(), 1)
