"""Scores of given pairs of solutions, where each solution's payload travels about once and not once a pair.

Pairs of a group (prompt) are dealt to cells: of a pair, the solution with more pairs is its hub (ties: the smaller id). Hubs
and the others of a group are dealt to blocks of about ``BLOCK`` by a hash, and a cell is one block of each. A
cell gets the payload of its solutions once, so with few hubs a payload goes to one cell, however large the group, and a task
holds no more than the payloads of two blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescope.sources.scratch import materialise

BLOCK = 64


def cells(pairs: DataFrame, group: str = "prompt_id", block: int = BLOCK, written: bool = True) -> DataFrame:
    """``cell, solution_a, solution_b, k``: the distinct pairs with their number of rows; written, or a plan that runs no job. Without the group column all are one group."""
    keep = materialise if written else lambda df, _: df
    own = F.min(group) if group in pairs.columns else F.lit(0)
    links = pairs.where("solution_a IS NOT NULL AND solution_b IS NOT NULL").groupBy("solution_a", "solution_b").agg(
        F.count(F.lit(1)).alias("k"), own.alias("g"))
    links = keep(links, "links")
    degrees = links.select("g", F.explode(F.array("solution_a", "solution_b")).alias("s")).groupBy("g", "s").agg(F.count(F.lit(1)).alias("d"))
    met = links
    for side in ("a", "b"):
        d = degrees.select(F.col("g").alias("_g"), F.col("s").alias("_s"), F.col("d").alias(f"d_{side}")).hint("merge")
        met = met.join(d, F.col("g").eqNullSafe(F.col("_g")) & (F.col(f"solution_{side}") == F.col("_s"))).drop("_g", "_s")
    is_a = (F.col("d_a") > F.col("d_b")) | ((F.col("d_a") == F.col("d_b")) & (F.col("solution_a") < F.col("solution_b")))
    met = keep(met.select("g", "solution_a", "solution_b", "k", F.when(is_a, F.col("solution_a")).otherwise(F.col("solution_b")).alias("hub"),
                                 F.when(is_a, F.col("solution_b")).otherwise(F.col("solution_a")).alias("other")), "met")
    # sketches: the numbers of blocks only balance the work
    sizes = met.groupBy(F.col("g").alias("_g")).agg(*[
        F.ceil(F.approx_count_distinct(c) / block).alias(f"n_{c}") for c in ("hub", "other")])
    at = [F.pmod(F.xxhash64(F.lit(c), F.col(c)), F.col(f"n_{c}")) for c in ("hub", "other")]
    return keep(met.join(sizes, F.col("g").eqNullSafe(F.col("_g"))).select(
        F.xxhash64("g", *at).alias("cell"), "solution_a", "solution_b", "k"), "cells")


def scored(dealt: DataFrame, payload: DataFrame, kind: str, fn, schema: str) -> DataFrame:
    """``fn(members, pairs)`` for every cell of :func:`cells`, as tuples of columns of ``schema``.

    ``payload`` is ``solution_id`` and the column ``kind``. ``members`` are Arrow arrays of ids and payloads: each solution of
    the cell once (null without a payload), and more often where its id repeats; ``pairs`` are arrays ``a, b, k``.
    """
    out = T._parse_datatype_string(schema)
    names = out.names
    members = dealt.select("cell", F.explode(F.array("solution_a", "solution_b")).alias("s")).distinct()
    # the merge join: what a parse returns is larger than its input's size lets a planner expect
    held = members.join(payload.select(F.col("solution_id").alias("s"), kind).hint("merge"), "s", "left")
    none, id_type = F.lit(None), dict(dealt.dtypes)["solution_b"]
    rows = held.select("cell", "s", F.col(kind).alias("payload"), none.cast(id_type).alias("b"), none.cast("bigint").alias("k")).unionByName(
        dealt.select("cell", F.col("solution_a").alias("s"), none.cast(dict(payload.dtypes)[kind]).alias("payload"), F.col("solution_b").alias("b"), "k"))

    def run(t: pa.Table) -> pa.Table:
        is_pair = t.column("b").is_valid().to_numpy()
        own, pair = (pa.array(np.flatnonzero(x)) for x in (~is_pair, is_pair))
        s = t.column("s")
        found = fn((s.take(own), t.column("payload").take(own)), tuple(t.column(c).take(pair).to_numpy() for c in ("s", "b", "k")))
        return pa.table(dict(zip(names, found)))

    # a cell is two blocks at most
    return rows.groupBy("cell").applyInArrow(run, out)


def _entries(docs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Counts as rows: document, number of the key, count; where each document's begin; and how many keys there are."""
    known: dict = {}
    keys = np.fromiter((known.setdefault(w, len(known)) for d in docs for w in d), np.int64)
    n = np.fromiter((c for d in docs for c in d.values()), np.int64)
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    return np.repeat(np.arange(len(docs)), np.diff(first)), keys, n, first, len(known)


def combined(docs: list[dict], x: np.ndarray, y: np.ndarray, op) -> np.ndarray:
    """For documents ``x[i]`` and ``y[i]`` the sum of ``op`` (0 where one count is) over their shared keys, exact."""
    doc, keys, n, first, width = _entries(docs)
    out = np.zeros(len(x), np.int64)
    dense = np.zeros(width, np.int64)
    # the side with fewer documents leads: each is spread out once
    if len(np.unique(y)) < len(np.unique(x)):
        x, y = y, x
    order = np.argsort(x, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(x[order]) != 0])) if len(x) else []
    for lo, hi in zip(starts, np.append(starts[1:], len(x)) if len(x) else []):
        at = order[lo:hi]
        own = slice(first[x[at[0]]], first[x[at[0]] + 1])
        dense[keys[own]] = n[own]
        if 4 * len(at) >= len(docs):
            sums = np.concatenate([[0], np.cumsum(op(dense[keys], n))])
            out[at] = sums[first[y[at] + 1]] - sums[first[y[at]]]
        else:
            for i in at:
                other = slice(first[y[i]], first[y[i] + 1])
                out[i] = op(dense[keys[other]], n[other]).sum()
        dense[keys[own]] = 0
    return out


# ------------------------------------------------------------------ pairs that are dealt where they are made
#: What a row of a task is. Of a cell the solutions' payloads come first, then its pairs.
TEXT, TYPES, VECTOR, PAIR = range(4)


def in_cells(pairs: DataFrame, members: dict[int, DataFrame], fn, schema: str) -> DataFrame:
    """``pairs`` without their ``cell`` and with the columns of ``schema``, which ``fn`` scores, many cells at a time.

    ``pairs``: ``cell, solution_a, solution_b`` and any other columns; ``members``: for a kind of payload its rows ``cells,
    solution_id`` and payload columns, where ``cells`` are those whose pairs name the solution. Both meet in one shuffle and no pair
    is joined: ``fn(keys, kinds, payloads, x, y)`` gets the keys of the payloads' solutions, which repeat where an id does, the payloads by column, and
    the keys of the pairs' sides, and returns numbers of pairs, ascending, with their columns of ``schema``. A task holds some Arrow batches
    and a cell at a time.
    """
    spark = pairs.sparkSession
    kinds = dict(pairs.dtypes)
    rest = [c for c in pairs.columns if c not in ("cell", "solution_a", "solution_b")]
    payload = {c: t for df in members.values() for c, t in df.dtypes if c not in ("cells", "solution_id")}
    # lists are empty, not null: over a run of nulls Spark's Arrow writer takes a time that grows with the square of it
    none = {c: (F.array() if t.startswith("array") else F.lit(None)).cast(t).alias(c) for c, t in {**payload, **{c: kinds[c] for c in rest}, "b": kinds["solution_b"]}.items()}
    rows = pairs.select("cell", F.lit(PAIR).cast("tinyint").alias("kind"), F.col("solution_a").alias("s"), F.col("solution_b").alias("b"),
                        *[none[c] for c in payload], *rest)
    for kind, df in members.items():
        own = df.where("solution_id IS NOT NULL").select(F.explode("cells").alias("cell"), F.lit(kind).cast("tinyint").alias("kind"),
                                                         F.col("solution_id").cast(kinds["solution_a"]).alias("s"), *[c for c in payload if c in df.columns])
        rows = rows.unionByName(own.select("cell", "kind", "s", none["b"], *[c if c in own.columns else none[c] for c in payload], *[none[c] for c in rest]))
    # given as a number: a task's share is not to be coalesced, for small shuffled bytes may be many rows
    rows = rows.repartition(shares(spark), "cell").sortWithinPartitions("cell", "kind")
    # nondeterministic, so that nothing is filtered before it and the order stays
    scores = F.arrow_udf(_per_row(fn, tuple(payload), schema), f"array<struct<{schema}>>").asNondeterministic()
    met = rows.withColumn("_scores", scores("cell", "kind", "s", "b", *payload))
    return met.select(F.col("s").alias("solution_a"), F.col("b").alias("solution_b"), *rest, F.explode("_scores").alias("_score")).select(
        "solution_b", "solution_a", *rest, "_score.*")


def shares(spark) -> int:
    """Partitions for rows whose number is not known without a job."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _per_row(fn, payload: tuple[str, ...], schema: str):
    """The Arrow function of :func:`in_cells`: for every row the list of its scores, empty for payloads."""
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for cell, kind, s, b, *columns in _whole_cells(batches):
            kind = kind.to_numpy()
            n_pairs = np.zeros(len(kind), np.int64)
            is_pair = kind == PAIR
            own, pair = np.flatnonzero(~is_pair), np.flatnonzero(is_pair)
            cells = np.cumsum(np.concatenate([[0], np.diff(cell.to_numpy()) != 0]))
            ids = pa.chunked_array([s, b.take(pa.array(pair))]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            width = int(ids.max()) + 1
            keys = cells * width + ids[:len(kind)]
            y = cells[pair] * width + ids[len(kind):]
            i, found = fn(keys[own], kind[own], {c: a.take(pa.array(own)) for c, a in zip(payload, columns)}, keys[pair], y)
            n_pairs[pair] = np.bincount(i, minlength=len(pair))
            items = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in found], names=names)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_pairs)]), pa.int32()), items)

    return run


def _whole_cells(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[list[pa.Array]]:
    """Rows sorted by the first column, cut where it changes, about a batch at a time."""
    held: list[list[pa.Array]] = []  # of the last cell
    for batch in batches:
        if not len(batch[0]):
            continue
        cell = batch[0].to_numpy()
        cut = int(np.argmax(cell == cell[-1]))
        if cut == 0 and held and held[0][0][0].as_py() == cell[0]:
            held.append(list(batch))
            continue
        done = [*held, [c.slice(0, cut) for c in batch]]
        if sum(len(d[0]) for d in done):
            yield [pa.concat_arrays(c) for c in zip(*done)]
        held = [[c.slice(cut) for c in batch]]
    if held:
        yield [pa.concat_arrays(c) for c in zip(*held)]


def each_with(i: np.ndarray, x: np.ndarray, y: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i`` (numbers of pairs with keys ``x`` and ``y``) once for all places in ``keys`` of both sides, and these places.

    A side that is not there has the place after the last.
    """
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    places = np.append(order, len(keys))
    first, n = [], []
    for side in (x[i], y[i]):
        lo = np.searchsorted(ordered, side)
        own = np.searchsorted(ordered, side, "right") - lo
        first.append(np.where(own > 0, lo, len(keys)))
        n.append(np.maximum(own, 1))
    times = n[0] * n[1]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    u = np.repeat(first[0], times) + within // np.repeat(n[1], times)
    v = np.repeat(first[1], times) + within % np.repeat(n[1], times)
    return np.repeat(i, times), places[u], places[v]


#: Numbers of an array that a step of the sums below makes.
STEP = 1 << 20


def shared_counts(doc: np.ndarray, key: np.ndarray, n_docs: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents ``x[i]`` and ``y[i]`` the sum of the smaller counts of their shared keys, and every document's size.

    ``doc`` and ``key`` name the document and key of every occurrence. The document with fewer keys is looked up in the other.
    """
    width = int(key.max()) + 1 if len(key) else 1
    entries, n = np.unique(doc * width + key, return_counts=True)
    first = np.searchsorted(entries, np.arange(n_docs + 1) * width)
    length = np.diff(first)
    lead = np.where(length[x] <= length[y], x, y)
    other = np.where(length[x] <= length[y], y, x)
    out = np.zeros(len(x), np.int64)
    for at in _steps(length[lead]):
        size = length[lead[at]]
        begin = np.cumsum(size) - size
        e = np.repeat(first[lead[at]] - begin, size) + np.arange(size.sum())
        wanted = entries[e] % width + np.repeat(other[at] * width, size)
        there = np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)
        both = np.where(entries[there] == wanted, np.minimum(n[e], n[there]), 0) if len(e) else e
        sums = np.concatenate([[0], np.cumsum(both)])
        out[at] = sums[begin + size] - sums[begin]
    return out, np.bincount(doc, minlength=n_docs)


def products(doc: np.ndarray, key: np.ndarray, n: np.ndarray, n_docs: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents ``x[i]`` and ``y[i]`` the sum of the products of their counts ``n`` of few kinds of keys, exact, and every document's square."""
    width = int(key.max()) + 1 if len(key) else 1
    counts = np.zeros((n_docs, width), np.int64)
    counts[doc, key] = n
    out = np.zeros(len(x), np.int64)
    for at in _steps(np.full(len(x), width)):
        out[at] = np.einsum("ij,ij->i", counts[x[at]], counts[y[at]])
    return out, np.einsum("ij,ij->i", counts, counts)


def _steps(sizes: np.ndarray) -> Iterator[slice]:
    """Slices whose sizes sum up to about ``STEP``, or of one."""
    upto = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + STEP, "right")))
        yield slice(lo, hi)
        lo = hi
