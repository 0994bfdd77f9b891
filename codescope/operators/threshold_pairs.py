"""J3 above a threshold: every pair of solutions of a prompt whose cosine reaches ``t``, exactly.

Solutions of a prompt with one histogram are one class with a count, so copies are never expanded: a result row stands for
``n_links`` pairs of solutions. Classes meet through an index of prefixes:

* dimensions are ordered by frequency, rare ones first, alike for all classes;
* a class is indexed under its first dimensions, until what is left has a norm below ``t``. If two classes share no
  indexed dimension, their product lies in the remainder of the one whose index ends first, and is below ``t``;
* the product over shared indexed dimensions plus the larger remainder bounds the cosine from above. Only
  pairs whose bound reaches ``t`` meet their whole histograms, for the exact cosine.

All joins are equi joins on the prompt and a dimension or class; nothing is expanded per prompt, and a dimension that all
classes of a prompt share comes last and is indexed only where a class has little else.

A prompt whose classes times entries are at most ``SMALL`` needs no index: its classes travel once, to one task, where all of
them meet as a small matrix. So entries become rows only in large prompts, and the work of a small one is bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codescope.functions.text import normalize_code
from codescope.sources.scratch import materialise

#: Slack for rounding in bounds; the final test is on the cosine itself.
SLACK = 1e-9
#: Cells (classes times entries) of a prompt that a task compares whole, as a matrix of no more numbers.
SMALL = 1 << 20


def histogram_classes(rows: DataFrame, group: str = "prompt_id", id_col: str = "solution_id") -> DataFrame:
    """``group, class_id, n, entries`` of ``rows`` (group, id, ``entries`` array<struct<dim, w>>, no zero weights).

    The class id is the smallest solution id. Partial counts come before the shuffle, so a class that holds a third of all
    rows is a row for each task.
    """
    keyed = rows.select(group, id_col, F.array_sort("entries").alias("entries")).where("size(entries) > 0")
    return keyed.groupBy(group, "entries").agg(F.min(id_col).alias("class_id"), F.count(F.lit(1)).alias("n"))


def with_norm(classes: DataFrame) -> DataFrame:
    """``classes`` with ``norm``, written: once per class, before entries become rows."""
    square = F.aggregate("entries", F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"])
    return materialise(classes.withColumn("norm", F.sqrt(square)), "classes")


def _prefixes(classes: DataFrame, group: str, t: float) -> DataFrame:
    """``group, class_id, dim, u, rest``: the indexed dimensions with unit weights and the norm of what is not indexed."""
    long = classes.select(group, "class_id", "norm", F.explode("entries").alias("e")).select(
        group, "class_id", F.col("e.dim").alias("dim"), (F.col("e.w") / F.col("norm")).alias("u"))
    long = long.join(long.groupBy("dim").agg(F.count(F.lit(1)).alias("seen")), "dim")
    own = Window.partitionBy(group, "class_id")  # the dimensions of one class
    tail = F.sum(F.col("u") * F.col("u")).over(own.orderBy(F.desc("seen"), F.desc("dim")))
    held = long.withColumn("tail", tail).withColumn("kept", F.col("tail") >= t * t - SLACK)
    held = held.withColumn("rest", F.sqrt(F.coalesce(F.max(F.when(~F.col("kept"), F.col("tail"))).over(own), F.lit(0.0))))
    return held.where("kept").select(group, "class_id", "dim", "u", "rest")


def candidate_pairs(classes: DataFrame, t: float, group: str = "prompt_id") -> DataFrame:
    """``group, class_a, class_b`` (a < b): pairs of classes (:func:`with_norm`) that the index and the bound leave."""
    index = materialise(_prefixes(classes, group, t), "prefixes")
    a = index.select(group, "dim", F.col("class_id").alias("class_a"), F.col("u").alias("ua"), F.col("rest").alias("ra"))
    b = index.select(group, "dim", F.col("class_id").alias("class_b"), F.col("u").alias("ub"), F.col("rest").alias("rb"))
    met = a.join(b, [group, "dim"]).where("class_a < class_b")
    return (met.groupBy(group, "class_a", "class_b")
            .agg(F.sum(F.col("ua") * F.col("ub")).alias("dot"), F.max(F.greatest("ra", "rb")).alias("rest"))
            .where(F.col("dot") + F.col("rest") >= t - SLACK).select(group, "class_a", "class_b"))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the first column, cut where it changes, with some ``SMALL`` entries (in the last column) at a time."""
    rest, last, size = [], None, 0
    for b in batches:
        if not b.num_rows:
            continue
        of = _codes(b.column(0))
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        entries = np.concatenate([[0], np.cumsum(b.column(b.num_columns - 1).value_lengths().to_numpy())])
        at = 0
        for f in first:
            new = f > 0 or (last is not None and b.column(0)[0] != last)
            if new and size + entries[f] - entries[at] >= SMALL:
                yield pa.concat_batches([*rest, b.slice(at, f - at)])
                rest, size, at = [], 0, f
        rest.append(b.slice(at))
        size += entries[-1] - entries[at]
        last = b.column(0)[b.num_rows - 1]
    if rest:
        yield pa.concat_batches(rest)


def _codes(column: pa.Array) -> np.ndarray:
    """A whole number for each distinct value."""
    return column.dictionary_encode().indices.to_numpy()


def small_pairs(classes: DataFrame, t: float, group: str = "prompt_id") -> DataFrame:
    """``group, class_a, class_b, n_a, n_b, similarity`` (a < b) of ``classes`` (:func:`with_norm`) of small groups, each whole in a task."""
    kinds = dict(classes.dtypes)
    schema = f"{group} {kinds[group]}, class_a {kinds['class_id']}, class_b {kinds['class_id']}, n_a bigint, n_b bigint, similarity double"
    names = [group, "class_a", "class_b", "n_a", "n_b", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches):
            groups, ids, n, norm, entries = b.columns
            norm, sizes = norm.to_numpy(), entries.value_lengths().to_numpy()
            flat = entries.flatten()
            of = _codes(groups)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            ends = np.append(first[1:], len(of))
            row = np.repeat(np.arange(len(of)), sizes)
            dim, w = _codes(flat.field(0)).astype(np.int64), flat.field(1).to_numpy()
            # the dimensions of a group, numbered within it
            begins = np.searchsorted(first, row, "right") - 1
            held, place = np.unique(begins * (dim.max() + 1) + dim, return_inverse=True)
            owner = held // (dim.max() + 1)
            start = np.searchsorted(owner, np.arange(len(first) + 1))
            place = place - start[begins]
            cut = np.concatenate([[0], np.cumsum(sizes)])
            out = []
            for g in np.flatnonzero(ends - first > 1):
                lo, hi = first[g], ends[g]
                at = slice(cut[lo], cut[hi])
                m = np.zeros((hi - lo, start[g + 1] - start[g]))
                m[row[at] - lo, place[at]] = w[at]
                cos = np.fmin(1.0, (m @ m.T) / np.outer(norm[lo:hi], norm[lo:hi]))
                x, y = np.nonzero(np.triu(cos >= t, 1))
                out.append((lo + x, lo + y, cos[x, y]))
            if not out:
                continue
            x, y, cos = (np.concatenate(c) for c in zip(*out))
            x, y = pa.array(x), pa.array(y)
            yield pa.RecordBatch.from_arrays([groups.take(x), ids.take(x), ids.take(y), n.take(x), n.take(y), pa.array(cos)], names=names)

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.select(group, "class_id", "n", "norm", "entries").repartition(parts, group).sortWithinPartitions(group, "class_id")
    return dealt.mapInArrow(run, schema).where("class_a < class_b")


def indexed_pairs(classes: DataFrame, t: float, group: str = "prompt_id") -> DataFrame:
    """``group, class_a, class_b, n_a, n_b, similarity`` (a < b) of ``classes`` (:func:`with_norm`) of groups of any size, by the index."""
    pairs = materialise(candidate_pairs(classes, t, group), "candidates")
    long = classes.select(group, "class_id", "n", "norm", F.explode("entries").alias("e"))
    a = long.select(group, F.col("class_id").alias("class_a"), F.col("n").alias("n_a"), F.col("norm").alias("norm_a"),
                    F.col("e.dim").alias("dim"), F.col("e.w").alias("w_a"))
    b = long.select(group, F.col("class_id").alias("class_b"), F.col("n").alias("n_b"), F.col("norm").alias("norm_b"),
                    F.col("e.dim").alias("dim"), F.col("e.w").alias("w_b"))
    # candidates share an indexed dimension, so none is lost; products are sums over shared dimensions
    pairs = (pairs.join(a, [group, "class_a"]).join(b, [group, "class_b", "dim"])
             .groupBy(group, "class_a", "class_b", "n_a", "n_b").agg(
                 F.sum(F.col("w_a") * F.col("w_b")).alias("dot"), F.first("norm_a").alias("norm_a"), F.first("norm_b").alias("norm_b")))
    cos = F.least(F.lit(1.0), F.col("dot") / (F.col("norm_a") * F.col("norm_b")))
    return pairs.select(group, "class_a", "class_b", "n_a", "n_b", cos.alias("similarity")).where(F.col("similarity") >= t)


def cosine_pairs(classes: DataFrame, t: float, group: str = "prompt_id", small: int = SMALL) -> DataFrame:
    """``group, class_a, class_b, n_a, n_b, n_links, similarity`` of classes with a cosine of at least ``t`` (0 < t <= 1).

    A class of several solutions is linked with itself: ``n_links`` is then the number of pairs among them. Groups of up
    to ``small`` cells are compared whole, others by the index; both are exact.
    """
    if not 0 < t <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    classes = with_norm(classes)
    met = classes.where(F.col(group).isNotNull())
    cells = F.count(F.lit(1)) * F.sum(F.size("entries"))
    # the index sums over shared dimensions only, which matters where a weight is not finite (NaN is the largest)
    large = materialise(met.groupBy(group).agg(cells.alias("cells"), F.max("norm").alias("norm")).where(
        (F.col("cells") > small) | (F.col("norm") >= float("inf"))).select(group), "large")
    if large.limit(1).count():
        unlike = small_pairs(met.join(large, group, "left_anti"), t, group).unionByName(
            indexed_pairs(materialise(met.join(large, group, "left_semi"), "large_classes"), t, group))
    else:
        unlike = small_pairs(met, t, group)
    unlike = unlike.withColumn("n_links", F.col("n_a") * F.col("n_b"))
    alike = classes.where("n > 1").select(
        group, F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"), F.col("n").alias("n_a"),
        F.col("n").alias("n_b"), F.expr("n * (n - 1) div 2").alias("n_links"), F.lit(1.0).alias("similarity"))
    return unlike.select(alike.columns).unionByName(alike)


def link_counts(rows: DataFrame, pairs: DataFrame, group: str = "prompt_id", id_col: str = "solution_id") -> DataFrame:
    """``group, id, class_id, n_links`` for every row: its class (null without entries) and the other solutions it is linked with."""
    ends = pairs.select(group, F.col("class_a").alias("class_id"), F.when(F.col("class_a") == F.col("class_b"), F.col("n_b") - 1)
                        .otherwise(F.col("n_b")).alias("k")).unionByName(
        pairs.where("class_a <> class_b").select(group, F.col("class_b").alias("class_id"), F.col("n_a").alias("k")))
    counts = ends.groupBy(group, "class_id").agg(F.sum("k").alias("k"))
    named = histogram_classes(rows, group, id_col).join(counts, [group, "class_id"], "left")
    keyed = rows.select(group, id_col, F.array_sort("entries").alias("entries"))
    return keyed.join(named.select(group, "entries", "class_id", "k"), [group, "entries"], "left").select(
        group, id_col, "class_id", F.coalesce("k", F.lit(0)).alias("n_links"))


def ast_entries(solutions: DataFrame, facts: DataFrame) -> DataFrame:
    """``prompt_id, solution_id, entries`` from node histograms; a source that does not parse has no entries and no link.

    ``facts`` that carry the prompt (``codefacts.solution_facts``) are the solutions themselves.
    """
    entry = F.transform("types", lambda x: F.struct(x["node_type"].alias("dim"), x["n"].cast("double").alias("w")))
    none = F.array().cast("array<struct<dim: string, w: double>>")
    # cut before a join: a source's node types hold a dozen numbers each
    own = [c for c in ("prompt_id", "solution_id") if c in facts.columns]
    rows = facts.select(*own, F.when(F.col("parse_error").isNull(), entry).otherwise(none).alias("entries"))
    return rows if len(own) > 1 else solutions.select("prompt_id", "solution_id").join(rows, "solution_id")


def word_entries(solutions: DataFrame, counts: DataFrame) -> DataFrame:
    """``prompt_id, solution_id, entries`` from ``similarity.token_counts`` of whole sources; a source without words has none."""
    bags = counts.groupBy("solution_id").agg(F.collect_list(F.struct(F.col("word").alias("dim"), F.col("n").cast("double").alias("w"))).alias("entries"))
    none = F.array().cast("array<struct<dim: string, w: double>>")
    return solutions.select("prompt_id", "solution_id").join(bags, "solution_id", "left").select(
        "prompt_id", "solution_id", F.coalesce("entries", none).alias("entries"))


def text_entries(solutions: DataFrame) -> DataFrame:
    """:func:`word_entries` of ``solutions`` (prompt_id, solution_id, code): the words of a source become rows only where an id repeats.

    Such rows count together, as in ``similarity.token_counts``.
    """
    from codescope.operators.similarity import token_counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                cut, words, counts = [0], [], []
                for text in part.column(2):
                    bag = Counter((text.as_py() or b"").split())  # the ASCII blanks of \s
                    words += bag
                    counts += bag.values()
                    cut.append(len(words))
                flat = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.float64())], names=["dim", "w"])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), flat)],
                                                 names=["prompt_id", "solution_id", "entries"])

    named = F.col("solution_id").isNotNull()  # a missing id has no words, as in a join
    rows = solutions.select("prompt_id", "solution_id", F.when(named, normalize_code(F.col("code"))).cast("binary").alias("text"))
    kinds = dict(rows.dtypes)
    schema = f"prompt_id {kinds['prompt_id']}, solution_id {kinds['solution_id']}, entries array<struct<dim: string, w: double>>"
    again = materialise(solutions.groupBy("solution_id").count().where("count > 1").select("solution_id"), "again")
    if not again.limit(1).count():
        return rows.mapInArrow(run, schema)
    twice = solutions.join(again, "solution_id", "left_semi")
    return rows.join(again, "solution_id", "left_anti").select(rows.columns).mapInArrow(run, schema).unionByName(
        word_entries(twice, token_counts(twice.select("solution_id", "code"))))


def vector_entries(solutions: DataFrame, vectors: DataFrame) -> DataFrame:
    """``prompt_id, solution_id, entries`` from dense vectors (null and zero entries are left out); solutions without one are dropped."""
    dims = F.transform("vector", lambda x, i: F.struct(i.alias("dim"), x.cast("double").alias("w")))
    return solutions.select("prompt_id", "solution_id").join(vectors, "solution_id").select(
        "prompt_id", "solution_id", F.filter(dims, lambda e: F.coalesce(e["w"] != 0, F.lit(False))).alias("entries"))
