"""M6 per experiment: cross-validated accuracy of a bagged forest, grown level by level as DataFrame aggregates.

All groups (experiments), folds and trees grow together; the driver loops over no groups:

* features become bins (quantiles of their group) and rows become **cells** (group, fold, bins, label) with counts, so a
  level's work follows the distinct cells and not the rows;
* every tree weighs a row by a seeded hash, distributed like the copies of a bootstrap (Poisson with mean 1), summed per cell;
* a **level** is one histogram (node, feature, bin, label) with partial sums. A split's score is the sum over its sides of the squared
  class weights over the side's weight, which is the Gini criterion; running sums over bins give it for every bin at once, as a
  class that grows from a to b adds b² - a². The features of a node are tried in a seeded order: the best split of the first
  ``ceil(sqrt(m))``, or of the others where those have none. A node with one class, or without a split, is a leaf;
* groups of up to ``SMALL`` rows are grown by the same rules inside tasks, many groups to a task (``small_hits``), as their
  levels would be rows for each cell, fold and tree; larger ones grow as rows, and none of them meets in one task;
* a held-out cell gets the mean class shares of its leaves over all trees, and the label with the largest (ties: the smallest).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescope.functions.text import once
from codescope.operators.describe import average_rank, class_balance, same_keys
from codescope.sources.scratch import materialise

TREES, BINS, MOST_LEVELS = 20, 32, 24
#: Rows of a group that one task may hold, rows that it gets about, and numbers of a histogram at a time.
SMALL, TASK_ROWS, ROOM = 2_000, 20_000, 4_000_000
#: Poisson(1) distribution function: P(copies <= k) for k = 0, 1, ...
COPIES = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
DIGITS = 9


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(F.concat_ws(":", *parts)), 11) / F.lit(float(1 << 53))


def fold_rows(df: DataFrame, features: list[str], label_col: str, group: str, id_col: str, seed: int) -> DataFrame:
    """``group, id, label, fold, folds, size, x``: rows of groups with enough data, dealt to folds within each label by a seeded hash.

    Missing features count as 0; rows without a label are left out.
    """
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = df.where(F.col(label_col).isNotNull()).select(F.col(group).alias("group"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x"))
    enough = class_balance(rows, "label", "group").where("sufficient_data").select("group", F.col("n_folds").alias("folds"), F.col("n_samples").alias("size"))
    rows = same_keys(rows, enough, ["group"], "inner").withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col("id")).cast("binary")))
    ranked = average_rank(rows, "_h", ["group", "label"], "_r")
    return ranked.withColumn("fold", ((F.floor("_r") - 1) % F.col("folds")).cast("int")).drop("_h", "_r")


def _below(cuts: Column, x: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < x))


def binned_rows(rows: DataFrame, m: int, bins: int) -> DataFrame:
    """``group, id, label, fold, folds, bins``: features as the numbers of their group's quantile bins."""
    cuts = [F.array_distinct(F.percentile_approx(F.col("x")[j], [q / bins for q in range(1, bins)], 10_000)).alias(f"cuts{j}") for j in range(m)]
    limits = materialise(rows.groupBy("group").agg(*cuts), "cuts")
    return same_keys(rows, limits, ["group"], "inner").select("group", "id", "label", "fold", "folds", F.array(*[
        _below(F.col(f"cuts{j}"), F.col("x")[j]) for j in range(m)]).alias("bins"))


def _copies(tree: Column, seed: int) -> Column:
    """How often the row ``id`` is in a tree's bootstrap."""
    return once(_uniform(F.lit(seed), tree, F.col("id")), lambda u: sum((F.when(u >= p, 1).otherwise(0) for p in COPIES), F.lit(0)))


def cells(rows: DataFrame, m: int, trees: int, bins: int, seed: int) -> DataFrame:
    """``group, held, tree, bins, label, train, test``: for every held-out fold the bagged weight and the held-out rows of each cell."""
    binned, copies = binned_rows(rows, m, bins), _copies(F.col("tree"), seed)
    bagged = (binned.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("w", copies)
              .groupBy("group", "tree", "bins", "label", "fold", "folds").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")))
    each = bagged.withColumn("held", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)))
    own = F.col("fold") == F.col("held")
    return each.groupBy("group", "held", "tree", "bins", "label").agg(
        F.sum(F.when(own, 0).otherwise(F.col("w"))).cast("double").alias("train"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("test"))


NODE = ["group", "held", "tree", "node"]


def best_splits(state: DataFrame, m: int, seed: int) -> DataFrame:
    """``NODE, feature, cut``: the split of every node with several classes that has one; rows go left up to bin ``cut``."""
    hist = (state.where("train > 0").select(*NODE, "label", "train", F.posexplode("bins").alias("feature", "bin"))
            .groupBy(*NODE, "feature", "bin", "label").agg(F.sum("train").alias("c")))
    of_label = Window.partitionBy(*NODE, "feature", "label")
    left, total = F.sum("c").over(of_label.orderBy("bin")), F.sum("c").over(of_label)
    hist = hist.withColumns({"left": left, "total": total})
    a, t, c = F.col("left"), F.col("total"), F.col("c")
    steps = hist.groupBy(*NODE, "feature", "bin").agg(
        F.sum("c").alias("c"), F.sum(a * a - (a - c) * (a - c)).alias("up"), F.sum((t - a + c) * (t - a + c) - (t - a) * (t - a)).alias("down"))
    of_feature = Window.partitionBy(*NODE, "feature")
    upto = of_feature.orderBy("bin")
    steps = steps.select(*NODE, "feature", "bin", F.sum("c").over(upto).alias("l"), F.sum("c").over(of_feature).alias("n"),
                         F.sum("up").over(upto).alias("sl"), (F.sum("down").over(of_feature) - F.sum("down").over(upto)).alias("sr"),
                         F.sum("down").over(of_feature).alias("s"))
    valid = steps.where("l < n AND s < n * n")  # both sides have weight, and the node several classes
    place = [F.struct(_uniform(F.lit(seed), F.col("tree"), F.col("node"), F.lit(j)).alias("u"), F.lit(j).alias("j")) for j in range(m)]
    first = F.slice(F.array_sort(F.array(*place)), 1, math.ceil(math.sqrt(m)))
    tried = F.exists(first, lambda p: p["j"] == F.col("feature")).cast("int")
    score = F.round(F.col("sl") / F.col("l") + F.col("sr") / (F.col("n") - F.col("l")), DIGITS)
    return valid.groupBy(*NODE).agg(F.max(F.struct(tried.alias("tried"), score.alias("score"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("best")).select(
        *NODE, (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("cut"))


def grown(state: DataFrame, m: int, seed: int) -> DataFrame:
    """``state`` cells with the ``node`` they end in; a node's children are 2 * node and 2 * node + 1."""
    live, leaves = materialise(state.withColumn("node", F.lit(1).cast("bigint")), "level"), []
    for _ in range(MOST_LEVELS):
        split = materialise(same_keys(live, best_splits(live, m, seed), NODE), "level")
        leaves.append(split.where("feature IS NULL").drop("feature", "cut"))
        live = split.where("feature IS NOT NULL").withColumn("node", 2 * F.col("node") + F.when(
            F.element_at("bins", (F.col("feature") + 1).cast("int")) > F.col("cut"), 1).otherwise(0)).drop("feature", "cut")
        if not live.limit(1).count():
            break
    else:
        leaves.append(live)
    out = leaves[0]
    for part in leaves[1:]:
        out = out.unionByName(part)
    return materialise(out, "leaves")


@lru_cache(100_000)
def _first_tried(seed: int, tree: int, node: int, m: int) -> tuple[int, ...]:
    """The features that a node tries first, as ``best_splits`` orders them."""
    if math.ceil(math.sqrt(m)) >= m:
        return tuple(range(m))
    from xxhash import xxh64_intdigest  # the hash of Spark
    u = [(xxh64_intdigest(f"{seed}:{tree}:{node}:{j}".encode(), 42) >> 11, j) for j in range(m)]
    return tuple(j for _, j in sorted(u)[:math.ceil(math.sqrt(m))])


def _places(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its combination of keys, in their order, and a row of each combination."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new)
    new[:1] = True
    return at, order[new]


def _splits(at, n_nodes: int, number, tree, bins, label, train, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none) and cut of every node ``0 .. n_nodes - 1``, from the entries ``at`` it (ascending)."""
    m, width, classes = bins.shape[1], int(bins.max()) + 1, int(label.max()) + 1
    feature, cut = np.full(n_nodes, -1), np.zeros(n_nodes, np.int64)
    step = max(1, ROOM // (width * classes))
    for lo in range(0, n_nodes, step):
        hi = min(n_nodes, lo + step)
        own = slice(*np.searchsorted(at, [lo, hi]))
        best, best_tried = np.full(hi - lo, -np.inf), np.zeros(hi - lo, bool)
        tried = np.ones((hi - lo, m), bool)
        if math.ceil(math.sqrt(m)) < m:
            tried[:] = [[j in _first_tried(seed, int(t), int(x), m) for j in range(m)] for t, x in zip(tree[lo:hi], number[lo:hi])]
        for j in range(m):
            h = np.bincount(((at[own] - lo) * width + bins[own, j]) * classes + label[own], train[own], (hi - lo) * width * classes)
            left = h.reshape(hi - lo, width, classes).cumsum(1)
            total = left[:, -1:]
            l, n = left.sum(2), total.sum(2)
            here = np.diff(l, axis=1, prepend=0) > 0
            valid = here & (l < n) & ((total * total).sum(2) < n * n)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.round((left * left).sum(2) / l + ((total - left) ** 2).sum(2) / (n - l), DIGITS)
            score = np.where(valid, score, -np.inf)
            k = score.argmax(1)
            top = score[np.arange(hi - lo), k]
            better = (top > -np.inf) & ((feature[lo:hi] < 0) | (tried[:, j] & ~best_tried) | ((tried[:, j] == best_tried) & (top > best)))
            feature[lo:hi][better], cut[lo:hi][better], best[better], best_tried[better] = j, k[better], top[better], tried[better, j]
    return feature, cut


def grown_hits(group, label, fold, folds, bins, copies, seed: int):
    """(group, held, accuracy) of whole groups: the rules of ``grown`` and the votes, over arrays. Labels are numbers in order."""
    m, trees = bins.shape[1], copies.shape[1]
    most = int(folds.max())
    at, one = _places(group, *bins.T, label)
    n = len(one)
    train, test = np.zeros((n, most, trees)), np.zeros((n, most))
    np.add.at(train, (at, fold), copies)
    np.add.at(test, (at, fold), 1)
    train = train.sum(1, keepdims=True) - train
    group, label, folds, bins = group[one], label[one], folds[one], bins[one]
    cell, held, tree = (x.ravel() for x in np.indices((n, most, trees)))
    open_ = np.flatnonzero((held < folds[cell]) & ((train.ravel() > 0) | (test[cell, held] > 0)))
    number, leaf, n_leaves = np.ones(n * most * trees, np.int64), np.full(n * most * trees, -1), 0
    weight = train.ravel()
    for level in range(MOST_LEVELS + 1):
        if not len(open_):
            break
        node, some = _places(group[cell[open_]], held[open_], tree[open_], number[open_])
        feature = np.full(len(some), -1)
        if level < MOST_LEVELS:
            w = open_[weight[open_] > 0]
            at = node[weight[open_] > 0]
            order = np.argsort(at, kind="stable")
            w, at = w[order], at[order]
            if len(w):
                feature, cut = _splits(at, len(some), number[open_[some]], tree[open_[some]], bins[cell[w]], label[cell[w]], weight[w], seed)
        done = feature[node] < 0
        names, where = np.unique(node[done], return_inverse=True)
        leaf[open_[done]] = n_leaves + where
        n_leaves += len(names)
        node, open_ = node[~done], open_[~done]
        number[open_] = 2 * number[open_] + (bins[cell[open_], feature[node]] > cut[node] if len(open_) else 0)
    ended = np.flatnonzero(leaf >= 0)
    classes = int(label.max()) + 1
    share = np.bincount(leaf[ended] * classes + label[cell[ended]], weight[ended], n_leaves * classes).reshape(n_leaves, classes)
    share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
    c, h = np.nonzero(test)
    leaf = leaf.reshape(n, most, trees)
    votes = sum(share[leaf[c, h, t]] for t in range(trees)).round(DIGITS)
    hit = test[c, h] * ((votes.argmax(1) == label[c]) & (votes.max(1) > 0))
    at, one = _places(group[c], h)
    return group[c][one], h[one], np.bincount(at, hit) / np.bincount(at, test[c, h])


def small_hits(rows: DataFrame, m: int, trees: int, bins: int, seed: int) -> DataFrame:
    """``group, accuracy`` of every held-out fold, for groups of up to SMALL rows: whole groups are dealt to tasks."""
    copies = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _copies(t, seed).cast("byte"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS)
    ready = binned_rows(rows, m, bins).select(
        F.pmod(F.xxhash64("group"), F.lit(tasks)).alias("task"), "group", "label", "fold", "folds", "bins", copies.alias("copies"))

    def run(t: pa.Table) -> pa.Table:
        groups = t.column("group").combine_chunks().dictionary_encode()
        g = groups.indices.fill_null(len(groups.dictionary)).to_numpy(zero_copy_only=False)
        names = pa.concat_arrays([groups.dictionary, pa.nulls(1, groups.dictionary.type)])
        t = t.take(pa.array(np.argsort(g, kind="stable")))
        g = np.sort(g, kind="stable")
        y = np.unique(np.array(t.column("label").to_pylist()), return_inverse=True)[1]
        cell = {c: t.column(c).combine_chunks().flatten().to_numpy().reshape(len(g), -1) for c in ("bins", "copies")}
        fold, folds = (t.column(c).to_numpy() for c in ("fold", "folds"))
        starts, out = np.flatnonzero(np.diff(g, prepend=-1)), []
        lo = 0
        for hi in np.append(starts[1:], len(g)):  # whole groups of about SMALL rows in all
            if hi - lo >= SMALL or hi == len(g):
                own = slice(lo, hi)
                out.append(grown_hits(g[own], y[own], fold[own], folds[own], cell["bins"][own], cell["copies"][own], seed))
                lo = hi
        found = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"group": names.take(pa.array(found[0])), "accuracy": found[2]})

    return ready.groupBy("task").applyInArrow(run, f"group {dict(rows.dtypes)['group']}, accuracy double")


def grown_rows_hits(rows: DataFrame, m: int, trees: int, bins: int, seed: int) -> DataFrame:
    """``group, accuracy`` of every held-out fold, for groups of any size: levels are rows."""
    ended = grown(cells(rows, m, trees, bins, seed), m, seed)
    weight = ended.groupBy(*NODE, "label").agg(F.sum("train").alias("c"))
    share = same_keys(weight, ended.groupBy(*NODE).agg(F.sum("train").alias("n")), NODE).where("c > 0").select(
        *NODE, "label", (F.col("c") / F.col("n")).alias("p"))
    asked = ended.where("test > 0").select(*NODE, "bins").distinct()
    votes = same_keys(asked, share, NODE, "inner").groupBy("group", "held", "bins", "label").agg(F.round(F.sum("p"), DIGITS).alias("p"))
    told = votes.groupBy("group", "held", "bins").agg(F.max("p").alias("most"))
    told = same_keys(votes, told, ["group", "held", "bins"], "inner").where("p = most").groupBy("group", "held", "bins").agg(F.min("label").alias("told"))
    truth = ended.where("tree = 0 AND test > 0").groupBy("group", "held", "bins", "label").agg(F.sum("test").alias("test"))
    hits = same_keys(truth, told, ["group", "held", "bins"]).groupBy("group", "held").agg(
        (F.sum(F.when(F.col("told") == F.col("label"), F.col("test")).otherwise(0)) / F.sum("test")).alias("accuracy"))
    return hits.select("group", "accuracy")


def fingerprint_by(df: DataFrame, features: list[str], label_col: str, group: str = "experiment_id", id_col: str = "solution_id",
                   seed: int = 42, trees: int = TREES, bins: int = BINS) -> DataFrame:
    """M6 per group: ``cv_accuracy, cv_accuracy_std`` (population) over the folds, with the class balance of A7.

    Scores are NULL where a group has fewer than two classes or a class of fewer than two rows.
    """
    rows = materialise(fold_rows(df, features, label_col, group, id_col, seed), "folds")
    m = len(features)
    hits = small_hits(rows.where(F.col("size") <= SMALL), m, trees, bins, seed)
    large = rows.where(F.col("size") > SMALL)
    if large.limit(1).count():
        hits = hits.unionByName(grown_rows_hits(large, m, trees, bins, seed))
    scores = hits.groupBy("group").agg(F.avg("accuracy").alias("cv_accuracy"), F.stddev_pop("accuracy").alias("cv_accuracy_std"))
    balance = class_balance(df.where(F.col(label_col).isNotNull()), label_col, group)
    return same_keys(balance, scores.withColumnRenamed("group", group), [group]).select(
        group, "cv_accuracy", "cv_accuracy_std", "n_samples", "n_classes", "baseline_accuracy", "sufficient_data")
