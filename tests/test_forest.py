"""M6 per experiment against a plain Python forest grown by the same rules."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

from codescope.operators import forest

SCHEMA = "experiment_id int, solution_id int, model string, a double, b double"


def uniform(*parts):
    return (xxhash.xxh64(":".join(map(str, parts)).encode(), seed=42).intdigest() >> 11) / (1 << 53)


def plain_accuracy(rows, seed=42, trees=5, bins=32):
    """(mean, population std) of the fold accuracies of one group; rows are (id, label, features)."""
    classes = {}
    for r in rows:
        classes.setdefault(r[1], []).append(r)
    folds = min(5, min(map(len, classes.values())))
    if len(classes) < 2 or folds < 2:
        return None, None
    fold = {r[0]: i % folds for own in classes.values()
            for i, r in enumerate(sorted(own, key=lambda r: hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest()))}
    m, n = len(rows[0][2]), len(rows)
    binned = {}
    cuts = [sorted({sorted(r[2][j] for r in rows)[max(math.ceil(q / bins * n) - 1, 0)] for q in range(1, bins)}) for j in range(m)]
    for r in rows:
        binned[r[0]] = [sum(c < r[2][j] for c in cuts[j]) for j in range(m)]

    def grow(node, train):
        """train: (bins, label, weight) with weight > 0. Returns a function from bins to class shares."""
        total = {}
        for _, y, w in train:
            total[y] = total.get(y, 0) + w
        size = sum(total.values())
        best = None
        first = [j for _, j in sorted((uniform(seed, tree, node, j), j) for j in range(m))][:math.ceil(math.sqrt(m))]
        for j in range(m):
            for cut in sorted({b[j] for b, _, _ in train}):
                sides = [{}, {}]
                for b, y, w in train:
                    side = sides[b[j] > cut]
                    side[y] = side.get(y, 0) + w
                if len(total) > 1 and all(sides):
                    score = round(sum(sum(w * w for w in s.values()) / sum(s.values()) for s in sides), 9)
                    best = max(best or (-1,), (j in first, score, -j, -cut))
        if best is None:
            return lambda b: {y: w / size for y, w in total.items()}
        j, cut = -best[2], -best[3]
        low = grow(2 * node, [t for t in train if t[0][j] <= cut])
        high = grow(2 * node + 1, [t for t in train if t[0][j] > cut])
        return lambda b: (high if b[j] > cut else low)(b)

    scores = []
    for held in range(folds):
        votes = {r[0]: {} for r in rows if fold[r[0]] == held}
        for tree in range(trees):
            train = [(binned[i], y, sum(uniform(seed, tree, i) >= p for p in forest.COPIES)) for i, y, _ in rows if fold[i] != held]
            of = grow(1, [t for t in train if t[2]])
            for i, v in votes.items():
                for y, p in of(binned[i]).items():
                    v[y] = v.get(y, 0) + p
        told = {i: min(y for y in v if round(v[y], 9) == max(round(p, 9) for p in v.values())) for i, v in votes.items()}
        scores.append(np.mean([told[i] == y for i, y, _ in rows if fold[i] == held]))
    return float(np.mean(scores)), float(np.std(scores))


def corpus(seed):
    """Groups of several shapes: separable, noise, one class, a class of one row."""
    r = random.Random(seed)
    rows, i = [], 0
    for g, n in enumerate((60, 40, 12, 9)):
        for k in range(n):
            y = "m0" if g == 2 else "lone" if g == 3 and k == 0 else f"m{r.randrange(3)}"
            a = float({"m0": 1, "m1": 5, "m2": 9}.get(y, 3) + r.randint(0, 2)) if g == 0 else float(r.randint(0, 6))
            rows.append((g, i, y, a, None if r.random() < 0.1 else round(r.random() * 4, 1)))
            i += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_forest(spark, seed):
    rows = corpus(seed)
    got = {r.experiment_id: r for r in forest.fingerprint_by(spark.createDataFrame(rows, SCHEMA).repartition(3), ["a", "b"], "model", trees=5).collect()}
    assert set(got) == {0, 1, 2, 3}
    for g in got:
        mean, std = plain_accuracy([(i, y, (a, b or 0.0)) for e, i, y, a, b in rows if e == g])
        if mean is None:
            assert (got[g].cv_accuracy, got[g].cv_accuracy_std, got[g].sufficient_data) == (None, None, False)
        else:
            assert abs(got[g].cv_accuracy - mean) < 1e-9 and abs(got[g].cv_accuracy_std - std) < 1e-9
    assert got[0].cv_accuracy > 0.9 > got[0].baseline_accuracy + 0.2  # separable classes are told apart


def test_empty(spark):
    assert forest.fingerprint_by(spark.createDataFrame([], SCHEMA), ["a", "b"], "model").count() == 0
