"""Faster ways through the same work: equal to the plain ones on rows of their own."""

import ast
import inspect
import random

from pyspark.sql import functions as F

from codescope.functions import lint, text
from codescope.operators import codefacts, fingerprint, forest


def summed(code):
    """TYPE_FIELDS per node type from X1's rows."""
    out = {}
    for row in codefacts.guarded_rows(code):
        if row[-1] is not None:
            return row[-1], {}
        _, _, depth, loop, block, name, _, _, weight, doc, stmt, lines, local, ops, operands, new_ops, new_operands, _ = row
        t = out.setdefault(name, [0] * 13)
        t[0], t[1], t[2] = t[0] + 1, max(t[1], depth), max(t[2], loop)
        for k, v in enumerate((weight, weight * (block >= 0), bool(doc), stmt, lines, bool(local), ops, operands, new_ops, new_operands), 3):
            t[k] += v
    return None, out


def test_type_counts_are_sums_of_node_rows():
    odd = [None, "", "def (", "x\0", "\ud800", "y=0x" + "f" * 5000, "y=0x" + "f" * 5000 + "\nx=a+b", "+".join("a" * 3000),
           "class A:\n def f(self):\n  ''\n  while f(1): f(2)\n  else: pass\n", "f'{x!r:>{w}} {a+b}'\nglobal q, r\n",
           "match x:\n case {'a': 1, **r}: pass\n case A(b=2) | [1, *z] if x > 1: pass\n", "def f():\n '''d\n e'''\n return [i for i in f() if i if not i]\n"]
    for code in odd + [inspect.getsource(m) for m in (ast, inspect, random, codefacts, forest)]:
        want, got = summed(code), codefacts.type_counts(code)
        assert got == want and list(got[1]) == list(want[1])


def test_lines_are_split_once_per_source(spark):
    r = random.Random(3)
    parts = ["a", "def f", "@", "#", ";", " ", "\t", "\n", "\n", "\r", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\u2028", "\xa0", "é"]
    rows = [(i, "".join(r.choices(parts, k=r.randint(0, 12)))) for i in range(500)] + [(-1, None), (-2, "\r\n")]
    df = spark.createDataFrame(rows, "id int, code string")
    got = df.select("id", text.line_count(F.col("code")).alias("n"), text.nonblank_line_count(F.col("code")).alias("k")).collect()
    for x in got:
        lines = None if dict(rows)[x.id] is None else dict(rows)[x.id].splitlines()
        assert (x.n, x.k) == ((None, None) if lines is None else (len(lines), sum(bool(s.strip()) for s in lines)))
    plan = df.select(lint.lint_counts(F.col("code")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(code") == 1  # before: once for every rule and every line that a rule looks back at


def test_small_and_large_groups_grow_alike(spark, monkeypatch):
    r, m = random.Random(3), 3
    rows = [(None if g == 3 else f"g{g}", i, r.choice("abc"), [float(r.randint(0, 5)) for _ in range(3)])
            for g in range(4) for i in range(1000 * g, 1000 * g + 24 + 6 * g)]
    df = spark.createDataFrame([(g, i, y, *x) for g, i, y, x in rows], "experiment_id string, solution_id int, model string, a double, b double, c double")
    got = []
    for small in (2_000, 35):  # all in tasks, and the largest groups as rows
        monkeypatch.setattr(forest, "SMALL", small)
        monkeypatch.setattr(forest, "ROOM", 100 if small == 35 else 4_000_000)
        found = forest.fingerprint_by(df, ["a", "b", "c"][:m], "model", trees=2).collect()
        got.append({x.experiment_id: (round(x.cv_accuracy, 9), round(x.cv_accuracy_std, 9), x.n_samples) for x in found})
    assert len(got[0]) == 4 and got[0] == got[1]


def test_equal_rows_keep_their_weight(spark):
    rows = [(float(i % 3), float(i % 7 == 0), "xy"[i % 2], i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, y string, fold int")
    out = fingerprint.equal_rows(df, ["a", "b"], ["y", "fold"], 1000, rows=100).collect()
    assert sum(x["_w"] for x in out) == 1000 and max(x["_w"] for x in out) <= 10 and len(out) <= 100 + 60
    weight = {}
    for x in out:
        weight[x.a, x.b, x.y, x.fold] = weight.get((x.a, x.b, x.y, x.fold), 0) + x["_w"]
    assert weight == {k: rows.count(k) for k in set(rows)}
    many = spark.range(5000).selectExpr("cast(id as double) a", "cast(id % 2 as double) b", "'x' y", "0 fold")
    out = fingerprint.equal_rows(many, ["a", "b"], ["y", "fold"], 5000, rows=100).collect()
    assert sum(x["_w"] for x in out) == 5000 and len(out) <= 100 + 64
    assert fingerprint.equal_rows(df, ["a", "b"], ["y", "fold"], 1000).where("_w = 1").count() == 1000
