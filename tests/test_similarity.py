"""J3, J7, X11–X14 (FIXTURES.md §4) and the exact aggregate against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from codescope.operators import similarity as SIM
from codescope.operators.codefacts import source_facts
from codescope.plans.corpus import CODE_TEMPLATES

T = [t.replace("_KEY", "") for t in CODE_TEMPLATES]
SUM_TWO = "def sum_two(x, y):\n    return x + y\n"
LOOP1 = "def f(a):\n    for x in a:\n        pass\n"


def _pairs(spark, pairs):
    codes = {}
    rows = []
    for k, (a, b) in enumerate(pairs):
        codes[2 * k], codes[2 * k + 1] = a, b
        rows.append((0, 2 * k, 2 * k + 1, "m1", "m2"))
    code = spark.createDataFrame(list(codes.items()), "solution_id long, code string")
    pr = spark.createDataFrame(rows, "prompt_id long, solution_a long, solution_b long, model_a string, model_b string")
    out = SIM.similarity_report(pr, code, source_facts(code), None).orderBy("solution_a").collect()
    return [(r["token_similarity"], r["ast_similarity"]) for r in out]


def _overlap(a, b):
    from collections import Counter
    ca, cb = (Counter(x.split()) for x in (a, b))
    return 2 * sum((ca & cb).values()) / (sum(ca.values()) + sum(cb.values()))


def test_fixture_pairs(spark):
    pairs = [(T[0], T[0]), (T[0], SUM_TWO), (T[2], T[3]), (T[4], T[3]), (LOOP1, T[5]), (T[1], T[7])]
    got = _pairs(spark, pairs)
    assert [g[0] for g in got] == [pytest.approx(_overlap(a, b)) for a, b in pairs]
    assert got[0] == (1.0, 1.0) and got[1][0] < 1.0 and got[1][1] == 1.0
    assert got[2][1] == pytest.approx(0.7267220926874316)
    assert got[3][1] == pytest.approx(0.8954430086935639)
    assert got[4][1] == pytest.approx(0.9547859244962515)
    assert got[5][1] == 0.0   # parse error on one side


def test_embedding_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 1.0]),
                                ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0], None)], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(SIM.embedding_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:4] == [1.0, 0.0, pytest.approx(0.8), 0.0] and got[4] is None


def test_token_similarity_normalises(spark):
    a = "def f(x):  # comment\n\n    return x   \n"
    b = "def f(x):\n    return x\n"
    pr = spark.createDataFrame([(1, 2), (3, 4), (1, 3)], "solution_a long, solution_b long")
    code = spark.createDataFrame([(1, a), (2, b), (3, "# only"), (4, None)], "solution_id long, code string")
    got = {(r[0], r[1]): r["token_similarity"] for r in SIM.token_similarity(pr, code).select(
        "solution_a", "solution_b", "token_similarity").collect()}
    assert got == {(1, 2): 1.0, (3, 4): 1.0, (1, 3): 0.0}


def _unit(h):
    n = math.sqrt(sum(v * v for v in h.values()))
    return {k: v / n for k, v in h.items()}


def test_model_pair_means_equal_brute_force(spark):
    rnd = random.Random(7)
    sols, vecs = [], []
    for sid in range(60):
        sols.append((sid, sid // 15, f"m{rnd.randrange(4)}", T[rnd.randrange(8)]))
        if rnd.random() < 0.7:
            vecs.append((sid, [rnd.uniform(-1, 1) for _ in range(5)]))
    sdf = spark.createDataFrame(sols, "solution_id long, prompt_id long, model string, code string")
    vdf = spark.createDataFrame(vecs, "solution_id long, vector array<double>")
    facts = source_facts(sdf.select("solution_id", "code"))
    got = {(r["prompt_id"], r["model_a"], r["model_b"]): r
           for r in SIM.model_pair_similarity(sdf, facts, vdf).collect()}
    # brute force over every solution pair of each prompt
    import ast
    hists = {}
    for sid, _, _, code in sols:
        try:
            hists[sid] = {}
            for n in ast.walk(ast.parse(code)):
                hists[sid][type(n).__name__] = hists[sid].get(type(n).__name__, 0) + 1
        except SyntaxError:
            hists[sid] = None
    vec = dict(vecs)
    agg = {}
    for a, b in itertools.combinations(sols, 2):
        if a[1] != b[1]:
            continue
        key = (a[1], min(a[2], b[2]), max(a[2], b[2]))
        ha, hb = hists[a[0]], hists[b[0]]
        ast_sim = 0.0 if ha is None or hb is None else sum(
            _unit(ha).get(k, 0) * _unit(hb).get(k, 0) for k in set(ha) | set(hb))
        e = agg.setdefault(key, [0, 0.0, 0, 0.0])
        e[0] += 1
        e[1] += ast_sim
        if a[0] in vec and b[0] in vec:
            va, vb = vec[a[0]], vec[b[0]]
            e[2] += 1
            e[3] += sum(x * y for x, y in zip(va, vb)) / (math.sqrt(sum(x * x for x in va)) * math.sqrt(sum(y * y for y in vb)))
    assert set(agg) == set(got)
    for key, (n, s, m, es) in agg.items():
        r = got[key]
        assert r["n_pairs"] == n and r["ast_similarity_mean"] == pytest.approx(s / n, abs=1e-9)
        assert r["n_embedding_pairs"] == m
        if m:
            assert r["embedding_similarity_mean"] == pytest.approx(es / m, abs=1e-9)


def test_coverage_pairs_are_linear_and_cover_all(spark):
    rows = [(i, i % 3, f"m{i % 4}") for i in range(90)]
    sdf = spark.createDataFrame(rows, "solution_id long, prompt_id long, model string")
    pairs = SIM.coverage_pairs(sdf)
    got = [(r["prompt_id"], r["solution_a"], r["solution_b"], r["model_a"], r["model_b"]) for r in pairs.collect()]
    reps = {}
    for i, p, m in rows:
        reps.setdefault((p, m), i)
    want = {(p, min(i, r), max(i, r), rows[min(i, r)][2], rows[max(i, r)][2])
            for i, p, _ in rows for (q, _), r in reps.items() if p == q and i != r}
    assert len(got) == len(set(got)) and set(got) == want
    assert len(got) <= len(rows) * 4 and {x for g in got for x in g[1:3]} == set(range(90))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_native_alternatives(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("abcd", "abcd"), ("abcd", "xyz")], "a string, b string")
    got = df.select(SIM.levenshtein_ratio(F.col("a"), F.col("b")).alias("l"),
                    SIM.shingle_jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert got[0]["l"] == pytest.approx(1 - 3 / 7) and got[1]["l"] == 1.0 and got[2]["j"] == 1.0
    assert got[3]["j"] == 0.0
    # kitten/sitting trigrams: {kit,itt,tte,ten} vs {sit,itt,tti,tin,ing} → 1 shared of 8
    assert got[0]["j"] == pytest.approx(1 / 8)


def test_embed_with_seam(spark):
    from codescope.operators.clustering import embed_with
    calls = []

    def load():
        calls.append(1)
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string")
    out = {r["id"]: r["vector"] for r in embed_with(df, "id", "t", load, 2).collect()}
    assert out == {1: [2.0, 1.0], 2: [0.0, 1.0]}


def test_pair_scores_of_a_large_prompt_send_each_source_about_once(spark):
    """A prompt of many blocks, repeated ids, missing sources and words beyond ASCII, against counting every pair."""
    from collections import Counter

    from codescope.operators import pair_cells as PC
    rnd = random.Random(3)
    words = ["a", "b", "x1", "é", "a\x0bb", "c d", "long" * 30, "="]
    sols = [(i, 0 if i < 500 else i // 20, f"m{rnd.randrange(4)}") for i in range(700)]
    text = {i: " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 40]))) for i, _, _ in sols}
    codes = [(i, t) for i, t in text.items() if i % 11] + [(7, "a b")]
    sdf = spark.createDataFrame(sols, "solution_id long, prompt_id long, model string")
    pairs = SIM.coverage_pairs(sdf)
    dealt = PC.cells(pairs)
    sent = dealt.select("cell", F.explode(F.array("solution_a", "solution_b")).alias("s")).distinct().groupBy("cell").count().collect()
    assert max(r["count"] for r in sent) <= 4 * PC.BLOCK and sum(r["count"] for r in sent) < 2 * len(sols)
    bags: dict = {}
    for i, t in codes:
        bags.setdefault(i, Counter()).update(t.encode().split())
    got = SIM.token_similarity(pairs, spark.createDataFrame(codes, "solution_id long, code string")).collect()
    assert len(got) == pairs.count()
    for r in got:
        a, b = bags.get(r["solution_a"], Counter()), bags.get(r["solution_b"], Counter())
        n = a.total() + b.total()
        assert r["token_similarity"] == (2.0 * (a & b).total() / n if n else 1.0)


def test_no_scorer_joins_every_pair_with_its_payloads(spark):
    sol = spark.createDataFrame([(i, 0, f"m{i % 3}") for i in range(30)], "solution_id long, prompt_id long, model string")
    code = spark.createDataFrame([(i, T[i % 8]) for i in range(30)], "solution_id long, code string")
    out = SIM.pair_ast_similarity(SIM.coverage_pairs(sol), source_facts(code))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the histograms are joined once, not for each side of a pair
    hist = {i: _histogram(t) for i, t in enumerate(T)}
    for r in out.collect():
        a, b = hist[r["solution_a"] % 8], hist[r["solution_b"] % 8]
        want = 0.0 if a is None or b is None else min(1.0, sum(n * b.get(k, 0) for k, n in a.items()) / (
            math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))))
        assert r["ast_similarity"] == pytest.approx(want)


def _histogram(code):
    from codescope.operators.codefacts import type_counts
    error, types = type_counts(code)
    return None if error else {k: v[0] for k, v in types.items()}


def test_facts_that_carry_the_prompt_need_no_join(spark, monkeypatch):
    """Repeated ids meet each other, missing ones go, and tasks get more where the rows grow."""
    from codescope.operators import codefacts
    rows = [(i, i // 6, "ab"[i % 2], f"x = {i}\n" if i % 3 else f"def f{i}(a):\n    return a + {i}\n") for i in range(1, 60)]
    sol = spark.createDataFrame(rows + [rows[3], rows[3], (None, 1, "a", "x = 1\n"), (90, None, "a", "y\n"), (91, 1, None, "z\n")],
                                "solution_id int, prompt_id int, model string, code string")
    plain = codefacts.source_facts(sol.select("solution_id", "code"))
    monkeypatch.setattr(codefacts, "TASK_ROWS", 2)
    facts = codefacts.solution_facts(sol, ("prompt_id", "model"))

    def found(df, *cols):
        return sorted(map(str, df.select(*cols).collect()))

    cols = "solution_id", "prompt_id", "model", "parse_error", "types"
    assert found(facts, *cols) == found(sol.drop("code").join(plain, "solution_id"), *cols)
    assert codefacts.solution_facts(sol.where("solution_id <> 4"), ("prompt_id", "model")).rdd.getNumPartitions() >= 29
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 40)], "solution_id int, vector array<double>")
    new = SIM.model_pair_similarity(sol, facts, vec)
    was = {tuple(r[:3]): r[3:] for r in SIM.model_pair_similarity(sol, plain, vec).collect()}
    got = {tuple(r[:3]): r[3:] for r in new.collect()}
    assert len(got) == len(was) > 20
    assert all([round(x, 9) if x is not None else x for x in got[k]] == [round(x, 9) if x is not None else x for x in was[k]] for k in was)
    assert "REPARTITION_BY_NUM" in new._jdf.queryExecution().executedPlan().toString()


def _odd_solutions(spark):
    """A large prompt of three blocks, small ones, repeated ids (also with other models), null models and ids, sources that do not parse."""
    rnd = random.Random(5)
    rows = [(i, 0 if i < 180 else i // 20, f"m{rnd.randrange(4)}" if i % 13 else None, T[rnd.randrange(8)] + "x = 1 # y\n" * rnd.randrange(3)) for i in range(300)]
    rows += rows[3:9] + rows[200:203] + [(0, 0, "m9", "z = 3\n"), (200, 10, "m9", None), (None, 1, "m1", "a\n"), (400, None, "m1", "b\n")]
    vec = [(i, [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(0, 300, 3)] + [(6, [0.0, 0.0, 0.0]), (9, None), (999, [1.0, 0.0, 0.0])]
    return (spark.createDataFrame(rows, "solution_id long, prompt_id long, model string, code string"),
            spark.createDataFrame(vec, "solution_id long, vector array<double>"))


def test_dealt_pairs_score_as_joined_pairs_do(spark):
    from codescope.operators import pair_cells as PC
    sol, vec = _odd_solutions(spark)
    dealt = SIM.in_cells(sol).select("solution_id", "code", "cells")
    sent = dealt.select(F.explode("cells").alias("cell"), "solution_id").distinct()
    assert max(r["count"] for r in sent.groupBy("cell").count().collect()) <= 4 * PC.BLOCK
    assert sent.count() < 1.2 * sol.select("solution_id").distinct().count()
    facts = source_facts(dealt, carry=("cells",), dealt=True, fields=("n",))
    pairs, at = SIM.coverage_pairs(sol), SIM.coverage_pairs(sol, dealt=True)
    assert at.select("cell").distinct().count() > at.select("prompt_id").distinct().count()
    code, plain = sol.select("solution_id", "code"), source_facts(sol.select("solution_id", "code"))
    found = SIM.similarity_report(at, dealt, facts, vec)
    joined = SIM.similarity_report(pairs, code, plain, vec)
    assert found.columns == joined.columns and found.count() > 1000
    assert sorted(map(str, _rounded(found))) == sorted(map(str, _rounded(joined)))
    assert sorted(map(str, _rounded(SIM.pair_ast_similarity(at, facts)))) == sorted(map(str, _rounded(SIM.pair_ast_similarity(pairs, plain))))
    assert sorted(map(str, _rounded(SIM.token_similarity(at, dealt)))) == sorted(map(str, _rounded(SIM.token_similarity(pairs, code))))


def _rounded(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]


def test_coverage_pairs_repeat_as_rows_do(spark):
    """Every row meets every (model, first id) of its prompt; a row whose id stands for k models meets them k times."""
    sol, _ = _odd_solutions(spark)
    rows = [(r[0], r[1], r[2]) for r in sol.collect() if r[0] is not None and r[1] is not None]
    reps: dict = {}
    for i, p, m in rows:
        reps[p, m] = min(i, reps.get((p, m), i))
    want = []
    for i, p, m in rows:
        own = sum(r == i for r in reps.values())
        for (q, n), r in reps.items():
            if p == q and (i < r or (i > r and not own)):
                want += [(p, min(i, r), max(i, r), m if i < r else n, n if i < r else m)] * max(own, 1)
    assert any(sum(r == i for r in reps.values()) > 1 for i, _, _ in rows)
    assert sorted(map(str, map(tuple, SIM.coverage_pairs(sol).collect()))) == sorted(map(str, want))


def test_bulk_sums_equal_counting():
    """Steps of the sums cut anywhere, and cells that cross batches, give what counting each pair gives."""
    import numpy as np
    import pyarrow as pa
    from collections import Counter

    from codescope.operators import pair_cells as PC
    rnd = np.random.default_rng(1)
    doc, key = rnd.integers(0, 40, 400), rnd.integers(0, 30, 400)
    x, y = rnd.integers(0, 42, 300), rnd.integers(0, 42, 300)  # 40 and 41 have none
    bags = [Counter(key[doc == d].tolist()) for d in range(42)]
    step, PC.STEP = PC.STEP, 7
    try:
        both, size = PC.shared_counts(doc, key, 42, x, y)
        assert both.tolist() == [(bags[a] & bags[b]).total() for a, b in zip(x, y)] and size.tolist() == [b.total() for b in bags]
        at = np.array([(d, k, n) for d, b in enumerate(bags) for k, n in b.items()])
        dot, square = PC.products(at[:, 0], at[:, 1], at[:, 2], 42, x, y)
        assert dot.tolist() == [sum(n * bags[b][k] for k, n in bags[a].items()) for a, b in zip(x, y)]
        assert square.tolist() == [sum(n * n for n in b.values()) for b in bags]
        none = np.zeros(0, np.int64)
        assert PC.shared_counts(none, none, 1, np.zeros(2, np.int64), np.zeros(2, np.int64))[0].tolist() == [0, 0]
    finally:
        PC.STEP = step
    cells = np.sort(rnd.integers(0, 9, 100))
    for n in (1, 7, 30, 100):
        batches = [(pa.array(cells[k:k + n]), pa.array(np.arange(100)[k:k + n])) for k in range(0, 100, n)]
        got = list(PC._whole_cells(iter(batches)))
        assert [v for _, c in got for v in c.to_pylist()] == list(range(100))
        ends = [(c[0][0].as_py(), c[0][-1].as_py()) for c in got]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
