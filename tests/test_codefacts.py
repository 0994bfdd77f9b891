"""X1, A9–A13, X3, A15 on the reference's test sources (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from codescope.operators.codefacts import code_facts, node_counts_map, node_table, parse_facts, source_facts
from codescope.plans.corpus import CODE_TEMPLATES

SOURCES = [t.replace("_KEY", "") for t in CODE_TEMPLATES]
# nodes, depth, functions, loops, nesting, ifs, recursive, Big-O, lines, coverage, mean cyclomatic
EXPECTED = [
    (12, 6, 1, 0, 0, 0, False, "O(1)", 2, 0.0, 1.0),
    (14, 6, 1, 0, 0, 0, False, "O(1)", 3, 1.0, 1.0),
    (22, 6, 1, 1, 1, 0, False, "O(n)", 5, 0.0, 2.0),
    (28, 8, 1, 0, 0, 1, True, "O(2^n)", 4, 0.0, 2.0),
    (32, 8, 1, 0, 0, 1, True, "O(2^n)", 4, 0.0, 2.0),
    (15, 6, 1, 2, 2, 0, False, "O(n^2)", 4, 0.0, 3.0),
    (8, 4, 0, 0, 0, 0, False, "O(1)", 1, 1.0, 1.0),
    (0, 0, 0, 0, 0, 0, False, "unknown", 2, 0.0, None),
]


@pytest.fixture(scope="module")
def facts(spark):
    df = spark.createDataFrame(list(enumerate(SOURCES)), "solution_id long, code string")
    return {r["solution_id"]: r for r in code_facts(df).collect()}


@pytest.mark.parametrize("i", range(8))
def test_template_facts(facts, i):
    r = facts[i]
    nodes, depth, funcs, loops, nest, ifs, rec, big_o, lines, cov, cc = EXPECTED[i]
    assert (r["n_nodes"], r["max_depth"], r["function_count"], r["loop_count"],
            r["loop_nesting_depth"], r["branch_count"]) == (nodes, depth, funcs, loops, nest, ifs)
    assert r["recursion_detected"] is rec
    assert r["big_o_estimate"] == big_o
    assert r["lines_of_code"] == lines
    assert r["docstring_coverage"] == cov
    assert r["cyclomatic_complexity"] == cc
    assert (r["parse_error"] is not None) == (i == 7)


def test_histograms(spark):
    df = spark.createDataFrame([(0, SOURCES[0]), (2, SOURCES[2]), (3, SOURCES[3]), (7, SOURCES[7])],
                               "solution_id long, code string")
    maps = {r["solution_id"]: dict(r["node_counts"]) for r in node_counts_map(source_facts(df)).collect()}
    assert maps[0] == {"Add": 1, "BinOp": 1, "FunctionDef": 1, "Load": 2, "Module": 1, "Name": 2,
                       "Return": 1, "arg": 2, "arguments": 1}
    assert maps[2] == {"Add": 1, "Assign": 1, "AugAssign": 1, "Constant": 1, "For": 1, "FunctionDef": 1,
                       "Load": 3, "Module": 1, "Name": 6, "Return": 1, "Store": 3, "arg": 1, "arguments": 1}
    assert maps[3] == {"Add": 1, "BinOp": 1, "Call": 1, "Constant": 3, "FunctionDef": 1, "If": 1, "Load": 6,
                       "Module": 1, "Name": 4, "Not": 1, "Return": 2, "Slice": 1, "Subscript": 2, "UnaryOp": 1,
                       "arg": 1, "arguments": 1}
    assert maps[7] == {}   # unparsable: no histogram


def test_recursion_rules():
    # helper call counts as recursion (plain-name call to a function defined here); attribute calls do not
    helper = "def a():\n    return b()\ndef b():\n    return 1\n"
    attr = "def a(x):\n    return x.a()\n"
    assert any(r[-6] for r in parse_facts(helper) if r[-6] is not None)
    assert not any(r[-6] for r in parse_facts(attr) if r[-6] is not None)


def test_parse_never_raises():
    for bad in ["def (", "\x00", "(" * 5000 + ")" * 5000, None]:
        rows = parse_facts(bad)
        assert len(rows) >= 1
    assert parse_facts("def (")[0][-1].startswith("SyntaxError")


def test_long_expression_is_a_row_not_a_failed_job(spark):
    long = "x = " + "+".join(["a"] * 2000)
    deep = "x = " + "(" * 60 + "a" + ")" * 60
    df = spark.createDataFrame([(1, long), (2, deep), (3, "def ("), (4, "y = 1")], "solution_id long, code string")
    got = {r["solution_id"]: r for r in code_facts(df).collect()}
    assert set(got) == {1, 2, 3, 4} and got[3]["parse_error"] is not None
    assert all(got[i]["parse_error"] is None for i in (2, 4))
    assert got[1]["n_nodes"] > 4000 or got[1]["parse_error"] is not None
    assert node_table(df).where("solution_id = 4").count() == got[4]["n_nodes"]


def test_a_failure_after_the_parse_leaves_one_error_row(monkeypatch):
    from codescope.operators import codefacts

    def broken(node, ids):
        raise RecursionError("too deep")

    monkeypatch.setattr(codefacts, "_halstead", broken)
    rows = parse_facts("y = 1\nx = a + b\n")
    assert len(rows) == 1 and rows[0][-1].startswith("RecursionError")


def test_node_batches_are_bounded(spark, monkeypatch):
    from codescope.operators import codefacts
    monkeypatch.setattr(codefacts, "OUT_ROWS", 10)
    df = spark.createDataFrame([(i, SOURCES[i % 8]) for i in range(40)], "solution_id long, code string")
    n = {r["solution_id"]: r["n"] for r in node_table(df).groupBy("solution_id").agg(F.count("node_type").alias("n")).collect()}
    assert n == {i: EXPECTED[i % 8][0] for i in range(40)}


RICH = [
    "class K(Base):\n    \"\"\"Doc.\"\"\"\n    def a(self):\n        try:\n            return 1\n        except ValueError:\n            pass\n        else:\n            assert 1\n",
    "async def g(xs):\n    async for x in xs:\n        if x > 0 and x < 9 or not x:\n            yield x\n        elif x == 4:\n            pass\n    else:\n        pass\n",
    "def outer(n):\n    def inner(m):\n        return [i * 2 for i in m if i if i > 1]\n    while n:\n        n -= 1\n    else:\n        n = -n\n    return inner(n) if n else {k: v for k, v in n}\n",
    "x = 1\nx += x ** 2\ny = x if x != 1 else ~x\n",
]


@pytest.mark.parametrize("i", range(len(RICH)))
def test_rich_sources_match_a_direct_walk(spark, i):
    """Classes, try, comprehensions, boolean operators, elif, async, loop else, nested functions: against the oracle's walk."""
    from codescope.plans import oracle, oracle_code
    r = code_facts(spark.createDataFrame([(1, RICH[i])], "solution_id long, code string")).first()
    f = oracle._template_facts(RICH[i])
    assert (r["n_nodes"], r["max_depth"], r["function_count"], r["loop_count"], r["loop_nesting_depth"], r["branch_count"]) == (
        f["nodes"], f["depth"], f["funcs"], f["loops"], f["nest"], f["ifs"])
    assert r["recursion_detected"] is f["rec"] and r["docstring_coverage"] == f["cov"]
    assert r["cyclomatic_complexity"] == pytest.approx(f["cc"])
    assert r["maintainability_index"] == pytest.approx(oracle_code._maintainability(RICH[i]))


def test_cyclomatic_and_maintainability(spark):
    code = ("class K:\n    def m(self, x):\n        if x and x > 1 or x < -1:\n            return [i for i in x if i]\n"
            "        for i in x:\n            pass\n        else:\n            pass\n        return 0\n")
    df = spark.createDataFrame([(1, code)], "solution_id long, code string")
    r = code_facts(df).first()
    # blocks: class K (1) and method m (1 + if + boolop(2 extra) + comprehension(1+1 if) + for + for-else)
    assert r["cyclomatic_complexity"] == pytest.approx((1 + 1 + 1 + 2 + 2 + 2) / 2)
    assert 0.0 <= r["maintainability_index"] <= 100.0


def test_deep_nesting_loop_depth(spark):
    code = "def f(a):\n    for x in a:\n        for y in x:\n            for z in y:\n                while z:\n                    z -= 1\n"
    r = code_facts(spark.createDataFrame([(1, code)], "solution_id long, code string")).first()
    assert (r["loop_count"], r["loop_nesting_depth"], r["big_o_estimate"]) == (4, 4, "O(n^3)")


def test_ast_udtf_lateral(spark):
    from codescope.operators.codefacts import register_ast_udtf
    register_ast_udtf(spark)
    spark.createDataFrame(list(enumerate(SOURCES)), "solution_id long, code string").createOrReplaceTempView("srcs")
    got = {r["solution_id"]: r["n"] for r in spark.sql(
        "SELECT s.solution_id, count(n.node_type) AS n FROM srcs s, LATERAL ast_nodes(s.code) n "
        "GROUP BY s.solution_id").collect()}
    assert [got[i] for i in range(8)] == [e[0] for e in EXPECTED]


def test_totals_are_the_sums_of_node_types(spark):
    """Summed where the source is parsed: no histogram reaches the JVM, and the metrics have no aggregate over one."""
    from codescope.operators import codefacts as CF
    sources = CODE_TEMPLATES + ["", None, "class A:\n    async def f(self):\n        'doc'\n        return [x for x in y if x and z]\n", "while a < b:\n    a += 1 + 2 * b\n"]
    df = spark.createDataFrame(list(enumerate(sources)), "solution_id int, code string")
    facts = {r.solution_id: r for r in CF.source_facts(df).collect()}
    totals = CF.source_totals(df).collect()
    assert len(totals) == len(facts) == len(sources)
    for r in totals:
        types = facts[r.solution_id].types
        assert r.parse_error == facts[r.solution_id].parse_error
        for name, (field, *kinds) in CF.TOTALS.items():
            assert r[name] == sum(t[field] for t in types if not kinds or t.node_type in kinds)
        for name, field in CF.HIGHEST.items():
            assert r[name] == max([t[field] for t in types], default=0)
    assert "types" not in CF.code_facts(df)._jdf.queryExecution().optimizedPlan().toString()
