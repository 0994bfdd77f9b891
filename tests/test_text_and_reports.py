"""X2, X6–X8, X15–X24, A8, A14, A15 — Python reference semantics as brute force."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codescope.functions import lint as LN
from codescope.functions import report as RP
from codescope.functions import text as TX

ALPHABET = st.sampled_from(list("ab #;\t \n\r\x0b\x0c\x1c\x1d\x1e\x85  \xa0é"))


def _one(spark, col_expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col_expr).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_splitlines_and_counts_match_python(spark, s):
    df = spark.createDataFrame([(s,)], "t string")
    r = df.select(TX.split_lines(F.col("t")).alias("l"), TX.nonblank_line_count(F.col("t")).alias("nb"),
                  TX.normalize_code(F.col("t")).alias("norm"), TX.word_count(F.col("t")).alias("w")).first()
    assert list(r["l"]) == s.splitlines()
    assert r["nb"] == len([x for x in s.splitlines() if x.strip()])
    lines = [x.split("#", 1)[0].rstrip() for x in s.splitlines()]
    assert r["norm"] == "\n".join(x for x in lines if x.strip())
    assert r["w"] == len(s.split())


def test_extract_code(spark):
    assert _one(spark, TX.extract_code(F.col("t")), "Here:\n```python\ndef f():\n    pass\n```\nbye") == "def f():\n    pass"
    assert _one(spark, TX.extract_code(F.col("t")), "  just text  ") == "just text"
    two = "```\nfirst\n```\n```py\nsecond\n```"
    assert _one(spark, TX.extract_code(F.col("t")), two) == "first"


def test_truncate_output(spark):
    long = "x" * 64001
    got = _one(spark, TX.truncate_output(F.col("t")), long)
    assert got == "x" * 64000 + "\n... [truncated: output exceeded 64KB]"
    assert _one(spark, TX.truncate_output(F.col("t")), "short") == "short"


def test_name_buckets(spark):
    df = spark.createDataFrame([(n,) for n in ["gpt-4", "gpt-4o-mini", "llama-3-70b", "gemma-7b", "claude-3"]], "t string")
    assert [r[0] for r in df.select(TX.name_bucket(F.col("t"))).collect()] == [2, 3, 5, 3, 4]


def test_token_profile(spark):
    code = "def f(x):  # hi\n    return 'a\\'b' + 12.5 + x1 + 3\n"
    r = _one(spark, TX.token_profile(F.col("t")), code)
    assert (r["comments"], r["strings"], r["numbers"], r["keywords"]) == (1, 1, 2, 2)
    assert r["names"] == 3   # f, x, x1


def test_lint_rules(spark):
    code = "import os\ndef f():\n\treturn 1; \n" + "y = '" + "z" * 120 + "'\n   \n"
    r = _one(spark, LN.lint_counts(F.col("t")), code)
    assert (r["E501"], r["W291"], r["W293"], r["W191"], r["E302"], r["E702"], r["W292"], r["W391"]) == \
        (1, 1, 1, 1, 1, 1, 0, 1)
    r2 = _one(spark, LN.lint_counts(F.col("t")), "x = 1")
    assert r2["W292"] == 1 and r2["W391"] == 0


def test_style_score_floor(spark):
    df = spark.createDataFrame([(5.0, 0.0), (0.0, 1.0), (0.1, 0.5)], "d double, c double")
    got = [r[0] for r in df.select(LN.style_score(F.col("d"), F.col("c"))).collect()]
    assert got == [0.21, 1.0, round(0.9 * 0.7 + 0.15, 4)]


REPORT_SCHEMA = "report string, stdout string, stderr string, timed_out boolean, wall double"


def _report(spark, *rows):
    df = spark.createDataFrame(list(rows), REPORT_SCHEMA)
    x = RP.parse_report(F.col("report"), F.col("stdout"), F.col("stderr"), F.col("timed_out"), F.col("wall"))
    return df.select(x.alias("x")).select("x.*").collect()


def test_report_parsing(spark):
    ok, half, tmo, syn = _report(
        spark,
        (json.dumps({"summary": {"total": 3, "passed": 3}, "duration": 0.5}), "", "", False, 1.0),
        (json.dumps({"summary": {"total": 4, "passed": 2}}), "", "Traceback ...", False, 1.5),
        (None, "", "", True, 10.0),
        (None, "", "SyntaxError: bad", False, 0.2))
    assert (ok["pass_rate"], ok["error_type"], ok["runtime_seconds"]) == (1.0, None, 0.5)
    assert (half["pass_rate"], half["error_type"], half["runtime_seconds"]) == (0.5, "exception", 1.5)
    assert (tmo["pass_rate"], tmo["error_type"], tmo["total_tests"], tmo["runtime_seconds"]) == (0.0, "timeout", 0, 10.0)
    assert (syn["total_tests"], syn["error_type"], syn["report_missing"]) == (0, "syntax_error", True)
    zero = _report(spark, (json.dumps({"summary": {"total": 0, "passed": 0}}), "", "", False, 1.0))[0]
    assert (zero["pass_rate"], zero["error_type"], zero["report_missing"]) == (0.0, None, False)


def test_classify_error_order(spark):
    df = spark.createDataFrame([("SyntaxError", True), ("", False), ("MemoryError x", False),
                                ("sandbox infrastructure error", False)], "e string, t boolean")
    got = [r[0] for r in df.select(RP.classify_error(F.col("e"), F.col("t"))).collect()]
    assert got == ["timeout", None, "memory_error", None]


def test_render_harness(spark):
    df = spark.createDataFrame(
        [(1, [("add(1, 2)", "3"), ("add(-1, 1)", "0")]), (2, [("greet('Ada')", '"Hello, Ada"'), ("ok()", "true")])],
        "prompt_id int, reference_tests array<struct<call:string, expected_output:string>>")
    out = {r["prompt_id"]: r["test_file"] for r in RP.render_test_functions(df).collect()}
    assert "def test_case_0():\n    assert add(1, 2) == 3\n" in out[1]
    assert "def test_case_1():\n    assert add(-1, 1) == 0\n" in out[1]
    assert "assert greet('Ada') == 'Hello, Ada'" in out[2] and "assert ok() == True" in out[2]
    assert out[1].index("test_case_0") < out[1].index("test_case_1")


def test_pass_rate_from_tests(spark):
    sols = spark.createDataFrame([(1,), (2,)], "solution_id long")
    tests = spark.createDataFrame([(1, True), (1, False), (1, True)], "solution_id long, passed boolean")
    got = {r["solution_id"]: (r["passed_tests"], r["total_tests"], r["pass_rate"])
           for r in RP.pass_rate_from_tests(sols, tests).collect()}
    assert got[1] == (2, 3, pytest.approx(2 / 3)) and got[2] == (0, 0, 0.0)


def test_malformed_report_is_missing(spark):
    from codescope.functions.report import parse_report
    df = spark.createDataFrame([("{bad", "Traceback (most recent call last)", False), ("{}", "", False), (None, "", True)],
                               "report string, stderr string, timed_out boolean")
    got = [r["x"] for r in df.select(parse_report(F.col("report"), F.lit(""), F.col("stderr"), F.col("timed_out"),
                                                  F.lit(2.5)).alias("x")).collect()]
    assert (got[0]["report_missing"], got[0]["error_type"], got[0]["runtime_seconds"]) == (True, "exception", 2.5)
    assert (got[1]["report_missing"], got[1]["error_type"]) == (False, None)
    assert (got[2]["report_missing"], got[2]["error_type"]) == (True, "timeout")


def test_text_outputs_of_a_problem_file_render(spark, tmp_path):
    """S1 feeding X22: text, number, boolean, list and missing outputs."""
    import json

    from codescope.functions.report import HARNESS_HEADER, render_test_functions
    from codescope.schema import PROBLEM_FILE
    out = ["olleh", 3, True, [1, "a"], None, "it's"]
    problems = [{"title": "t", "problem_statement": "p", "reference_tests": [{"call": f"f({i})", "expected_output": v} for i, v in enumerate(out)]}]
    (tmp_path / "p.json").write_text(json.dumps(problems))
    df = spark.read.schema(PROBLEM_FILE).option("multiLine", True).json(str(tmp_path / "p.json")).withColumn("prompt_id", F.lit(1))
    (row,) = render_test_functions(df).collect()
    names = {}
    exec("def f(i):\n    return " + repr(out) + "[i]\n" + row.test_file.removeprefix(HARNESS_HEADER), names)
    for i in range(len(out)):
        names[f"test_case_{i}"]()


def test_line_counts_split_and_match_python(spark):
    """Odd separators, empty and missing texts; lines are counted on a split, not by matches of a pattern."""
    from codescope.functions.text import line_count, nonblank_line_count
    texts = ["", "\n", "a\r\nb\r", " \n\x85  x ", "\r\n\r\n", "\n\r", "a\x1cb\x1d\x1e\x0b\x0c ", "   a", "x", "　\n ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_count(F.col("t")).alias("n"), nonblank_line_count(F.col("t")).alias("k"))
    for t, n, k in df.collect():
        lines = None if t is None else t.splitlines()
        assert (n, k) == ((None, None) if t is None else (len(lines), sum(bool(x.strip()) for x in lines)))
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
