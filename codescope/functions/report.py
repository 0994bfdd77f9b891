"""Execution-report functions: X19 report parsing, X20 error classes, A8 pass
rate, X22 test-harness rendering. All JVM-side except the JSON-literal →
Python-literal rendering, which is a small Arrow UDF over test cases.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescope.schema import TEST_REPORT

# ---- fixed values: error classes and their trigger substrings (case-sensitive) ----
ERROR_TIMEOUT = "timeout"
ERROR_SYNTAX = ("SyntaxError", "syntax_error")
ERROR_MEMORY = ("MemoryError", "memory_error")
ERROR_EXCEPTION_MARKERS = ("Traceback", "Error")
ERROR_EXCEPTION = "exception"
# ------------------------------------------------------------------------------------

HARNESS_HEADER = ('"""Generated test harness."""\n'
                  "import json\nfrom solution import *  # noqa: F401,F403\n\n")


def classify_error(stderr: Column, timed_out: Column) -> Column:
    """Timeout > syntax_error > memory_error > exception > NULL."""
    err = F.coalesce(stderr, F.lit(""))
    return (F.when(timed_out.eqNullSafe(True), F.lit(ERROR_TIMEOUT))
             .when(err.contains(ERROR_SYNTAX[0]), F.lit(ERROR_SYNTAX[1]))
             .when(err.contains(ERROR_MEMORY[0]), F.lit(ERROR_MEMORY[1]))
             .when(err.contains(ERROR_EXCEPTION_MARKERS[0]) | err.contains(ERROR_EXCEPTION_MARKERS[1]),
                   F.lit(ERROR_EXCEPTION)))


def parse_report(report_json: Column, stdout: Column, stderr: Column, timed_out: Column,
                 wall_time: Column) -> Column:
    """A struct matching the execution row.

    Timeout, missing or malformed report → zeros and runtime = wall time; otherwise
    counts from the report summary, runtime = duration or wall time, error
    NULL when passed = total. ``report_missing`` tells 0-of-0 rows apart.
    """
    rep = F.from_json(report_json, TEST_REPORT)
    # text that is no JSON is a missing report, too (permissive parsing would read it as 0 of 0, passed)
    missing = timed_out.eqNullSafe(True) | F.try_parse_json(report_json).isNull()
    total = F.coalesce(rep["summary"]["total"], F.lit(0))
    passed = F.coalesce(rep["summary"]["passed"], F.lit(0))
    rate = F.coalesce(F.try_divide(passed.cast("double"), total.cast("double")), F.lit(0.0))
    return F.struct(
        F.when(missing, F.lit(0)).otherwise(passed).alias("passed_tests"),
        F.when(missing, F.lit(0)).otherwise(total).alias("total_tests"),
        F.when(missing, F.lit(0.0)).otherwise(rate).alias("pass_rate"),
        F.when(missing, wall_time).otherwise(F.coalesce(rep["duration"], wall_time)).alias("runtime_seconds"),
        F.lit(None).cast("double").alias("memory_mb"),
        stdout.alias("stdout"), stderr.alias("stderr"),
        F.when(missing, classify_error(stderr, timed_out))
         .when(passed == total, F.lit(None).cast("string"))
         .otherwise(classify_error(stderr, timed_out)).alias("error_type"),
        missing.alias("report_missing"),
    )


def pass_rate_from_tests(solutions: DataFrame, tests: DataFrame) -> DataFrame:
    """A8 from test-level rows (solution_id, passed): passed/total, 0.0 with no tests.

    The test rows are pre-aggregated per solution (partial aggregation), then
    left-joined to the solution keys so untested solutions get 0 of 0.
    """
    per = tests.groupBy("solution_id").agg(F.count_if("passed").alias("passed_tests"),
                                            F.count(F.lit(1)).alias("total_tests"))
    out = solutions.join(per, "solution_id", "left")
    p = F.coalesce(F.col("passed_tests"), F.lit(0))
    t = F.coalesce(F.col("total_tests"), F.lit(0))
    return out.select("solution_id", p.alias("passed_tests"), t.alias("total_tests"),
                      F.coalesce(F.try_divide(p.cast("double"), t.cast("double")), F.lit(0.0)).alias("pass_rate"))


def _py_literal(value_json: str | None) -> str:
    if value_json is None:
        return "None"
    try:
        return repr(json.loads(value_json))
    except ValueError:  # a problem file's text output arrives without its quotes
        return repr(value_json)


@F.pandas_udf(T.StringType())
def json_to_python_literal(values: pd.Series) -> pd.Series:
    """JSON text → Python literal text (``true`` → ``True``, lists, strings quoted)."""
    return values.map(_py_literal)


def render_test_functions(prompts: DataFrame, id_col: str = "prompt_id",
                          tests_col: str = "reference_tests") -> DataFrame:
    """One ``test_case_i`` function per case (i from 0), joined per prompt.

    Cases are exploded with their position, rendered by ``format_string`` and
    re-assembled in order with ``array_sort`` on (position, text) — the
    per-prompt list is bounded by that prompt's own test cases.
    """
    cases = prompts.select(id_col, F.posexplode(tests_col).alias("i", "case"))
    rendered = cases.select(
        id_col, "i",
        F.format_string("def test_case_%d():\n    assert %s == %s\n", F.col("i"), F.col("case.call"),
                        json_to_python_literal(F.col("case.expected_output"))).alias("fn"))
    grouped = rendered.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "fn"))).alias("fns"))
    return grouped.select(id_col, F.concat(F.lit(HARNESS_HEADER),
                                           F.array_join(F.transform("fns", lambda s: s["fn"]), "\n\n"),
                                           F.lit("\n"))
                          .alias("test_file"))
