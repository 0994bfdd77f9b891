"""DuckDB oracles of the text layer."""

from __future__ import annotations

from codescope.functions import generation as GEN
from codescope.functions import lint as LINT
from codescope.functions import text as TXT
from codescope.functions.report import HARNESS_HEADER
from codescope.plans.oracle import (
    CODE_SOL, PROMPTS, _plan_sql, sql, sql_code, sql_lines, template_values,
)

RESP = ("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Here is the solution:' || chr(10) || '```python' "
        "|| chr(10) || text || chr(10) || '```' || chr(10) || 'Done.' ELSE text END AS raw_response "
        "FROM conversations WHERE role = 'assistant'")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_nonblank(x: str) -> str:
    return f"regexp_matches({x}, {q(TXT.NONBLANK_RE)})"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {q(TXT.STRIP_RE)}, '', 'g')"


def sql_word_count(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, {q(TXT.WS_RUN_RE)}), lambda w: w <> ''))"


@sql("x2_line_table")
def _x2():
    return (f"SELECT solution_id, CAST(i AS BIGINT) AS line_no, l[i] AS line FROM "
            f"(SELECT solution_id, l, unnest(range(1, len(l) + 1)) AS i FROM "
            f"(SELECT doc_id AS solution_id, {sql_lines('text')} AS l FROM documents))")


@sql("a15_line_counts")
def _a15():
    return (f"SELECT doc_id AS solution_id, CAST(len({sql_lines('text')}) AS BIGINT) AS code_length, "
            f"CAST(len(list_filter({sql_lines('text')}, lambda x: {sql_nonblank('x')})) AS BIGINT) AS lines_of_code "
            "FROM documents")


def sql_normalized(code: str) -> str:
    cut = (f"list_transform({sql_lines(code)}, lambda x: regexp_replace(split_part(x, '#', 1), "
           f"{q(TXT.RSTRIP_RE)}, ''))")
    return f"array_to_string(list_filter({cut}, lambda x: {sql_nonblank('x')}), chr(10))"


@sql("x8_normalize")
def _x8():
    norm = sql_normalized("text")
    return (f"SELECT doc_id AS solution_id, md5({norm}) AS normalized_md5, "
            f"CAST(length({norm}) AS BIGINT) AS normalized_chars FROM documents")


@sql("x15_extract_code")
def _x15():
    fence = q(TXT.FENCE_RE)
    inner = f"regexp_extract(raw_response, {fence}, 1)"
    return (f"SELECT conv_id, turn, CASE WHEN regexp_matches(raw_response, {fence}) "
            f"THEN {sql_strip(inner)} ELSE {sql_strip('raw_response')} END AS code FROM ({RESP})")


@sql("x16_token_estimate")
def _x16():
    return f"SELECT conv_id, turn, CAST({sql_word_count('raw_response')} AS BIGINT) AS tokens_used FROM ({RESP})"


@sql("x17_generation_cost")
def _x17():
    names = "[" + ", ".join(q(m[0]) for m in GEN.SEED_MODELS) + "]"
    seed = "(VALUES " + ", ".join(f"({q(m[0])}, {q(m[1])})" for m in GEN.SEED_MODELS) + ") AS sd(model_name, provider)"
    rates = "(VALUES " + ", ".join(f"({q(n)}, {r!r})" for n, r in GEN.PRICING_PER_1K) + ") AS rt(model_name, rate)"
    free = ", ".join(q(p) for p in GEN.NON_BILLED_PROVIDERS)
    return (f"SELECT g.model_name, CAST(count(*) AS BIGINT) AS n_generations, CAST(sum(tokens) AS BIGINT) AS tokens, "
            f"round(sum(CASE WHEN sd.provider IN ({free}) THEN 0.0 "
            f"ELSE tokens / 1000.0 * coalesce(rt.rate, {GEN.DEFAULT_RATE_PER_1K!r}) END), 6) AS cost_usd "
            f"FROM (SELECT list_extract({names}, CAST(conv_id % 4 + 1 AS INTEGER)) AS model_name, "
            f"{sql_word_count('raw_response')} AS tokens FROM ({RESP})) g "
            f"LEFT JOIN {seed} USING (model_name) LEFT JOIN {rates} USING (model_name) GROUP BY g.model_name")


@sql("x18_sampling_params")
def _x18():
    return (f"SELECT pl.experiment_id, pl.prompt_id, pl.model_name, "
            f"CAST(length({q(GEN.INSTRUCTION_PREFIX)}) + length(p.problem_statement) AS BIGINT) AS prompt_chars, "
            f"round(greatest(CAST((pl.experiment_id % 4) * 0.1 AS DOUBLE), {GEN.MIN_TEMPERATURE!r}), 6) AS temperature, "
            f"(pl.experiment_id % 4) * 0.1 > 0 AS do_sample "
            f"FROM ({_plan_sql()}) pl JOIN ({PROMPTS}) p ON p.id = pl.prompt_id")


REPORTS = """SELECT event_id AS solution_id,
  CASE WHEN event_type = 'error' THEN NULL ELSE
    '{"summary": {"total": ' || (k % 5) || ', "passed": ' || least(k % 3, k % 5) || '}'
    || CASE WHEN k % 4 = 0 THEN '' ELSE ', "duration": ' || value END || '}' END AS report_json,
  '' AS stdout,
  CASE k % 6 WHEN 0 THEN 'Traceback (most recent call last):' || chr(10) || 'ValueError: bad'
    WHEN 1 THEN 'SyntaxError: invalid syntax' WHEN 2 THEN 'MemoryError'
    WHEN 3 THEN 'sandbox infrastructure error' ELSE '' END AS stderr,
  event_type = 'error' AND k % 2 = 0 AS timed_out, value + 0.5 AS wall_time_seconds
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""


def sql_classify(stderr: str, timed_out: str) -> str:
    return (f"CASE WHEN {timed_out} THEN 'timeout' WHEN contains({stderr}, 'SyntaxError') THEN 'syntax_error' "
            f"WHEN contains({stderr}, 'MemoryError') THEN 'memory_error' "
            f"WHEN contains({stderr}, 'Traceback') OR contains({stderr}, 'Error') THEN 'exception' END")


@sql("x19_parse_report")
def _x19():
    return f"""
WITH r AS ({REPORTS}),
p AS (SELECT *, timed_out OR report_json IS NULL AS missing,
        coalesce(CAST(json_extract(report_json, '$.summary.total') AS INTEGER), 0) AS total,
        coalesce(CAST(json_extract(report_json, '$.summary.passed') AS INTEGER), 0) AS passed,
        CAST(json_extract(report_json, '$.duration') AS DOUBLE) AS duration FROM r)
SELECT solution_id,
  CAST(CASE WHEN missing THEN 0 ELSE passed END AS BIGINT) AS passed_tests,
  CAST(CASE WHEN missing THEN 0 ELSE total END AS BIGINT) AS total_tests,
  round(CASE WHEN missing OR total = 0 THEN 0.0 ELSE passed / total END, 6) AS pass_rate,
  round(CASE WHEN missing THEN wall_time_seconds ELSE coalesce(duration, wall_time_seconds) END, 6) AS runtime_seconds,
  CASE WHEN missing THEN {sql_classify('stderr', 'timed_out')} WHEN passed = total THEN NULL
       ELSE {sql_classify('stderr', 'timed_out')} END AS error_type,
  missing AS report_missing
FROM p"""


@sql("x21_truncate_output")
def _x21():
    t = (f"CASE WHEN length(text) > {TXT.OUTPUT_CAP_CHARS} THEN substring(text, 1, {TXT.OUTPUT_CAP_CHARS}) "
         f"|| {q(TXT.OUTPUT_CAP_MARKER)} ELSE text END")
    return f"SELECT doc_id AS solution_id, CAST(length({t}) AS BIGINT) AS chars, md5({t}) AS text_md5 FROM documents"


@sql("x22_render_tests")
def _x22():
    sq = q("'")
    lit = ("CASE i % 4 WHEN 0 THEN CAST(item_id * 10 + i AS VARCHAR) "
           "WHEN 1 THEN CASE WHEN item_id % 2 = 0 THEN 'True' ELSE 'False' END "
           f"WHEN 2 THEN {sq} || 'w' || item_id || {sq} ELSE '[1, ' || item_id || ']' END")
    fn = (f"'def test_case_' || i || '():' || chr(10) || '    assert f_' || item_id || '(' || i || ') == ' "
          f"|| {lit} || chr(10)")
    body = f"{q(HARNESS_HEADER)} || string_agg({fn}, chr(10) || chr(10) ORDER BY i) || chr(10)"
    return (f"SELECT item_id AS prompt_id, md5({body}) AS harness_md5, CAST(length({body}) AS BIGINT) AS chars "
            f"FROM (SELECT item_id, unnest(range(0, item_id % 3 + 1)) AS i FROM benchmark) GROUP BY item_id")


@sql("x23_name_bucket")
def _x23():
    seed = " UNION SELECT ".join(q(m[0]) for m in GEN.SEED_MODELS)
    return (f"SELECT name, CAST(list_reduce(string_split(name, ''), lambda h, c: (h * 31 + unicode(c)) % 4294967296, "
            f"CAST(0 AS BIGINT)) % {TXT.NAME_BUCKETS} AS BIGINT) AS bucket "
            f"FROM (SELECT DISTINCT source AS name FROM documents UNION SELECT {seed})")


@sql("x24_token_profile")
def _x24():
    def grp(i):
        return (f"list_filter(regexp_extract_all(text, {q(TXT.TOKEN_RE_ASCII_B)}, {i}), "
                "lambda s: s IS NOT NULL AND s <> '')")
    kw = "[" + ", ".join(q(k) for k in TXT.PY_KEYWORDS) + "]"
    return (f"SELECT solution_id, CAST(len(g1) AS BIGINT) AS comments, CAST(len(g2) AS BIGINT) AS strings, "
            f"CAST(len(g3) AS BIGINT) AS numbers, CAST(nkw AS BIGINT) AS keywords, "
            f"CAST(len(g4) - nkw AS BIGINT) AS names, CAST(len(g5) AS BIGINT) AS punct FROM ("
            f"SELECT *, len(list_filter(g4, lambda w: list_contains({kw}, w))) AS nkw FROM ("
            f"SELECT doc_id AS solution_id, {grp(1)} AS g1, {grp(2)} AS g2, {grp(3)} AS g3, {grp(4)} AS g4, "
            f"{grp(5)} AS g5 FROM documents))")


LINT_RULES = ["E501", "W291", "W293", "W191", "E302", "E702", "W292", "W391"]


def sql_lint(code: str) -> str:
    """Select-list of the lint rule counts for a code expression (twin of ``lint_counts``)."""
    lines = sql_lines(code)

    def blank(x):
        return f"NOT {sql_nonblank(x)}"

    def cnt(pred):
        return f"CAST(len(list_filter({lines}, lambda x: {pred})) AS BIGINT)"

    e302 = (f"len(list_filter(list_transform({lines}, lambda x, i: i > 1 AND "
            f"regexp_matches(x, {q(LINT.TOP_DEF_RE)}) "
            f"AND NOT regexp_matches({lines}[i - 1], {q(LINT.DECORATOR_RE)}) "
            f"AND NOT (i >= 3 AND {blank(f'{lines}[i - 1]')} AND {blank(f'{lines}[i - 2]')})), lambda v: v))")
    trail = f"{sql_nonblank('x')} AND regexp_matches(x, {q(LINT.TRAIL_WS_RE)})"
    semi = f"contains(split_part(x, {q('#')}, 1), {q(';')})"
    return ", ".join([
        f"{cnt(f'length(x) > {LINT.MAX_LINE_LENGTH}')} AS E501",
        f"{cnt(trail)} AS W291",
        f"{cnt(blank('x') + ' AND length(x) > 0')} AS W293",
        f"{cnt('regexp_matches(x, ' + q(LINT.TAB_INDENT_RE) + ')')} AS W191",
        f"CAST({e302} AS BIGINT) AS E302",
        f"{cnt(semi)} AS E702",
        f"CAST(CASE WHEN length({code}) > 0 AND NOT ends_with({code}, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS W292",
        f"CAST(CASE WHEN len({lines}) > 0 AND {blank(f'{lines}[-1]')} THEN 1 ELSE 0 END AS BIGINT) AS W391",
    ])


@sql("a14_lint")
def _a14():
    total = " + ".join(LINT_RULES)
    return (f"SELECT * EXCLUDE (nb), CAST({total} AS BIGINT) AS violations, "
            f"round(({total}) / greatest(nb, 1), 6) AS density "
            f"FROM (SELECT doc_id AS solution_id, {sql_lint('text')}, "
            f"len(list_filter({sql_lines('text')}, lambda x: {sql_nonblank('x')})) AS nb FROM documents)")


@sql("x7_style_score")
def _x7():
    total = " + ".join(LINT_RULES) + " + CASE WHEN NOT ok THEN 1 ELSE 0 END"
    code = sql_code("solution_id")
    score = (f"round(greatest(0.0, 1 - least(({total}) / greatest(nb, 1), {LINT.DENSITY_CAP})) * {LINT.STYLE_WEIGHT} "
             f"+ cov * {LINT.COVERAGE_WEIGHT}, 4)")
    return (f"SELECT solution_id, CAST({total} AS BIGINT) AS pep8_violations, round(cov, 6) AS docstring_coverage, "
            f"round({score}, 6) AS style_score FROM ("
            f"SELECT solution_id, tv.ok, tv.cov, {sql_lint(code)}, "
            f"len(list_filter({sql_lines(code)}, lambda x: {sql_nonblank('x')})) AS nb "
            f"FROM ({CODE_SOL}) LEFT JOIN {template_values()} USING (tmpl))")
