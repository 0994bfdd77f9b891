"""DuckDB oracle SQL for every registered query (tables pre-registered as views).

Where DuckDB cannot compute a fact (Python AST facts of the code templates,
t critical values), the SQL joins a small VALUES table that is built here by
independent brute force: stdlib ``ast`` straight over the eight template
sources, and the t quantile by bisection on the tail integral.
"""

from __future__ import annotations

import ast
import functools
import math

from codescope.plans.corpus import CODE_TEMPLATES, EXPERIMENT_SIZE, PROMPT_SIZE

ORACLE: dict[str, str] = {}
T_TABLE_MAX_DF = 1000
NONBLANK = None  # set below from the text-function constants


def sql(name: str):
    def deco(fn):
        ORACLE[name] = fn
        return fn
    return deco


# ------------------------------------------------------------- brute-force helpers
def _t_two_sided_numeric(t: float, df: int) -> float:
    """P(|T|>=t) by closed-form series (Abramowitz–Stegun 26.7.3/26.7.4)."""
    theta = math.atan(t / math.sqrt(df))
    c2, s = math.cos(theta) ** 2, math.sin(theta)
    if df % 2 == 1:
        acc, term = 0.0, 1.0
        if df > 1:
            acc = 1.0
            for k in range(1, (df - 3) // 2 + 1):
                term *= c2 * (2 * k) / (2 * k + 1)
                acc += term
            a = (2 / math.pi) * (theta + s * math.cos(theta) * acc)
        else:
            a = 2 * theta / math.pi
    else:
        acc, term = 1.0, 1.0
        for k in range(1, (df - 2) // 2 + 1):
            term *= c2 * (2 * k - 1) / (2 * k)
            acc += term
        a = s * acc
    return 1.0 - a


@functools.lru_cache(maxsize=None)
def t975_values() -> str:
    rows = []
    for df in range(1, T_TABLE_MAX_DF + 1):
        lo, hi = 0.0, 20.0 if df > 1 else 100.0
        for _ in range(200):
            mid = (lo + hi) / 2
            if _t_two_sided_numeric(mid, df) > 0.05:
                lo = mid
            else:
                hi = mid
        rows.append(f"({df}, {(lo + hi) / 2!r})")
    return "(VALUES " + ", ".join(rows) + ") AS tq(df, t975)"


def t975_sql(n_minus_1: str) -> str:
    """Critical value for df given as SQL; beyond the table a 4-term expansion."""
    z = 1.959963984540054
    cf = (f"({z} + {(z**3 + z) / 4!r}/({n_minus_1}) + {(5*z**5 + 16*z**3 + 3*z) / 96!r}/power({n_minus_1},2)"
          f" + {(3*z**7 + 19*z**5 + 17*z**3 - 15*z) / 384!r}/power({n_minus_1},3)"
          f" + {(79*z**9 + 776*z**7 + 1482*z**5 - 1920*z**3 - 945*z) / 92160!r}/power({n_minus_1},4))")
    return f"COALESCE((SELECT t975 FROM {t975_values()} WHERE tq.df = {n_minus_1}), {cf})"


def _template_facts(src: str) -> dict:
    try:
        tree = ast.parse(src)
    except SyntaxError:
        return {"ok": False}
    nodes = list(ast.walk(tree))
    fnames = {n.name for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    calls = {n.func.id for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}

    def depth(n):
        return 1 + max((depth(c) for c in ast.iter_child_nodes(n)), default=0)

    def loop_nest(n):
        inner = max((loop_nest(c) for c in ast.iter_child_nodes(n)), default=0)
        return inner + (1 if isinstance(n, (ast.For, ast.While)) else 0)

    def block_cc(b):
        total, todo = 1, list(ast.iter_child_nodes(b))
        while todo:
            n = todo.pop()
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(n, (ast.If, ast.IfExp, ast.Assert, ast.ExceptHandler)):
                total += 1
            elif isinstance(n, (ast.For, ast.AsyncFor, ast.While)):
                total += 1 + bool(n.orelse)
            elif isinstance(n, ast.Try):
                total += bool(n.orelse)
            elif isinstance(n, ast.comprehension):
                total += 1 + len(n.ifs)
            elif isinstance(n, ast.BoolOp):
                total += len(n.values) - 1
            todo.extend(ast.iter_child_nodes(n))
        return total

    blocks = [n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    fns = [n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return {
        "ok": True,
        "cov": (sum(bool(ast.get_docstring(f)) for f in fns) / len(fns)) if fns else 1.0,
        "cc": (sum(block_cc(b) for b in blocks) / len(blocks)) if blocks else 1.0,
        "loops": sum(isinstance(n, (ast.For, ast.While)) for n in nodes),
        "nest": loop_nest(tree), "rec": bool(fnames & calls), "depth": depth(tree),
        "funcs": sum(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for n in nodes),
        "ifs": sum(isinstance(n, ast.If) for n in nodes), "nodes": len(nodes),
    }


def _big_o(f: dict) -> str:
    if not f["ok"]:
        return "unknown"
    if f["rec"]:
        return "O(2^n)" if f["loops"] == 0 else "O(n log n)"
    if f["loops"] == 0:
        return "O(1)"
    return "O(n^3)" if f["nest"] >= 3 else "O(n^2)" if f["nest"] == 2 else "O(n)"


def template_big_o_values() -> str:
    rows = []
    for i, t in enumerate(CODE_TEMPLATES):
        src = t.replace("KEY", "1")
        rows.append(f"({i}, '{_big_o(_template_facts(src))}')")
    return "(VALUES " + ", ".join(rows) + ") AS tb(tmpl, big_o)"


# Shared CTE fragments mirroring codescope.plans.corpus
CODE_SOL = (f"SELECT o_orderkey AS solution_id, o_orderkey // {PROMPT_SIZE} AS prompt_id, "
            f"o_orderkey // {EXPERIMENT_SIZE} AS experiment_id, o_orderpriority AS model, "
            f"o_orderdate AS created_at, o_orderkey % 8 AS tmpl FROM orders")
EXEC = ("SELECT l.doc_id AS solution_id, l.quality AS passed_tests, 1 AS total_tests, "
        "CAST(l.quality AS DOUBLE) AS pass_rate, e.value AS runtime_seconds, e.ts AS executed_at "
        "FROM labels l LEFT JOIN events e ON e.event_id = l.doc_id")


def _leaderboard_sql(keys: list[str]) -> str:
    k = "".join(f"{c}, " for c in keys)
    on = " AND ".join(f"mo.{c} = ci.{c}" for c in [*keys, "model"])
    part = f"PARTITION BY {', '.join('ci.' + c for c in keys)} " if keys else ""
    return f"""
WITH sol AS ({CODE_SOL}),
exe AS ({EXEC}),
facts AS (
  SELECT {''.join('s.' + c + ', ' for c in keys)}s.solution_id, s.model, x.pass_rate, x.runtime_seconds, tb.big_o
  FROM sol s LEFT JOIN exe x USING (solution_id) LEFT JOIN {template_big_o_values()} USING (tmpl)),
modes AS (
  SELECT {k}model, big_o,
         row_number() OVER (PARTITION BY {k}model ORDER BY count(*) DESC, big_o) AS rk
  FROM facts WHERE big_o IS NOT NULL AND big_o <> '' GROUP BY {k}model, big_o),
agg AS (
  SELECT {k}model, avg(pass_rate) AS m, stddev_samp(pass_rate) AS sd, count(pass_rate) AS n,
         avg(runtime_seconds) AS avg_runtime_s, count(*) AS n_solutions, min(solution_id) AS first_seen
  FROM facts GROUP BY {k}model),
ci AS (
  SELECT a.*, CASE WHEN n >= 2 THEN {t975_sql('a.n - 1')} * sd / sqrt(n) END AS margin FROM agg a)
SELECT {''.join('ci.' + c + ', ' for c in keys)}ci.model,
       round(m, 6) AS correctness,
       round(CASE WHEN n = 1 THEN m WHEN n >= 2 THEN m - margin END, 6) AS correctness_ci_low,
       round(CASE WHEN n = 1 THEN m WHEN n >= 2 THEN m + margin END, 6) AS correctness_ci_high,
       round(avg_runtime_s, 6) AS avg_runtime_s,
       mo.big_o AS complexity,
       CAST(n_solutions AS BIGINT) AS n_solutions,
       CAST(row_number() OVER ({part}ORDER BY m DESC NULLS LAST, first_seen) AS BIGINT) AS position
FROM ci LEFT JOIN modes mo ON {on} AND mo.rk = 1
"""


@sql("a2_leaderboard")
def _a2():
    return _leaderboard_sql([])


@sql("a2_leaderboard_by_experiment")
def _a2_by_experiment():
    return _leaderboard_sql(["experiment_id"])


# ------------------------------------------------------------------ relational layer
from codescope.functions.text import LINE_SPLIT_RE, NONBLANK_RE  # noqa: E402

NONBLANK = NONBLANK_RE

REG = ("SELECT 'm-' || source AS id, source AS name, min(lang) AS provider, "
       "CAST(NULL AS VARCHAR) AS version, CAST(max(n_chars) AS INTEGER) AS context_window, "
       "CASE WHEN max(n_chars) % 5 = 0 THEN NULL ELSE max(n_chars) % 3 <> 0 END AS is_active "
       "FROM documents GROUP BY source")
EXPS = ("SELECT id, c % 7 AS owner_id, 'exp-' || id AS name, "
        "CASE WHEN id % 4 = 0 THEN 'completed' WHEN id % 4 = 1 THEN 'running' ELSE 'pending' END AS status, "
        "['src' || (id % 20), 'src' || ((id * 7 + 3) % 23)] AS selected_models, created_at, "
        "CASE WHEN id % 4 = 0 THEN last END AS completed_at "
        f"FROM (SELECT o_orderkey // {EXPERIMENT_SIZE} AS id, min(o_custkey) AS c, "
        "min(o_orderdate) AS created_at, max(o_orderdate) AS last FROM orders GROUP BY 1)")
PROMPTS = ("SELECT item_id AS id, item_id // 5 AS experiment_id, text AS problem_statement, "
           "'python' AS language FROM benchmark")
DOC_SOL = (f"SELECT doc_id AS solution_id, doc_id // {PROMPT_SIZE} AS prompt_id, "
           f"doc_id // {EXPERIMENT_SIZE} AS experiment_id, source AS model, 'm-' || source AS model_id, "
           "text AS code FROM documents")
RESULTS = ("SELECT conv_id, turn, conv_id % 40 AS prompt_id, 'src' || (conv_id % 23) AS model_name, "
           "CASE WHEN turn % 3 <> 2 THEN CASE WHEN turn % 2 = 0 THEN "
           "'Here is the solution:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' "
           "|| chr(10) || 'Done.' ELSE text END END AS raw_response, "
           "CASE WHEN turn % 3 = 2 THEN 'provider error' END AS error "
           "FROM conversations WHERE role = 'assistant'")


def sql_lines(expr: str) -> str:
    """Python splitlines() in DuckDB: split on the terminators, drop a trailing ''."""
    parts = f"string_split_regex({expr}, '{LINE_SPLIT_RE}')"
    return (f"(CASE WHEN {parts}[-1] = '' THEN list_slice({parts}, 1, len({parts}) - 1) "
            f"ELSE {parts} END)")


def sql_code(key: str) -> str:
    arr = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in CODE_TEMPLATES) + "]"
    return f"replace(list_extract({arr}, CAST({key} % 8 + 1 AS INTEGER)), 'KEY', CAST({key} AS VARCHAR))"


def template_values() -> str:
    rows = []
    for i, t in enumerate(CODE_TEMPLATES):
        f = _template_facts(t.replace("KEY", "1"))
        cc = "CAST(NULL AS DOUBLE)" if not f["ok"] else f"CAST({f['cc']!r} AS DOUBLE)"
        cov = f"CAST({f['cov']!r} AS DOUBLE)" if f["ok"] else "CAST(0.0 AS DOUBLE)"
        ok = "true" if f["ok"] else "false"
        rows.append(f"({i}, '{_big_o(f)}', {cc}, {ok}, {cov})")
    return "(VALUES " + ", ".join(rows) + ") AS tv(tmpl, big_o, cc, ok, cov)"


@sql("p1_point_lookup")
def _p1():
    return (f"SELECT solution_id, prompt_id, model, CAST(len({sql_lines('code')}) AS BIGINT) AS n_lines "
            f"FROM ({DOC_SOL}) WHERE solution_id = 7 LIMIT 1")


@sql("p2_active_models")
def _p2():
    return f"SELECT id, name, provider, CAST(context_window AS BIGINT) AS context_window FROM ({REG}) WHERE is_active"


@sql("p3_owned_experiments")
def _p3():
    return f"SELECT id, name, status, created_at FROM ({EXPS}) WHERE owner_id = 3"


@sql("p4_solution_summary")
def _p4():
    return (f"SELECT s.solution_id, s.prompt_id, p.problem_statement, r.name AS model_name "
            f"FROM ({DOC_SOL}) s LEFT JOIN ({PROMPTS}) p ON p.id = s.prompt_id "
            f"LEFT JOIN ({REG}) r ON r.id = s.model_id")


@sql("p5_solution_card")
def _p5():
    return (f"SELECT s.solution_id, s.model, x.pass_rate, round(x.runtime_seconds, 6) AS runtime_seconds, "
            f"tv.big_o AS big_o_estimate, "
            f"CAST(len(list_filter({sql_lines(sql_code('s.solution_id'))}, "
            f"lambda l: regexp_matches(l, '{NONBLANK}'))) AS BIGINT) AS lines_of_code "
            f"FROM ({CODE_SOL}) s LEFT JOIN ({EXEC}) x USING (solution_id) "
            f"LEFT JOIN {template_values()} USING (tmpl) WHERE s.solution_id = 3")


@sql("p6_distinct_prompts")
def _p6():
    return (f"WITH f AS (SELECT prompt_id, min(solution_id) AS first_solution_id FROM ({DOC_SOL}) GROUP BY 1) "
            "SELECT prompt_id, first_solution_id, "
            "prompt_id = (SELECT prompt_id FROM f ORDER BY first_solution_id, prompt_id LIMIT 1) AS is_default "
            "FROM f")


@sql("p7_selection_violations")
def _p7():
    return (f"WITH picked AS (SELECT id AS experiment_id, unnest(CASE WHEN len(selected_models) = 0 "
            f"THEN [NULL] ELSE selected_models END) AS model_name FROM ({EXPS})) "
            f"SELECT experiment_id, model_name, CASE WHEN model_name IS NULL THEN 'no_models' "
            f"WHEN r.name IS NULL THEN 'unregistered' WHEN r.is_active IS NOT TRUE THEN 'inactive' END AS reason "
            f"FROM picked LEFT JOIN ({REG}) r ON r.name = picked.model_name "
            f"WHERE model_name IS NULL OR r.name IS NULL OR r.is_active IS NOT TRUE")


@sql("p8_defaults")
def _p8():
    return (f"SELECT solution_id, round(coalesce(tv.cc, 0.0), 6) AS cyclomatic_complexity "
            f"FROM ({CODE_SOL}) LEFT JOIN {template_values()} USING (tmpl)")


@sql("j2_solution_chain")
def _j2():
    return (f"SELECT s.solution_id, s.prompt_id, p.experiment_id AS prompt_experiment_id, e.owner_id, "
            f"r.name AS model_name, x.pass_rate FROM ({DOC_SOL}) s "
            f"LEFT JOIN ({PROMPTS}) p ON p.id = s.prompt_id LEFT JOIN ({EXPS}) e ON e.id = p.experiment_id "
            f"LEFT JOIN ({REG}) r ON r.id = s.model_id LEFT JOIN ({EXEC}) x ON x.solution_id = s.solution_id "
            "WHERE s.solution_id = 123")


def _plan_sql():
    return (f"SELECT p.experiment_id, p.id AS prompt_id, r.id AS model_id, r.name AS model_name "
            f"FROM ({PROMPTS}) p JOIN (SELECT id AS experiment_id, unnest(selected_models) AS name "
            f"FROM ({EXPS})) sel ON sel.experiment_id = p.experiment_id "
            f"JOIN ({REG}) r ON r.name = sel.name AND r.is_active")


@sql("j4_generation_plan")
def _j4():
    return _plan_sql()


@sql("j5_resolve_models")
def _j5():
    return (f"SELECT q.conv_id, q.turn, q.model_name, r.id AS model_id, r.id IS NOT NULL AS resolved "
            f"FROM ({RESULTS}) q LEFT JOIN ({REG}) r ON r.name = q.model_name")


@sql("j6_outcome_gaps")
def _j6():
    return (f"SELECT experiment_id, prompt_id, model_name FROM ({_plan_sql()}) pl "
            f"WHERE NOT EXISTS (SELECT 1 FROM ({RESULTS}) q WHERE q.error IS NULL "
            "AND q.prompt_id = pl.prompt_id AND q.model_name = pl.model_name)")


@sql("e2_selected_registered")
def _e2():
    return (f"SELECT sel.experiment_id, sel.name, r.id AS model_id FROM (SELECT id AS experiment_id, "
            f"unnest(selected_models) AS name FROM ({EXPS})) sel JOIN ({REG}) r "
            "ON r.name = sel.name AND r.is_active")


@sql("e4_all_outcomes")
def _e4():
    return (f"SELECT conv_id, turn, model_name, CAST(length(raw_response) AS BIGINT) AS response_chars, error "
            f"FROM ({RESULTS})")


@sql("o1_list_models")
def _o1():
    return f"SELECT name, provider FROM ({REG}) WHERE is_active ORDER BY name LIMIT 5 OFFSET 2"


@sql("o2_list_experiments")
def _o2():
    return (f"SELECT id, name, created_at FROM ({EXPS}) WHERE owner_id = 3 "
            "ORDER BY created_at DESC, id LIMIT 100 OFFSET 1")


# ------------------------------------------------------------------ statistics layer
def describe_aggs_sql(v: str, p: str) -> str:
    return (f"avg({v}) AS {p}_m, median({v}) AS {p}_med, stddev_samp({v}) AS {p}_sd, "
            f"count({v}) AS {p}_n")


def describe_finish_sql(p: str, out: str) -> str:
    n, m, sd = f"{p}_n", f"{p}_m", f"{p}_sd"
    margin = f"({t975_sql(f'{n} - 1')} * {sd} / sqrt({n}))"
    return (f"round({m}, 6) AS {out}mean, round({p}_med, 6) AS {out}median, "
            f"round(CASE WHEN {n} = 1 THEN 0.0 WHEN {n} >= 2 THEN {sd} END, 6) AS {out}stdev, "
            f"round(CASE WHEN {n} = 1 THEN {m} WHEN {n} >= 2 THEN {m} - {margin} END, 6) AS {out}ci_95_low, "
            f"round(CASE WHEN {n} = 1 THEN {m} WHEN {n} >= 2 THEN {m} + {margin} END, 6) AS {out}ci_95_high, "
            f"CAST({n} AS BIGINT) AS {out}n")


def pvalue_ctes(src: str, keys: list[str], tag: str) -> str:
    """CTEs ``{tag}_pv(keys…, p)``: two-sided p of r with df = n-2 by the finite
    Student-t series (A&S 26.7.3/26.7.4) with theta = asin|r|; ``src`` has keys, n, r."""
    k = ", ".join(keys)
    return f"""
{tag}_b AS (SELECT {k}, n - 2 AS df, abs(r) AS ar FROM {src} WHERE n >= 3 AND abs(r) < 1),
{tag}_k AS (SELECT {k}, df, ar, unnest(range(1, CAST(CASE WHEN df % 2 = 0 THEN (df - 2) // 2
                 ELSE (df - 3) // 2 END AS BIGINT) + 1)) AS k FROM {tag}_b),
{tag}_t AS (SELECT {k}, exp(sum(ln(CASE WHEN df % 2 = 0 THEN (2 * k - 1) / (2.0 * k)
                 ELSE (2.0 * k) / (2 * k + 1) END)) OVER (PARTITION BY {k} ORDER BY k)
                 + k * ln(1 - ar * ar)) AS term FROM {tag}_k),
{tag}_s AS (SELECT {k}, sum(term) AS s FROM {tag}_t GROUP BY {k}),
{tag}_pv AS (SELECT {k}, 1 - CASE WHEN df = 1 THEN 2 * asin(ar) / pi()
                 WHEN df % 2 = 1 THEN (2 / pi()) * (asin(ar) + ar * sqrt(1 - ar * ar) * (1 + coalesce(s, 0)))
                 ELSE ar * (1 + coalesce(s, 0)) END AS p
             FROM {tag}_b LEFT JOIN {tag}_s USING ({k}))"""


def r_sql(r: str, n: str) -> str:
    return f"CASE WHEN {n} >= 3 THEN greatest(-1.0, least(1.0, {r})) END"


def p_sql(r: str, n: str, tag: str) -> str:
    return (f"CASE WHEN {r_sql(r, n)} IS NULL THEN NULL WHEN abs({r_sql(r, n)}) >= 1 THEN 0.0 "
            f"ELSE {tag}_pv.p END")


@sql("a1_describe")
def _a1():
    return (f"SELECT l_returnflag, l_linestatus, {describe_finish_sql('v', '')} FROM ("
            f"SELECT l_returnflag, l_linestatus, {describe_aggs_sql('l_extendedprice', 'v')} "
            "FROM lineitem GROUP BY 1, 2)")


def _corr_sql(keys: list[str], base: str, with_pearson: bool = True) -> str:
    k = ", ".join(keys)
    ranks = (f"SELECT {k}, rank() OVER (PARTITION BY {k} ORDER BY x) "
             f"+ (count(*) OVER (PARTITION BY {k}, x) - 1) / 2.0 AS rx, "
             f"rank() OVER (PARTITION BY {k} ORDER BY y) + (count(*) OVER (PARTITION BY {k}, y) - 1) / 2.0 AS ry "
             "FROM base")
    stats = lambda a, b: f"count(*) AS n, covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) AS r"
    return f"""
WITH base AS ({base}),
pr AS (SELECT {k}, {stats('x', 'y')} FROM base GROUP BY {k}),
rk AS ({ranks}),
sr AS (SELECT {k}, {stats('rx', 'ry')} FROM rk GROUP BY {k}),
{pvalue_ctes('pr', keys, 'ppr')},
{pvalue_ctes('sr', keys, 'psr')}
SELECT {', '.join('pr.' + c for c in keys)},
       {'round(' + r_sql('pr.r', 'pr.n') + ', 6) AS pearson_r, round(' + p_sql('pr.r', 'pr.n', 'ppr') + ', 6) AS pearson_p,' if with_pearson else ''}
       round({r_sql('sr.r', 'sr.n')}, 6) AS spearman_r, round({p_sql('sr.r', 'sr.n', 'psr')}, 6) AS spearman_p,
       CAST(pr.n AS BIGINT) AS n
FROM pr JOIN sr USING ({k}) LEFT JOIN ppr_pv USING ({k}) LEFT JOIN psr_pv USING ({k})"""


@sql("a5_correlation")
def _a5():
    return _corr_sql(["l_returnflag"], "SELECT l_returnflag, l_quantity AS x, l_discount AS y FROM lineitem "
                                       "WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL")


@sql("a6_spearman_overall")
def _a6():
    q = _corr_sql(["g"], "SELECT 1 AS g, l_extendedprice AS x, l_tax AS y FROM lineitem "
                         "WHERE l_extendedprice IS NOT NULL AND l_tax IS NOT NULL", with_pearson=False)
    return f"SELECT spearman_r, spearman_p, n FROM ({q})"


@sql("a4_experiment_summary")
def _a4():
    lines = f"len({sql_lines(sql_code('s.solution_id'))})"
    return f"""
WITH f AS (
  SELECT s.experiment_id, {lines} AS len, x.pass_rate, tv.cc
  FROM ({CODE_SOL}) s LEFT JOIN ({EXEC}) x USING (solution_id) LEFT JOIN {template_values()} USING (tmpl)),
a AS (
  SELECT experiment_id, count(*) AS n_solutions, {describe_aggs_sql('len', 'l')}, {describe_aggs_sql('pass_rate', 'p')},
         {describe_aggs_sql('cc', 'c')},
         count(*) FILTER (WHERE pass_rate IS NOT NULL) AS n,
         covar_pop(len, pass_rate) / (stddev_pop(CASE WHEN pass_rate IS NOT NULL THEN len END) * stddev_pop(pass_rate)) AS r
  FROM f GROUP BY experiment_id),
rk AS (SELECT experiment_id,
    rank() OVER (PARTITION BY experiment_id ORDER BY len) + (count(*) OVER (PARTITION BY experiment_id, len) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY experiment_id ORDER BY pass_rate)
      + (count(*) OVER (PARTITION BY experiment_id, pass_rate) - 1) / 2.0 AS ry
  FROM f WHERE pass_rate IS NOT NULL),
sr AS (SELECT experiment_id, count(*) AS n, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) AS r FROM rk GROUP BY 1),
{pvalue_ctes('a', ['experiment_id'], 'pa')},
{pvalue_ctes('sr', ['experiment_id'], 'ps')}
SELECT experiment_id, CAST(n_solutions AS BIGINT) AS n_solutions,
       {describe_finish_sql('l', 'len_')}, {describe_finish_sql('p', 'pass_')}, {describe_finish_sql('c', 'cc_')},
       CAST(a.n AS BIGINT) AS corr_n, round({r_sql('a.r', 'a.n')}, 6) AS corr_pearson_r,
       round({p_sql('a.r', 'a.n', 'pa')}, 6) AS corr_pearson_p,
       round({r_sql('sr.r', 'sr.n')}, 6) AS corr_spearman_r, round({p_sql('sr.r', 'sr.n', 'ps')}, 6) AS corr_spearman_p
FROM a LEFT JOIN sr USING (experiment_id) LEFT JOIN pa_pv USING (experiment_id) LEFT JOIN ps_pv USING (experiment_id)"""


@sql("a7_class_balance")
def _a7():
    return (f"SELECT experiment_id, CAST(sum(k) AS BIGINT) AS n_samples, CAST(count(*) AS BIGINT) AS n_classes, "
            "round(max(k) / sum(k), 6) AS baseline_accuracy, CAST(least(5, min(k)) AS BIGINT) AS n_folds, "
            "count(*) >= 2 AND least(5, min(k)) >= 2 AS sufficient_data "
            f"FROM (SELECT experiment_id, model, count(*) AS k FROM ({CODE_SOL}) GROUP BY 1, 2) GROUP BY 1")


@sql("a8_pass_rate")
def _a8():
    return ("SELECT o_orderkey AS solution_id, CAST(coalesce(p, 0) AS BIGINT) AS passed_tests, "
            "CAST(coalesce(t, 0) AS BIGINT) AS total_tests, "
            "round(CASE WHEN coalesce(t, 0) = 0 THEN 0.0 ELSE p / t END, 6) AS pass_rate "
            "FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS p, "
            "count(*) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")


@sql("w1_average_rank")
def _w1():
    return ("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, round(l_extendedprice, 6) AS l_extendedprice, "
            "round(rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) "
            "+ (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0, 6) AS avg_rank "
            "FROM lineitem")


@sql("w2_fold_assignment")
def _w2():
    return (f"SELECT solution_id, model, CAST((row_number() OVER (PARTITION BY model ORDER BY md5('42:' || solution_id)) - 1) % 5 "
            f"AS BIGINT) AS fold FROM ({CODE_SOL})")


def oracle_sql() -> dict[str, str]:
    from codescope.plans import oracle_code, oracle_text  # noqa: F401  (register their oracles)
    return {name: fn() for name, fn in ORACLE.items()}
