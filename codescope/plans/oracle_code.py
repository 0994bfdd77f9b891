"""DuckDB oracles of the code-fact layer: per-template facts are computed here
by a direct stdlib-``ast`` walk of the eight template sources and joined to
the orders table by ``o_orderkey % 8`` (the AST cannot be parsed in SQL)."""

from __future__ import annotations

import ast
import math

from codescope.plans.corpus import CODE_TEMPLATES
from codescope.plans.oracle import CODE_SOL, _big_o, _template_facts, sql, sql_code, sql_lines
from codescope.plans.oracle_text import sql_nonblank


def _src(i: int) -> str:
    return CODE_TEMPLATES[i].replace("KEY", "1")


def _preorder(tree):
    """(node_id, parent_id, depth, loop_depth, node) in pre-order, module depth 1."""
    out = []

    def visit(n, parent, depth, loops):
        loops = loops + isinstance(n, (ast.For, ast.While))
        out.append((len(out), parent, depth, loops, n))
        me = out[-1][0]
        for c in ast.iter_child_nodes(n):
            visit(c, me, depth + 1, loops)

    visit(tree, -1, 1, 0)
    return out


def node_values() -> str:
    rows = []
    for i in range(len(CODE_TEMPLATES)):
        try:
            tree = ast.parse(_src(i))
        except SyntaxError:
            rows.append(f"({i}, NULL, NULL, 0, 0, NULL, true)")
            continue
        for nid, parent, depth, loops, n in _preorder(tree):
            rows.append(f"({i}, {nid}, {parent}, {depth}, {loops}, '{type(n).__name__}', false)")
    return "(VALUES " + ", ".join(rows) + ") AS nv(tmpl, node_id, parent_id, depth, loop_depth, node_type, parse_failed)"


def _maintainability(src: str) -> float | None:
    """Our MI definition evaluated directly on one source (brute force)."""
    try:
        tree = ast.parse(src)
    except SyntaxError:
        return None
    ops, opnds = [], []
    for n in ast.walk(tree):
        if isinstance(n, ast.BinOp):
            ops.append(type(n.op).__name__)
            opnds += [ast.dump(n.left), ast.dump(n.right)]
        elif isinstance(n, ast.UnaryOp):
            ops.append(type(n.op).__name__)
            opnds.append(ast.dump(n.operand))
        elif isinstance(n, ast.BoolOp):
            ops += [type(n.op).__name__] * (len(n.values) - 1)
            opnds += [ast.dump(v) for v in n.values]
        elif isinstance(n, ast.AugAssign):
            ops.append(type(n.op).__name__)
            opnds += [ast.dump(n.target), ast.dump(n.value)]
        elif isinstance(n, ast.Compare):
            ops += [type(o).__name__ for o in n.ops]
            opnds += [ast.dump(n.left)] + [ast.dump(c) for c in n.comparators]
    vocab = len(set(ops)) + len(set(opnds))
    volume = (len(ops) + len(opnds)) * math.log2(vocab) if vocab > 0 else 0.0
    stmts = sum(isinstance(n, ast.stmt) for n in ast.walk(tree))
    blocks = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    weights = 0
    for n in ast.walk(tree):
        if isinstance(n, (ast.If, ast.IfExp, ast.Assert, ast.ExceptHandler)):
            weights += 1
        elif isinstance(n, (ast.For, ast.AsyncFor, ast.While)):
            weights += 1 + bool(n.orelse)
        elif isinstance(n, ast.Try):
            weights += bool(n.orelse)
        elif isinstance(n, ast.comprehension):
            weights += 1 + len(n.ifs)
        elif isinstance(n, ast.BoolOp):
            weights += len(n.values) - 1
    total_cc = len(blocks) + weights
    str_lines = sum((n.end_lineno - n.lineno + 1) for n in ast.walk(tree)
                    if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str))
    sloc = len([ln for ln in src.splitlines() if ln.strip()])
    if volume <= 0 or stmts == 0:
        return 100.0
    pct = str_lines * 100.0 / sloc if sloc else 0.0
    raw = 171 - 5.2 * math.log(volume) - 0.23 * total_cc - 16.2 * math.log(stmts) + 50 * math.sin(math.sqrt(2.4 * math.radians(pct)))
    return min(100.0, max(0.0, raw * 100 / 171))


def shape_values() -> str:
    rows = []
    for i in range(len(CODE_TEMPLATES)):
        f = _template_facts(_src(i))
        if not f["ok"]:
            rows.append(f"({i}, 0, 0, 0, 0, 0, 0, false, CAST(NULL AS DOUBLE), CAST(0.0 AS DOUBLE), "
                        "CAST(NULL AS DOUBLE), 'unknown')")
            continue
        mi = _maintainability(_src(i))
        rows.append(f"({i}, {f['nodes']}, {f['depth']}, {f['funcs']}, {f['loops']}, {f['nest']}, {f['ifs']}, "
                    f"{'true' if f['rec'] else 'false'}, CAST({f['cc']!r} AS DOUBLE), CAST({f['cov']!r} AS DOUBLE), "
                    f"CAST({mi!r} AS DOUBLE), '{_big_o(f)}')")
    return ("(VALUES " + ", ".join(rows) + ") AS sv(tmpl, n_nodes, max_depth, function_count, loop_count, "
            "loop_nesting_depth, branch_count, recursion_detected, cc, cov, mi, big_o)")


def _per_solution(select: str) -> str:
    return f"SELECT {select} FROM ({CODE_SOL}) s LEFT JOIN {shape_values()} USING (tmpl)"


@sql("x1_node_table")
def _x1():
    return (f"SELECT s.solution_id, CAST(node_id AS INTEGER) AS node_id, CAST(parent_id AS INTEGER) AS parent_id, "
            "CAST(depth AS BIGINT) AS depth, CAST(loop_depth AS BIGINT) AS loop_depth, node_type, parse_failed "
            f"FROM ({CODE_SOL}) s JOIN {node_values()} USING (tmpl)").replace(
        "CAST(node_id AS INTEGER)", "CAST(node_id AS BIGINT)").replace(
        "CAST(parent_id AS INTEGER)", "CAST(parent_id AS BIGINT)")


@sql("a9_node_histogram")
def _a9():
    return (f"SELECT s.solution_id, node_type, CAST(count(*) AS BIGINT) AS n FROM ({CODE_SOL}) s "
            f"JOIN {node_values()} USING (tmpl) WHERE node_type IS NOT NULL GROUP BY 1, 2")


@sql("a10_ast_shape")
def _a10():
    cols = ["n_nodes", "max_depth", "function_count", "loop_count", "loop_nesting_depth", "branch_count"]
    return _per_solution("solution_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols))


@sql("a11_recursion")
def _a11():
    return _per_solution("solution_id, recursion_detected")


@sql("a12_cyclomatic")
def _a12():
    return _per_solution("solution_id, round(CAST(cc AS DOUBLE), 6) AS cyclomatic_complexity")


@sql("a13_docstring_coverage")
def _a13():
    return _per_solution("solution_id, round(CAST(cov AS DOUBLE), 6) AS docstring_coverage")


@sql("x3_big_o")
def _x3():
    return _per_solution("solution_id, big_o AS big_o_estimate")


@sql("x4_complexity_row")
def _x4():
    lines = sql_lines(sql_code("solution_id"))
    return _per_solution(f"solution_id, CAST(len(list_filter({lines}, lambda x: {sql_nonblank('x')})) AS BIGINT) "
                         "AS lines_of_code, round(CAST(cc AS DOUBLE), 6) AS cyclomatic_complexity, "
                         "round(CAST(mi AS DOUBLE), 6) AS maintainability_index, "
                         "big_o AS big_o_estimate")


# ------------------------------------------------------------------ similarity (brute-force pairs)
def template_cosines() -> str:
    """AST cosine of every template pair, by brute force over the node counts."""
    counts = []
    for i in range(len(CODE_TEMPLATES)):
        try:
            c = {}
            for n in ast.walk(ast.parse(_src(i))):
                c[type(n).__name__] = c.get(type(n).__name__, 0) + 1
            counts.append(c)
        except SyntaxError:
            counts.append(None)
    rows = []
    for i, x in enumerate(counts):
        for j, y in enumerate(counts):
            cos = 0.0
            if x and y:
                dot = sum(n * y.get(t, 0) for t, n in x.items())
                cos = min(1.0, dot / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values())))
            rows.append(f"({i}, {j}, CAST({cos!r} AS DOUBLE))")
    return "(VALUES " + ", ".join(rows) + ") AS tc(ta, tb, sim)"


def _coverage_sql(sol: str, extra: str = "") -> str:
    """Every solution with the first solution of each model of its prompt; pairs of two firsts once."""
    cols = "".join(f", least_.{c} AS {c}_a, most_.{c} AS {c}_b" for c in extra.split())
    return f"""
SELECT p.prompt_id, p.solution_a, p.solution_b, least_.model AS model_a, most_.model AS model_b{cols} FROM (
  SELECT DISTINCT s.prompt_id, least(s.solution_id, r.solution_id) AS solution_a,
    greatest(s.solution_id, r.solution_id) AS solution_b
  FROM ({sol}) s JOIN (SELECT prompt_id, model, min(solution_id) AS solution_id FROM ({sol}) GROUP BY 1, 2) r
    ON s.prompt_id = r.prompt_id AND s.solution_id <> r.solution_id) p
JOIN ({sol}) least_ ON least_.solution_id = p.solution_a JOIN ({sol}) most_ ON most_.solution_id = p.solution_b"""


@sql("j7_ast_pair_similarity")
def _j7():
    return (f"SELECT prompt_id, solution_a, solution_b, model_a, model_b, round(sim, 6) AS ast_similarity "
            f"FROM ({_coverage_sql(CODE_SOL, 'tmpl')}) JOIN {template_cosines()} ON ta = tmpl_a AND tb = tmpl_b")


EMB = "SELECT vec_id AS solution_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def _cos_sql(a: str, b: str) -> str:
    na, nb = f"sqrt(list_dot_product({a}, {a}))", f"sqrt(list_dot_product({b}, {b}))"
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {na} = 0 OR {nb} = 0 THEN 0.0 "
            f"ELSE least(1.0, greatest(-1.0, list_dot_product({a}, {b}) / ({na} * {nb}))) END")


@sql("x13_embedding_similarity")
def _x13():
    doc = "SELECT doc_id AS solution_id, doc_id // 20 AS prompt_id, source AS model FROM documents"
    return (f"SELECT p.*, round({_cos_sql('ea.v', 'eb.v')}, 6) AS embedding_similarity "
            f"FROM ({_coverage_sql(doc)}) p LEFT JOIN ({EMB}) ea ON ea.solution_id = p.solution_a "
            f"LEFT JOIN ({EMB}) eb ON eb.solution_id = p.solution_b")


@sql("j3_model_pair_similarity")
def _j3():
    # brute force: every solution pair i<j inside a prompt, then averaged per unordered model pair
    return f"""
WITH ap AS (SELECT a.prompt_id, a.solution_id AS solution_a, b.solution_id AS solution_b,
    least(a.model, b.model) AS model_a, greatest(a.model, b.model) AS model_b, tc.sim
  FROM ({CODE_SOL}) a JOIN ({CODE_SOL}) b ON a.prompt_id = b.prompt_id AND a.solution_id < b.solution_id
  JOIN {template_cosines()} ON ta = a.tmpl AND tb = b.tmpl),
es AS (SELECT ap.solution_a, ap.solution_b, {_cos_sql('ea.v', 'eb.v')} AS es FROM ap
  JOIN ({EMB}) ea ON ea.solution_id = ap.solution_a JOIN ({EMB}) eb ON eb.solution_id = ap.solution_b)
SELECT prompt_id, model_a, model_b, CAST(count(*) AS BIGINT) AS n_pairs, round(avg(sim), 6) AS ast_similarity_mean,
       CAST(count(es) AS BIGINT) AS n_embedding_pairs, round(avg(es), 6) AS embedding_similarity_mean
FROM ap LEFT JOIN es USING (solution_a, solution_b) GROUP BY 1, 2, 3"""


def _histogram_classes_sql() -> str:
    """(tmpl, hist): templates with one node histogram share a number; those that do not parse have none."""
    seen, rows = {}, []
    for i in range(len(CODE_TEMPLATES)):
        try:
            names = tuple(sorted(type(n).__name__ for n in ast.walk(ast.parse(_src(i)))))
            rows.append(f"({i}, {seen.setdefault(names, i)})")
        except SyntaxError:
            pass
    return "(VALUES " + ", ".join(rows) + ") AS hc(tmpl, hist)"


def _class_pairs_sql(classes: str, cosine: str) -> str:
    """Classes (prompt_id, class_id, n, …) of each prompt against each other, and with themselves."""
    return f"""
SELECT a.prompt_id, a.class_id AS class_a, b.class_id AS class_b, a.n AS n_a, b.n AS n_b,
  CASE WHEN a.class_id = b.class_id THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n_links,
  round(CASE WHEN a.class_id = b.class_id THEN 1.0 ELSE {cosine} END, 6)::DOUBLE AS similarity
FROM {classes} a JOIN {classes} b ON a.prompt_id = b.prompt_id AND a.class_id <= b.class_id"""


def _ast_classes_sql() -> str:
    return (f"SELECT s.prompt_id, hist, min(s.solution_id) AS class_id, count(*)::BIGINT AS n FROM ({CODE_SOL}) s "
            f"JOIN {_histogram_classes_sql()} USING (tmpl) GROUP BY 1, 2")


@sql("j3_similar_pairs")
def _j3_pairs():
    cosine = f"(SELECT sim FROM {template_cosines()} WHERE ta = a.hist AND tb = b.hist)"
    return (f"WITH c AS ({_ast_classes_sql()}) SELECT * FROM ({_class_pairs_sql('c', cosine)}) "
            "WHERE n_links > 0 AND similarity >= 0.9")


@sql("j3_link_counts")
def _j3_links():
    return f"""
WITH s AS (SELECT x.*, hist FROM ({CODE_SOL}) x LEFT JOIN {_histogram_classes_sql()} USING (tmpl)),
p AS (SELECT a.solution_id, count(*) AS k FROM s a JOIN s b ON a.prompt_id = b.prompt_id AND a.solution_id <> b.solution_id
  JOIN {template_cosines()} ON ta = a.tmpl AND tb = b.tmpl WHERE sim >= 0.9 GROUP BY 1),
c AS ({_ast_classes_sql()})
SELECT s.prompt_id, s.solution_id, c.class_id, coalesce(k, 0)::BIGINT AS n_links
FROM s LEFT JOIN p USING (solution_id) LEFT JOIN c ON c.prompt_id = s.prompt_id AND c.hist = s.hist"""


@sql("j3_similar_texts")
def _j3_texts():
    from codescope.plans.oracle_text import sql_normalized
    return f"""
WITH nm AS MATERIALIZED (SELECT doc_id AS solution_id, doc_id // 20 AS prompt_id, {sql_normalized('text')} AS norm FROM documents),
wc AS MATERIALIZED (SELECT prompt_id, solution_id, word, count(*)::DOUBLE AS n FROM (
  SELECT prompt_id, solution_id, unnest(regexp_split_to_array(norm, '\\s+')) AS word FROM nm) WHERE word <> '' GROUP BY ALL),
bag AS (SELECT prompt_id, solution_id, md5(string_agg(word || ' ' || n, chr(10) ORDER BY word)) AS bag, sum(n * n) AS sq FROM wc GROUP BY ALL),
c AS (SELECT prompt_id, bag, min(solution_id) AS class_id, count(*)::BIGINT AS n, any_value(sq) AS sq FROM bag GROUP BY ALL),
d AS MATERIALIZED (SELECT a.solution_id AS a, b.solution_id AS b, sum(a.n * b.n) AS dot FROM wc a JOIN wc b
  ON a.prompt_id = b.prompt_id AND a.word = b.word AND a.solution_id < b.solution_id
  WHERE a.solution_id IN (SELECT class_id FROM c) AND b.solution_id IN (SELECT class_id FROM c) GROUP BY ALL)
SELECT x.prompt_id, x.class_id AS class_a, y.class_id AS class_b, x.n AS n_a, y.n AS n_b, x.n * y.n AS n_links,
  round(least(1.0, dot / (sqrt(x.sq) * sqrt(y.sq))), 6) AS similarity
FROM d JOIN c x ON x.class_id = a JOIN c y ON y.class_id = b WHERE dot / (sqrt(x.sq) * sqrt(y.sq)) >= 0.8
UNION ALL SELECT prompt_id, class_id, class_id, n, n, n * (n - 1) // 2, 1.0 FROM c WHERE n > 1"""


@sql("j3_similar_embeddings")
def _j3_embeddings():
    c = (f"(SELECT doc_id // 20 AS prompt_id, min(doc_id) AS class_id, count(*)::BIGINT AS n, v FROM documents JOIN ({EMB}) "
         "ON solution_id = doc_id GROUP BY 1, v)")
    return f"SELECT * FROM ({_class_pairs_sql(c, _cos_sql('a.v', 'b.v'))}) WHERE n_links > 0 AND similarity >= 0.25"


def _token_similarity_ctes(code: str, pairs: str) -> str:
    """CTEs ``pr`` (the pairs) and ``ts`` (solution_a, solution_b, sim): overlap of word multisets of normalised text."""
    from codescope.plans.oracle_text import sql_normalized
    return f"""
pr AS MATERIALIZED ({pairs}),
cd AS MATERIALIZED ({code}),
nm AS MATERIALIZED (SELECT solution_id, {sql_normalized('code')} AS norm FROM cd),
wd AS (SELECT solution_id, unnest(regexp_split_to_array(norm, '\\s+')) AS word FROM nm),
wc AS MATERIALIZED (SELECT solution_id, word, count(*) AS n FROM wd WHERE word <> '' GROUP BY 1, 2),
wn AS (SELECT solution_id, sum(n) AS size FROM wc GROUP BY 1),
wa AS MATERIALIZED (SELECT pr.solution_a, pr.solution_b, a.word, a.n FROM pr JOIN wc a ON a.solution_id = pr.solution_a),
wm AS (SELECT solution_a, solution_b, sum(least(wa.n, b.n)) AS m FROM wa
  JOIN wc b ON b.solution_id = wa.solution_b AND b.word = wa.word GROUP BY 1, 2),
ts AS (SELECT pr.solution_a, pr.solution_b, CASE WHEN coalesce(x.size, 0) + coalesce(y.size, 0) = 0 THEN 1.0::DOUBLE ELSE
    2.0::DOUBLE * coalesce(m, 0) / (coalesce(x.size, 0) + coalesce(y.size, 0)) END AS sim
  FROM pr LEFT JOIN wm USING (solution_a, solution_b)
  LEFT JOIN wn x ON x.solution_id = pr.solution_a LEFT JOIN wn y ON y.solution_id = pr.solution_b)"""


@sql("x11_token_similarity")
def _x11():
    doc = "SELECT doc_id AS solution_id, doc_id // 20 AS prompt_id, source AS model FROM documents"
    code = "SELECT doc_id AS solution_id, text AS code FROM documents"
    return (f"WITH {_token_similarity_ctes(code, _coverage_sql(doc))} SELECT pr.*, round(sim, 6) AS token_similarity "
            "FROM pr JOIN ts USING (solution_a, solution_b)")


@sql("x14_similarity_report")
def _x14():
    code = f"SELECT solution_id, {sql_code('solution_id')} AS code FROM ({CODE_SOL})"
    return (f"WITH {_token_similarity_ctes(code, _coverage_sql(CODE_SOL, 'tmpl'))} "
            "SELECT pr.prompt_id, pr.solution_a, pr.solution_b, model_a, model_b, round(ts.sim, 6) AS token_similarity, "
            f"round(tc.sim, 6) AS ast_similarity, round({_cos_sql('ea.v', 'eb.v')}, 6) AS embedding_similarity "
            f"FROM pr JOIN ts USING (solution_a, solution_b) JOIN {template_cosines()} ON ta = tmpl_a AND tb = tmpl_b "
            f"LEFT JOIN ({EMB}) ea ON ea.solution_id = pr.solution_a "
            f"LEFT JOIN ({EMB}) eb ON eb.solution_id = pr.solution_b")


# ------------------------------------------------------------------ per-experiment clustering
EMBEDDED = "SELECT doc_id // 100 AS g, doc_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM documents JOIN embeddings ON vec_id = doc_id"


def _kmeans_ctes(k: int = 3, restarts: int = 10, seed: int = 42, rounds: int = 30) -> str:
    """CTEs up to ``km`` (g, id, cluster): seeded farthest-first starts and unrolled Lloyd rounds."""
    out = [f"p AS MATERIALIZED ({EMBEDDED})",
           "pl AS MATERIALIZED (SELECT g, id, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM p)",
           f"s0 AS MATERIALIZED (SELECT g, r, 0 AS c, arg_min(v, md5(({seed} + r) || ':' || id)) AS centre FROM p, range({restarts}) x(r) GROUP BY g, r)"]
    for c in range(1, k):
        out.append(f"s{c} AS MATERIALIZED (SELECT * FROM s{c - 1} UNION ALL (SELECT g, r, {c}, v FROM (SELECT p.g, r, id, any_value(v) AS v, "
                   f"min(list_distance(v, centre)) AS d FROM p JOIN s{c - 1} t ON p.g = t.g GROUP BY p.g, r, id) "
                   "QUALIFY row_number() OVER (PARTITION BY g, r ORDER BY d DESC, id) = 1))")
    now = f"s{k - 1}"
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT p.g, r, id, arg_min(c, list_distance(v, centre)) AS c, min(list_distance(v, centre)) AS d "
                   f"FROM p JOIN {now} t ON p.g = t.g GROUP BY p.g, r, id)")
        out.append(f"t{i} AS MATERIALIZED (SELECT o.g, o.r, o.c, coalesce(m.centre, o.centre) AS centre FROM {now} o LEFT JOIN ("
                   "SELECT g, r, c, list(x ORDER BY j) AS centre FROM (SELECT a.g, r, c, j, avg(x) AS x FROM "
                   f"a{i} a JOIN pl ON a.g = pl.g AND a.id = pl.id GROUP BY ALL) GROUP BY g, r, c) m USING (g, r, c))")
        now = f"t{i}"
    out += [f"best AS (SELECT g, arg_min(r, cost) AS r FROM (SELECT g, r, round(sum(d * d), 9) AS cost FROM a{rounds} GROUP BY ALL ORDER BY g, r) GROUP BY g)",
            f"own AS (SELECT g, id, c, min(id) OVER (PARTITION BY g, c) AS first FROM a{rounds} JOIN best USING (g, r))",
            "km AS (SELECT g, id, dense_rank() OVER (PARTITION BY g ORDER BY first) - 1 AS cluster FROM own)"]
    return ",\n".join(out)


def _pca_ctes(squarings: int = 18) -> str:
    """CTEs up to ``pc`` (g, id, x, y): covariance, its two main axes by squaring and deflation, scores."""
    out = [f"q AS MATERIALIZED ({EMBEDDED})",
           "ql AS MATERIALIZED (SELECT g, id, j, x - avg(x) OVER (PARTITION BY g, j) AS x FROM "
           "(SELECT g, id, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM q))",
           "c0 AS MATERIALIZED (SELECT a.g, a.j AS i, b.j, sum(a.x * b.x) AS v FROM ql a JOIN ql b ON a.g = b.g AND a.id = b.id GROUP BY ALL)"]
    for axis in (0, 1):
        m = f"c{axis}"
        for k in range(squarings):
            n = f"m{axis}_{k}"
            out.append(f"{n} AS MATERIALIZED (WITH z AS (SELECT a.g, a.i, b.j, sum(a.v * b.v) AS v FROM {m} a JOIN {m} b ON a.g = b.g AND a.j = b.i GROUP BY ALL) "
                       "SELECT g, i, j, v / (SELECT sum(v) FROM z t WHERE t.g = z.g AND t.i = t.j) AS v FROM z)")
            m = n
        out.append(f"w{axis} AS MATERIALIZED (WITH u AS (SELECT g, i, v FROM {m} WHERE (g, j) IN (SELECT (g, arg_max(i, v)) FROM {m} WHERE i = j GROUP BY g)), "
                   "n AS (SELECT g, sqrt(sum(v * v)) * sign(arg_max(v, abs(v))) AS s FROM u GROUP BY g) SELECT u.g, i, v / s AS v FROM u JOIN n USING (g))")
        if axis == 0:
            out.append("c1 AS MATERIALIZED (WITH l AS (SELECT c.g, sum(a.v * c.v * b.v) AS l FROM c0 c JOIN w0 a ON a.g = c.g AND a.i = c.i "
                       "JOIN w0 b ON b.g = c.g AND b.i = c.j GROUP BY c.g) SELECT c.g, c.i, c.j, c.v - l * a.v * b.v AS v FROM c0 c JOIN l USING (g) "
                       "JOIN w0 a ON a.g = c.g AND a.i = c.i JOIN w0 b ON b.g = c.g AND b.i = c.j)")
    out.append("pc AS (SELECT ql.g, ql.id, sum(x * a.v) AS x, sum(x * b.v) AS y FROM ql JOIN w0 a ON a.g = ql.g AND a.i = j "
               "JOIN w1 b ON b.g = ql.g AND b.i = j GROUP BY ql.g, ql.id)")
    return ",\n".join(out)


@sql("m1_kmeans_by_experiment")
def _m1_by():
    return f"WITH {_kmeans_ctes()} SELECT g AS experiment_id, id AS solution_id, cluster FROM km"


@sql("m3_pca_by_experiment")
def _m3_by():
    return f"WITH {_pca_ctes()} SELECT g AS experiment_id, id AS solution_id, round(x, 6) AS x, round(y, 6) AS y FROM pc"


@sql("m7_cluster_maps")
def _m7_by():
    return (f"WITH {_kmeans_ctes()}, {_pca_ctes()} SELECT km.g AS experiment_id, km.id AS solution_id, source AS model, doc_id // 20 AS prompt_id, "
            "round(x, 6) AS x, round(y, 6) AS y, cluster FROM km JOIN pc USING (g, id) JOIN documents ON doc_id = km.id")


@sql("m4_neighbours")
def _m4():
    return f"""
WITH p AS ({EMBEDDED}), n AS (SELECT g, count(*) AS n FROM p GROUP BY g),
d AS (SELECT a.g, a.id, b.id AS nbr, list_distance(a.v, b.v) AS d FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nbr) AS rank FROM d)
SELECT g AS experiment_id, id AS solution_id, nbr AS neighbour, rank, round(d, 6) AS distance FROM r JOIN n USING (g) WHERE rank <= least(15, n - 1)"""


# ------------------------------------------------------------------ streaming twins
@sql("st1_analyse_on_arrival")
def _st1():
    from codescope.plans.oracle_text import _x7
    return (f"SELECT x.*, y.pep8_violations, y.style_score FROM ({_x4()}) x JOIN ({_x7()}) y USING (solution_id)")


@sql("st2_live_leaderboard")
def _st2():
    from codescope.plans.oracle import EXEC, t975_sql
    return f"""
WITH f AS (SELECT s.solution_id, s.model, x.pass_rate, x.runtime_seconds FROM ({CODE_SOL}) s
           LEFT JOIN ({EXEC}) x USING (solution_id)),
a AS (SELECT model, avg(pass_rate) AS m, stddev_samp(pass_rate) AS sd, count(pass_rate) AS n,
             avg(runtime_seconds) AS rt, count(*) AS n_solutions FROM f GROUP BY model)
SELECT model, round(m, 6) AS correctness,
  round(CASE WHEN n = 1 THEN m WHEN n >= 2 THEN m - {t975_sql('a.n - 1')} * sd / sqrt(n) END, 6) AS correctness_ci_low,
  round(CASE WHEN n = 1 THEN m WHEN n >= 2 THEN m + {t975_sql('a.n - 1')} * sd / sqrt(n) END, 6) AS correctness_ci_high,
  round(rt, 6) AS avg_runtime_s, CAST(n_solutions AS BIGINT) AS n_solutions FROM a"""


@sql("st3_rate_breaches")
def _st3():
    return ("SELECT user_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, "
            "CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 5")


# ------------------------------------------------------------------ store maintenance twins
@sql("s3_append_executions")
def _s3():
    return ("SELECT sha256(CAST(doc_id AS VARCHAR)) AS id, doc_id AS solution_id, "
            "CAST(quality AS DOUBLE) AS pass_rate, CAST(0 AS BIGINT) AS passed_tests, "
            "CAST(0 AS BIGINT) AS total_tests FROM labels")


@sql("s4_unique_executions")
def _s4():
    return ("SELECT l.doc_id AS solution_id, CAST(CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END AS DOUBLE) "
            "AS pass_rate, CASE WHEN toxic = 1 THEN e.ts + INTERVAL 1 HOUR ELSE e.ts END AS executed_at "
            "FROM labels l LEFT JOIN events e ON e.event_id = l.doc_id")


@sql("s5_create_experiments")
def _s5():
    return ("SELECT sha256((item_id // 5) || ':' || (item_id % 5)) AS id, item_id // 5 AS experiment_id, "
            "md5(text) AS statement_md5, CASE WHEN item_id % 2 = 0 THEN 'python' ELSE 'python3' END AS language "
            "FROM benchmark WHERE item_id % 7 <> 0 AND trim(text) <> ''")


@sql("s6_registry_upsert")
def _s6():
    from codescope.plans.oracle import REG
    return (f"SELECT name, provider FROM ({REG}) UNION ALL "
            f"SELECT DISTINCT 'src' || (conv_id % 23) AS name, 'incoming' AS provider FROM conversations "
            f"WHERE 'src' || (conv_id % 23) NOT IN (SELECT name FROM ({REG}))")


@sql("s8_status_update")
def _s8():
    from codescope.plans.oracle import EXPS
    return (f"SELECT id, CASE WHEN id % 5 = 4 THEN status WHEN id % 3 = 0 THEN 'completed' "
            "WHEN id % 3 = 1 THEN 'running' ELSE 'failed' END AS status, "
            "CASE WHEN id % 5 <> 4 AND id % 3 <> 1 THEN TIMESTAMP '2025-01-01 00:00:00' ELSE completed_at END "
            f"AS completed_at FROM ({EXPS})")


@sql("s9_cascade_delete")
def _s9():
    from codescope.plans.oracle import EXEC, EXPS, PROMPTS
    doomed_e = f"(SELECT id FROM ({EXPS}) WHERE owner_id = 3)"
    doomed_p = f"(SELECT id FROM ({PROMPTS}) WHERE experiment_id IN {doomed_e})"
    doomed_s = f"(SELECT doc_id FROM documents WHERE doc_id // 20 IN {doomed_p})"
    return f"""
SELECT 'experiments' AS table_name, CAST(count(*) AS BIGINT) AS n FROM ({EXPS}) WHERE id NOT IN {doomed_e}
UNION ALL SELECT 'prompts', count(*) FROM ({PROMPTS}) WHERE experiment_id NOT IN {doomed_e}
UNION ALL SELECT 'generated_solutions', count(*) FROM documents WHERE doc_id // 20 NOT IN {doomed_p}
UNION ALL SELECT 'execution_results', count(*) FROM ({EXEC}) WHERE solution_id NOT IN {doomed_s}
UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN {doomed_s}"""


@sql("m2_dbscan")
def _m2():
    # brute force: every pair, transitive closure of the core graph by a recursive CTE
    return """
WITH RECURSIVE
u AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nrm AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS w FROM u
        WHERE list_dot_product(v, v) > 0),
pairs AS (SELECT a.id AS a, b.id AS b FROM nrm a JOIN nrm b ON a.id < b.id
          WHERE 1 - list_dot_product(a.w, b.w) <= 0.7),
nb AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
deg AS (SELECT a, count(*) AS k FROM nb GROUP BY a),
core AS (SELECT u.id FROM u LEFT JOIN deg ON deg.a = u.id WHERE coalesce(k, 0) + 1 >= 2),
edges AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(src, dst) AS (SELECT id, id FROM core UNION SELECT r.src, e.b FROM reach r JOIN edges e ON e.a = r.dst),
comp AS (SELECT src AS id, min(dst) AS label FROM reach GROUP BY src),
num AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM comp)),
core_cl AS (SELECT comp.id, num.cluster FROM comp JOIN num USING (label)),
border AS (SELECT nb.a AS id, min(cc.cluster) AS cluster FROM nb JOIN core_cl cc ON cc.id = nb.b
           WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a)
SELECT u.id AS solution_id, CAST(coalesce(core_cl.cluster, border.cluster, -1) AS BIGINT) AS cluster
FROM u LEFT JOIN core_cl ON core_cl.id = u.id LEFT JOIN border ON border.id = u.id"""
