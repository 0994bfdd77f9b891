"""X1 code → AST node table; A9–A13, X3–X5 as expressions over per-source node types.

The only Python is the parse itself (stdlib ``ast``) inside ``mapInArrow``. ``node_table``
gives a row per node; ``source_facts`` gives a row per source with the same rows already
summed by node type, from which every metric is a native expression. One parse serves the histogram, the
error and the metrics, and nothing is shuffled for them.

Metric definitions (ours, pinned by unit tests; see README):
- depth counts the module as 1; context nodes (Load/Store) are counted;
- loop nesting counts For/While only; branch count = If nodes (elif too);
- recursion = a plain-name call to any function defined in the same source;
- cyclomatic (A12): blocks are functions, async functions and classes; a
  block is 1 + its decision points (If, IfExp, For, AsyncFor, While, except
  handler, assert, comprehension + its ifs, BoolOp operands-1, loop/try
  else); the solution value is the mean over blocks, 1.0 with no blocks;
- maintainability (X5): 100*(171 - 5.2 ln V - 0.23 G - 16.2 ln L
  + 50 sin(sqrt(2.4 C)))/171 clamped to [0, 100], V Halstead volume, G total
  complexity, L statements, C comment share (percent, as radians).
"""

from __future__ import annotations

import ast
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescope.functions.text import line_count, nonblank_line_count
from codescope.sources.scratch import materialise

NODE_FIELDS = [
    ("node_id", T.IntegerType()), ("parent_id", T.IntegerType()), ("depth", T.IntegerType()),
    ("loop_depth", T.IntegerType()), ("block_id", T.IntegerType()), ("node_type", T.StringType()),
    ("name", T.StringType()), ("call_name", T.StringType()), ("cc_weight", T.IntegerType()),
    ("has_docstring", T.BooleanType()), ("is_stmt", T.BooleanType()),
    ("string_lines", T.IntegerType()), ("calls_local", T.BooleanType()),
    ("n_ops", T.IntegerType()), ("n_operands", T.IntegerType()),
    ("new_ops", T.IntegerType()), ("new_operands", T.IntegerType()), ("parse_error", T.StringType()),
]
_ARROW = {T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(),
          T.ArrayType(T.StringType()): pa.list_(pa.string())}

_FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BLOCKS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_LOOPS = (ast.For, ast.While)


def _weight(node: ast.AST) -> int:
    if isinstance(node, (ast.If, ast.IfExp, ast.Assert, ast.ExceptHandler)):
        return 1
    if isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
        return 1 + (1 if node.orelse else 0)
    if isinstance(node, ast.Try) or type(node).__name__ == "TryStar":
        return 1 if node.orelse else 0
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    return 0


def _structure_ids(order: list[ast.AST]) -> dict[int, int]:
    """One number per node (by ``id``), equal for nodes of equal structure.

    ``order`` is a pre-order, so children come first in reverse: each node's key is its class
    and its children's numbers, which is linear and needs no recursion.
    """
    known: dict[tuple, int] = {}
    ids: dict[int, int] = {}
    for node in reversed(order):
        key: list = [type(node)]
        for field in node._fields:
            value = getattr(node, field, None)
            if isinstance(value, ast.AST):
                key.append(ids[id(value)])
            elif isinstance(value, list):
                key.append(tuple(ids[id(v)] if isinstance(v, ast.AST) else repr(v) for v in value))
            else:
                key.append(repr(value))
        ids[id(node)] = known.setdefault(tuple(key), len(known))
    return ids


def _halstead(node: ast.AST, ids: dict[int, int]) -> tuple[list[str], list[int]]:
    """Operators and operands (by structure) of one expression node."""
    if isinstance(node, ast.BinOp):
        return [type(node.op).__name__], [ids[id(node.left)], ids[id(node.right)]]
    if isinstance(node, ast.UnaryOp):
        return [type(node.op).__name__], [ids[id(node.operand)]]
    if isinstance(node, ast.BoolOp):
        return [type(node.op).__name__] * (len(node.values) - 1), [ids[id(v)] for v in node.values]
    if isinstance(node, ast.AugAssign):
        return [type(node.op).__name__], [ids[id(node.target)], ids[id(node.value)]]
    return [type(o).__name__ for o in node.ops], [ids[id(node.left)]] + [ids[id(c)] for c in node.comparators]


_N_FIELDS = len(NODE_FIELDS)
# per AST class: (name, is_loop, is_block, is_func, is_stmt, is_call, is_expr, has_weight, is_halstead)
_CLASS_INFO: dict[type, tuple] = {}
_WEIGHTED = (ast.If, ast.IfExp, ast.Assert, ast.ExceptHandler, ast.For, ast.AsyncFor, ast.While, ast.Try,
             ast.comprehension, ast.BoolOp) + ((ast.TryStar,) if hasattr(ast, "TryStar") else ())
_HALSTEAD = (ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.AugAssign, ast.Compare)


def _info(cls: type) -> tuple:
    info = _CLASS_INFO.get(cls)
    if info is None:
        info = (cls.__name__, issubclass(cls, _LOOPS), issubclass(cls, _BLOCKS), issubclass(cls, _FUNCS),
                issubclass(cls, ast.stmt), cls is ast.Call, cls is ast.Expr, issubclass(cls, _WEIGHTED),
                issubclass(cls, _HALSTEAD))
        _CLASS_INFO[cls] = info
    return info


def _error_row(exc: BaseException) -> tuple:
    return (None, None, 0, 0, -1, None, None, None, 0, None, None, 0, None, 0, 0, 0, 0, f"{type(exc).__name__}: {exc}")


def node_rows(code: str | None) -> Iterator[tuple]:
    """The NODE_FIELDS of every node of one source in pre-order (no recursion over the tree)."""
    tree = ast.parse(code if code is not None else "")
    order: list[tuple] = []
    nodes: list[ast.AST] = []
    stack = [(tree, -1, 1, 0, -1)]
    functions: set[str] = set()
    any_hal = False
    while stack:
        node, parent, depth, loops, block = stack.pop()
        info = _info(type(node))
        nid = len(order)
        loop_depth = loops + 1 if info[1] else loops
        if info[3]:
            functions.add(node.name)
        any_hal = any_hal or info[8]
        order.append((nid, parent, depth, loop_depth, block, info))
        nodes.append(node)
        own = nid if info[2] else block
        for child in reversed(list(ast.iter_child_nodes(node))):
            stack.append((child, nid, depth + 1, loop_depth, own))
    ids = _structure_ids(nodes) if any_hal else {}
    seen_ops: set[str] = set()
    seen_operands: set[int] = set()
    for node, (nid, parent, depth, loop_depth, block, info) in zip(nodes, order):
        name, _, is_block, is_func, is_stmt, is_call, is_expr, weighted, hal = info
        call = node.func.id if is_call and type(node.func) is ast.Name else None
        text = 0
        if is_expr and type(node.value) is ast.Constant and isinstance(node.value.value, str):
            text = (node.end_lineno or node.lineno) - node.lineno + 1
        n_ops = n_operands = new_ops = new_operands = 0
        if hal:
            ops, operands = _halstead(node, ids)
            n_ops, n_operands = len(ops), len(operands)
            before = len(seen_ops), len(seen_operands)
            seen_ops.update(ops)
            seen_operands.update(operands)
            new_ops, new_operands = len(seen_ops) - before[0], len(seen_operands) - before[1]
        yield (nid, parent, depth, loop_depth, block, name, node.name if is_block else None, call,
               _weight(node) if weighted else 0, bool(ast.get_docstring(node, clean=False)) if is_func else None, is_stmt,
               text, (call in functions) if is_call else None, n_ops, n_operands, new_ops, new_operands, None)


def guarded_rows(code: str | None) -> list[tuple]:
    """All rows of one source, or the one error row if anything fails on it (also after the parse)."""
    try:
        return list(node_rows(code))
    except Exception as exc:
        return [_error_row(exc)]


def parse_facts(code: str | None) -> list[tuple]:
    """Rows of NODE_FIELDS for one source."""
    return guarded_rows(code)


def spread(df: DataFrame, id_col: str) -> DataFrame:
    """Hash-partition by id when the input has fewer files than the cluster has cores.

    CPU-heavy per-row work (parsing, regex line splits) must not run in one
    task just because the source is one small file; a scan of many files keeps its
    own partitions and pays no shuffle. Only the file listing is looked at: no job runs.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores:
        # the shuffle-partition count when it covers the cores, so a later
        # join/aggregation on the same id reuses this hash partitioning
        return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), id_col)
    return df


OUT_ROWS = 65_536


def node_table(df: DataFrame, id_col: str = "solution_id", code_col: str = "code",
               carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns…, NODE_FIELDS…) via Arrow batches; never fails a job.

    Output batches hold about ``OUT_ROWS`` nodes, however many sources an input batch has.
    """
    src = spread(df.select(id_col, code_col, *carry), id_col)
    out_schema = T.StructType([df.schema[c] for c in (id_col, *carry)] + [T.StructField(n, t) for n, t in NODE_FIELDS])
    node_arrow = [pa.field(n, _ARROW[t]) for n, t in NODE_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            take: list[int] = []

            def flush():
                head = [batch.column(c).take(pa.array(take, pa.int64())) for c in (id_col, *carry)]
                body = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), node_arrow)]
                return pa.RecordBatch.from_arrays(head + body, names=[id_col, *carry] + [f.name for f in node_arrow])

            for i, code in enumerate(batch.column(code_col)):
                got = guarded_rows(code.as_py())
                rows += got
                take += [i] * len(got)
                if len(rows) >= OUT_ROWS:
                    yield flush()
                    rows.clear()
                    take.clear()
            if rows:
                yield flush()

    return src.mapInArrow(run, out_schema)


TYPE_FIELDS = ("n", "max_depth", "max_loop", "weight", "block_weight", "documented", "stmts", "string_lines",
               "calls_local", "n_ops", "n_operands", "new_ops", "new_operands")


def type_struct(fields: tuple[str, ...]) -> str:
    return "struct<node_type:string," + ",".join(f"{f}:int" for f in fields) + ">"


TYPE_STRUCT = type_struct(TYPE_FIELDS)


# per AST class: (name, is_loop, is_block, is_func, is_stmt, is_halstead, has_weight, fields that can hold nodes, last first)
_WALK_INFO: dict[type, tuple] = {}
#: Whole numbers with more bits than this may be too long to print.
LONG_NUMBER = 10_000


def _walk_info(cls: type) -> tuple:
    name, is_loop, is_block, is_func, is_stmt, _, _, weighted, hal = _info(cls)
    plain = (str, int, object, str | None, int | None, list[str])
    kinds = getattr(cls, "_field_types", {})  # of Python 3.13
    fields = tuple(f for f in reversed(cls._fields) if kinds.get(f) not in plain)
    info = _WALK_INFO[cls] = (name, is_loop, is_block, is_func, is_stmt, hal, weighted, fields)
    return info


def type_counts(code: str | None) -> tuple[str | None, dict[str, list[int]]]:
    """(parse error, per node type the TYPE_FIELDS) of one source: the sums of X1's rows (``node_rows``), without the rows."""
    out: dict[str, list[int]] = {}
    try:
        stack = [(ast.parse(code if code is not None else ""), 1, 0, False, False)]
        functions: set[str] = set()
        called: list[str] = []
        halstead: list[ast.AST] = []
        inner: list[ast.AST] = []  # the nodes of expressions with operators, in pre-order
        long_numbers: list[int] = []
        while stack:
            node, depth, loops, in_block, in_expr = stack.pop()
            cls = type(node)
            name, is_loop, is_block, is_func, is_stmt, hal, weighted, fields = _WALK_INFO.get(cls) or _walk_info(cls)
            if is_loop:
                loops += 1
            t = out.get(name)
            if t is None:
                t = out[name] = [1, depth, loops, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
            else:
                t[0] += 1
                if depth > t[1]:
                    t[1] = depth
                if loops > t[2]:
                    t[2] = loops
            if weighted:
                weight = _weight(node)
                t[3] += weight
                if in_block:
                    t[4] += weight
            if is_stmt:
                t[6] += 1
                if is_block:
                    in_block = True
                    if is_func:
                        functions.add(node.name)
                        first = node.body[0] if node.body else None
                        if type(first) is ast.Expr and type(first.value) is ast.Constant and isinstance(first.value.value, str):
                            t[5] += bool(first.value.value)
                elif cls is ast.Expr and type(node.value) is ast.Constant and isinstance(node.value.value, str):
                    t[7] += (node.end_lineno or node.lineno) - node.lineno + 1
            elif cls is ast.Call:
                if type(node.func) is ast.Name:
                    called.append(node.func.id)
            elif cls is ast.Constant and type(node.value) is int and node.value.bit_length() > LONG_NUMBER:
                long_numbers.append(node.value)
            if hal:
                halstead.append(node)
                in_expr = True
            if in_expr:
                inner.append(node)
            depth += 1
            for field in fields:
                value = getattr(node, field, None)
                if isinstance(value, list):
                    for v in reversed(value):
                        if isinstance(v, ast.AST):
                            stack.append((v, depth, loops, in_block, in_expr))
                elif isinstance(value, ast.AST):
                    stack.append((value, depth, loops, in_block, in_expr))
        if called:
            out["Call"][8] = sum(c in functions for c in called)
        if halstead:
            for value in long_numbers:
                repr(value)  # fails as it does for X1
            ids = _structure_ids(inner)
            seen_ops: set[str] = set()
            seen_operands: set[int] = set()
            for node in halstead:
                ops, operands = _halstead(node, ids)
                t = out[_WALK_INFO[type(node)][0]]
                before = len(seen_ops), len(seen_operands)
                seen_ops.update(ops)
                seen_operands.update(operands)
                t[9] += len(ops)
                t[10] += len(operands)
                t[11] += len(seen_ops) - before[0]
                t[12] += len(seen_operands) - before[1]
    except Exception as exc:
        return f"{type(exc).__name__}: {exc}", {}
    return None, out


def source_facts(df: DataFrame, id_col: str = "solution_id", code_col: str = "code",
                 carry: tuple[str, ...] = (), dealt: bool = False, fields: tuple[str, ...] = TYPE_FIELDS) -> DataFrame:
    """(id, carried columns…, parse_error, types): one parse, one row per source; ``dealt``: ``df`` is spread already.

    ``types`` holds a TYPE_STRUCT (of ``fields``) per node type, some tens at most. Histogram, error and every
    metric come from this row by expressions, without a shuffle.
    """
    item = pa.struct([("node_type", pa.string())] + [(f, pa.int32()) for f in fields])

    def types(found: list[dict], cut: np.ndarray, columns: np.ndarray) -> list[pa.Array]:
        names = pa.array([t for types in found for t in types], pa.string())
        flat = pa.StructArray.from_arrays([names] + [pa.array(c) for c in columns], fields=list(item))
        return [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), flat)]

    return _parsed(df, id_col, code_col, carry, dealt, f"types array<{type_struct(fields)}>", types, fields)


def _all_counts(codes: pa.Array) -> tuple[tuple[str | None, ...], tuple[dict, ...]]:
    """:func:`type_counts` of some sources. Trees have no cycles, so the collector, which would walk them, waits."""
    on = gc.isenabled()
    gc.disable()
    try:
        return tuple(zip(*[type_counts(code.as_py()) for code in codes]))
    finally:
        if on:
            gc.enable()


def _parsed(df: DataFrame, id_col: str, code_col: str, carry: tuple[str, ...], dealt: bool, schema: str, fn,
            fields: tuple[str, ...] = TYPE_FIELDS) -> DataFrame:
    """(id, carried columns…, parse_error, the columns of ``schema``) from one parse.

    ``fn`` makes these columns of the :func:`type_counts` of some sources, where the rows of each source begin, and their
    ``fields`` as arrays.
    """
    at = [TYPE_FIELDS.index(f) for f in fields]
    src = df.select(id_col, code_col, *carry)
    src = src if dealt else spread(src, id_col)
    more = T._parse_datatype_string(schema)
    out_schema = T.StructType([*[df.schema[c] for c in (id_col, *carry)], T.StructField("parse_error", T.StringType()), *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                errors, found = _all_counts(part.column(code_col))
                cut = np.concatenate([[0], np.cumsum([len(types) for types in found])])
                if len(at) < len(TYPE_FIELDS):
                    columns = [np.array([v[f] for types in found for v in types.values()], np.int32) for f in at]
                else:
                    values = [v for types in found for v in types.values()]
                    columns = np.ascontiguousarray(np.array(values, np.int32).reshape(-1, len(TYPE_FIELDS)).T)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in (id_col, *carry)] + [pa.array(errors, pa.string()), *fn(found, cut, columns)],
                    names=[id_col, *carry, "parse_error", *more.names])

    return src.mapInArrow(run, out_schema)


#: What :func:`source_totals` sums: a TYPE_FIELD over all node types, or over some.
_FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
TOTALS = {"n_nodes": ("n",), "function_count": ("n", *_FUNCTIONS), "loop_count": ("n", "For", "While"), "branch_count": ("n", "If"),
          "_calls": ("calls_local",), "_documented": ("documented",), "_blocks": ("n", *_FUNCTIONS, "ClassDef"),
          "_block_w": ("block_weight",), "_all_w": ("weight",), "_tot_ops": ("n_ops",), "_tot_opnds": ("n_operands",),
          "_uniq_ops": ("new_ops",), "_uniq_opnds": ("new_operands",), "_stmts": ("stmts",), "_str_lines": ("string_lines",)}
HIGHEST = {"max_depth": "max_depth", "loop_nesting_depth": "max_loop"}


def source_totals(df: DataFrame, id_col: str = "solution_id", code_col: str = "code",
                  carry: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """(id, carried columns…, parse_error, TOTALS…, HIGHEST…): ``source_facts`` summed over its node types, some numbers a source."""

    def totals(found: list[dict], cut: np.ndarray, columns: np.ndarray) -> list[pa.Array]:
        out = []
        for field, *kinds in TOTALS.values():
            at = TYPE_FIELDS.index(field)
            if kinds:
                own = [sum(types[t][at] for t in kinds if t in types) for types in found]
            else:
                upto = np.concatenate([[0], np.cumsum(columns[at], dtype=np.int64)])
                own = upto[cut[1:]] - upto[cut[:-1]]
            out.append(pa.array(own, pa.int32()))
        some = cut[1:] > cut[:-1]
        for field in HIGHEST.values():
            own = np.zeros(len(found), np.int32)
            if some.any():
                own[some] = np.maximum.reduceat(columns[TYPE_FIELDS.index(field)], cut[:-1][some])
            out.append(pa.array(own, pa.int32()))
        return out

    return _parsed(df, id_col, code_col, carry, dealt, ", ".join(f"{c} int" for c in (*TOTALS, *HIGHEST)), totals)


#: Sources that a task parses: what it holds does not grow with the table, however few its files are.
TASK_ROWS = 100_000


def task_parts(rows: int, spark) -> int:
    """Partitions for ``rows`` sources: the session's number, or more where a task would have over ``TASK_ROWS``."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS)


def solution_facts(solutions: DataFrame, carry: tuple[str, ...], id_col: str = "solution_id", code_col: str = "code") -> DataFrame:
    """(id, ``carry``, parse_error, types): ``source_facts`` joined with the solutions on the id, without shuffling what a parse returns.

    Only rows that repeat an id are joined, so that each meets all sources of the id; rows without one go, as in a join.
    """
    rows = solutions.select(id_col, *carry, code_col).where(F.col(id_col).isNotNull())
    again = materialise(rows.groupBy(id_col).count().where("count > 1").select(id_col), "again")
    parts = task_parts(rows.count(), rows.sparkSession)
    some = bool(again.limit(1).count())
    alone = rows.join(again, id_col, "left_anti") if some else rows
    out = source_facts(alone.repartition(parts, id_col), id_col, code_col, carry=carry, dealt=True)
    if not some:
        return out
    twice = materialise(rows.join(again, id_col, "left_semi"), "twice")
    return out.unionByName(twice.drop(code_col).join(source_facts(twice, id_col, code_col), id_col))


def code_facts(df: DataFrame, id_col: str = "solution_id", code_col: str = "code",
               carry: dict[str, Column] | None = None) -> DataFrame:
    """A9–A13 + A15 + X3 + X5 per solution, as expressions over sums of the source's node types, and the ``carry`` columns.

    Line counts and ``carry`` (named expressions over the source) are JVM expressions, computed after the sources are
    spread over the cores and before the parse.
    """
    derived = {"code_length": line_count(F.col(code_col)), "lines_of_code": nonblank_line_count(F.col(code_col)),
               **(carry or {})}
    carry = tuple(carry or ())
    src = spread(df.select(id_col, code_col), id_col).withColumns(derived)
    agg = source_totals(src, id_col, code_col, carry=tuple(derived), dealt=True).withColumn("recursion_detected", F.col("_calls") > 0)
    err = F.col("parse_error").isNotNull()
    out = agg.select(
        id_col, "code_length", "lines_of_code", "parse_error", "n_nodes", "max_depth", "function_count", "loop_count",
        "loop_nesting_depth", "branch_count", "recursion_detected",
        F.when(err, F.lit(0.0)).when(F.col("function_count") == 0, F.lit(1.0))
         .otherwise(F.col("_documented") / F.col("function_count")).alias("docstring_coverage"),
        F.when(err, F.lit(None).cast("double")).when(F.col("_blocks") == 0, F.lit(1.0))
         .otherwise((F.col("_blocks") + F.col("_block_w")) / F.col("_blocks"))
         .alias("cyclomatic_complexity"),
        (F.col("_blocks") + F.col("_all_w")).alias("_G"),
        "_tot_ops", "_tot_opnds", "_uniq_ops", "_uniq_opnds",
        "_stmts", "_str_lines", *carry,
    )
    out = out.withColumn("big_o_estimate", big_o(F.col("parse_error"), F.col("loop_count"),
                                                 F.col("recursion_detected"),
                                                 F.col("loop_nesting_depth")))
    out = out.withColumn("maintainability_index", _maintainability(err))
    return out.drop("_G", "_tot_ops", "_tot_opnds", "_uniq_ops", "_uniq_opnds", "_stmts", "_str_lines")


def big_o(parse_error: Column, loops: Column, recursive: Column, nesting: Column) -> Column:
    """The heuristic label, first matching rule wins."""
    return (F.when(parse_error.isNotNull(), "unknown")
             .when(recursive & (loops == 0), "O(2^n)")
             .when(recursive, "O(n log n)")
             .when(loops == 0, "O(1)")
             .when(nesting >= 3, "O(n^3)")
             .when(nesting == 2, "O(n^2)")
             .otherwise("O(n)"))


def _maintainability(err: Column) -> Column:
    vocab = F.col("_uniq_ops") + F.col("_uniq_opnds")
    length = F.col("_tot_ops") + F.col("_tot_opnds")
    volume = F.when(vocab > 0, length * F.log2(vocab.cast("double"))).otherwise(F.lit(0.0))
    sloc = F.col("lines_of_code").cast("double")
    comment_pct = F.when(sloc > 0, F.col("_str_lines") * 100.0 / sloc).otherwise(F.lit(0.0))
    raw = (171.0 - 5.2 * F.log(volume) - 0.23 * F.col("_G") - 16.2 * F.log(F.col("_stmts").cast("double"))
           + 50.0 * F.sin(F.sqrt(2.4 * F.radians(comment_pct))))
    mi = F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw * 100.0 / 171.0))
    return (F.when(err, F.lit(None).cast("double"))
             .when((volume <= 0) | (F.col("_stmts") == 0), F.lit(100.0))
             .otherwise(mi))


def node_histogram(facts: DataFrame, id_col: str = "solution_id") -> DataFrame:
    """A9 long form: (id, node_type, n) from ``source_facts``."""
    return facts.select(id_col, F.explode("types").alias("t")).select(id_col, "t.node_type", "t.n")


def node_counts_map(facts: DataFrame, id_col: str = "solution_id") -> DataFrame:
    """A9 map form: (id, node_counts MAP<STRING,INT>); parse errors give an empty map."""
    return facts.select(id_col, F.map_from_entries(F.transform(
        "types", lambda t: F.struct(t["node_type"], t["n"]))).alias("node_counts"))


def register_ast_udtf(spark, name: str = "ast_nodes") -> None:
    """X1 as a Python UDTF for SQL: ``SELECT … FROM t, LATERAL ast_nodes(t.code)``.

    Same facts as ``node_table`` (id columns come from the lateral side).
    ``mapInArrow`` stays the bulk path; the UDTF serves SQL users.
    """
    from pyspark.sql.functions import udtf

    @udtf(returnType="node_id int, parent_id int, depth int, loop_depth int, node_type string, "
                     "name string, call_name string, parse_error string")
    class AstNodes:
        def eval(self, code: str | None):
            for r in guarded_rows(code):
                yield r[0], r[1], r[2], r[3], r[5], r[6], r[7], r[-1]

    spark.udtf.register(name, AstNodes)
