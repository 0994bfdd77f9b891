"""Binding of the driver's test tables to the engine's roles.

The test tables hold no code corpus, so roles are mapped onto them and all
derivations are Spark expressions (they grow with the tables):

- document corpus (text operators): ``documents`` → solutions with
  solution_id = doc_id, code = text, model = source,
  prompt_id = doc_id div 20, experiment_id = doc_id div 100;
- code corpus (AST operators): ``orders`` → solutions with
  solution_id = o_orderkey, model = o_orderpriority,
  prompt_id = o_orderkey div 20, experiment_id = o_orderkey div 100,
  created_at = o_orderdate, code = CODE_TEMPLATES[o_orderkey % 8] with the
  key spliced into the identifiers;
- execution results: ``labels`` (quality → passed/pass rate; documents
  without a label are not executed) left-joined with ``events``
  (event_id = doc_id: value → runtime_seconds, ts → executed_at);
- prompts: ``benchmark``; embeddings: ``embeddings`` (vec_id = solution_id);
- raw responses: ``conversations`` assistant turns, fenced on even turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.sources.tables import read_table

PROMPT_SIZE = 20          # solutions per prompt (doc_id div 20)
EXPERIMENT_SIZE = 100     # solutions per experiment (doc_id div 100)
KEY_TOKEN = "KEY"

# ---- fixed values: the reference's own test sources (code templates 0..7) ----
CODE_TEMPLATES = [
    "def add_KEY(a, b):\n    return a + b\n",
    'def add_KEY(a, b):\n    """Add two numbers."""\n    return a + b\n',
    "def total_KEY(nums):\n    s = 0\n    for n in nums:\n        s += n\n    return s\n",
    "def total_KEY(nums):\n    if not nums:\n        return 0\n    return nums[0] + total_KEY(nums[1:])\n",
    "def fib_KEY(n):\n    if n <= 1:\n        return n\n    return fib_KEY(n-1) + fib_KEY(n-2)\n",
    "def f_KEY(a):\n    for x in a:\n        for y in x:\n            pass\n",
    "x_KEY = 1 + 1\n",
    "def broken_KEY(:\n    pass",
]
# -------------------------------------------------------------------------------


def template_code(key) -> F.Column:
    """Template source for an integer key column (JVM-side, no Python)."""
    key = F.col(key) if isinstance(key, str) else key
    tmpl = F.element_at(F.array(*[F.lit(t) for t in CODE_TEMPLATES]), (key % 8 + 1).cast("int"))
    return F.replace(tmpl, F.lit(KEY_TOKEN), key.cast("string"))


def doc_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as solutions, spread over the cores (see ``spread``)."""
    from codescope.operators.codefacts import spread
    d = read_table(spark, sf_dir, "documents")
    return spread(d, "doc_id").select(
        F.col("doc_id").alias("solution_id"),
        F.expr(f"doc_id div {PROMPT_SIZE}").alias("prompt_id"),
        F.expr(f"doc_id div {EXPERIMENT_SIZE}").alias("experiment_id"),
        F.col("source").alias("model"),
        F.col("text").alias("code"),
    )


def code_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("solution_id"),
        F.expr(f"o_orderkey div {PROMPT_SIZE}").alias("prompt_id"),
        F.expr(f"o_orderkey div {EXPERIMENT_SIZE}").alias("experiment_id"),
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderdate").alias("created_at"),
        template_code("o_orderkey").alias("code"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """execution_results role: one row per executed solution."""
    lab = read_table(spark, sf_dir, "labels")
    ev = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.col("value").alias("runtime_seconds"),
        F.col("ts").alias("executed_at"))
    return (lab.join(ev, "doc_id", "left")
               .select(F.col("doc_id").alias("solution_id"),
                       F.col("quality").alias("passed_tests"),
                       F.lit(1).alias("total_tests"),
                       F.col("quality").cast("double").alias("pass_rate"),
                       "runtime_seconds", "executed_at"))


def solution_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("solution_id"),
                    F.col("embedding").cast("array<double>").alias("vector"),
                    F.col("label"))


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns; even turns are wrapped in a ```python fence."""
    c = read_table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 2 == 0,
                  F.concat(F.lit("Here is the solution:\n```python\n"), F.col("text"), F.lit("\n```\nDone.")))\
            .otherwise(F.col("text"))
    return c.where(F.col("role") == "assistant").select("conv_id", "turn", text.alias("raw_response"))


# ---- entity tables derived from the test tables (for the relational operators) ----
N_OWNERS = 7
N_MODEL_NAMES = 23          # selections may name src20..src22, which are never registered


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ai_models role: one model per document source (partial aggregation per source)."""
    d = read_table(spark, sf_dir, "documents")
    g = d.groupBy("source").agg(F.min("lang").alias("provider"), F.max("n_chars").alias("mx"))
    return g.select(
        F.concat(F.lit("m-"), F.col("source")).alias("id"), F.col("source").alias("name"),
        "provider", F.lit(None).cast("string").alias("version"),
        F.col("mx").cast("int").alias("context_window"),
        F.when(F.col("mx") % 5 == 0, F.lit(None).cast("boolean")).otherwise(F.col("mx") % 3 != 0)
         .alias("is_active"))


def experiments_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """experiments role: one per o_orderkey div 100."""
    o = read_table(spark, sf_dir, "orders")
    g = (o.groupBy(F.expr(f"o_orderkey div {EXPERIMENT_SIZE}").alias("id"))
          .agg(F.min("o_custkey").alias("c"), F.min("o_orderdate").alias("created_at"),
               F.max("o_orderdate").alias("last")))
    return g.select(
        "id", (F.col("c") % N_OWNERS).alias("owner_id"),
        F.concat(F.lit("exp-"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") % 4 == 0, "completed").when(F.col("id") % 4 == 1, "running")
         .otherwise("pending").alias("status"),
        F.array(F.concat(F.lit("src"), (F.col("id") % 20).cast("string")),
                F.concat(F.lit("src"), ((F.col("id") * 7 + 3) % N_MODEL_NAMES).cast("string")))
         .alias("selected_models"),
        "created_at",
        F.when(F.col("id") % 4 == 0, F.col("last")).alias("completed_at"))


def prompts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompts role: benchmark items, five per experiment."""
    b = read_table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.expr("item_id div 5").alias("experiment_id"),
                    F.col("text").alias("problem_statement"), F.lit("python").alias("language"))


def execution_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sandbox reports derived from ``events``: JSON report text (NULL for
    error events), stdout/stderr, timeout flag and wall time."""
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    total, passed = k % 5, F.least(k % 3, k % 5)
    dur = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(', "duration": '), F.col("value").cast("string")))
    report = F.concat(F.lit('{"summary": {"total": '), total.cast("string"), F.lit(', "passed": '),
                      passed.cast("string"), F.lit("}"), dur, F.lit("}"))
    stderr = (F.when(k % 6 == 0, F.lit("Traceback (most recent call last):\nValueError: bad"))
               .when(k % 6 == 1, F.lit("SyntaxError: invalid syntax"))
               .when(k % 6 == 2, F.lit("MemoryError"))
               .when(k % 6 == 3, F.lit("sandbox infrastructure error"))
               .otherwise(F.lit("")))
    return e.select(
        F.col("event_id").alias("solution_id"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string")).otherwise(report).alias("report_json"),
        F.lit("").alias("stdout"), stderr.alias("stderr"),
        ((F.col("event_type") == "error") & (k % 2 == 0)).alias("timed_out"),
        (F.col("value") + 0.5).alias("wall_time_seconds"))


def prompts_with_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts carrying reference tests: 1 + item_id % 3 cases per benchmark item,
    expected outputs as JSON text (int, bool, string or list)."""
    b = read_table(spark, sf_dir, "benchmark")
    cases = F.transform(
        F.sequence(F.lit(0), (F.col("item_id") % 3).cast("int")),
        lambda i: F.struct(
            F.format_string("f_%d(%d)", F.col("item_id"), i).alias("call"),
            F.when(i % 4 == 0, (F.col("item_id") * 10 + i).cast("string"))
             .when(i % 4 == 1, F.when(F.col("item_id") % 2 == 0, "true").otherwise("false"))
             .when(i % 4 == 2, F.concat(F.lit('"w'), F.col("item_id").cast("string"), F.lit('"')))
             .otherwise(F.concat(F.lit("[1, "), F.col("item_id").cast("string"), F.lit("]")))
             .alias("expected_output")))
    return b.select(F.col("item_id").alias("prompt_id"), cases.alias("reference_tests"))
