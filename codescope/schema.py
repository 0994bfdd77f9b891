"""Declared schemas: the nine entity tables of the evaluation store and the
record shapes that flow between operators. Nothing is inferred at read time.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


USERS = T.StructType([
    _f("id", S, False), _f("email", S, False), _f("full_name", S), _f("created_at", TS),
])

EXPERIMENTS = T.StructType([
    _f("id", S, False), _f("owner_id", S, False), _f("name", S, False), _f("description", S),
    _f("status", S, False), _f("selected_models", T.ArrayType(S)),
    _f("created_at", TS), _f("completed_at", TS),
])

AI_MODELS = T.StructType([
    _f("id", S, False), _f("name", S, False), _f("provider", S, False), _f("version", S),
    _f("context_window", I), _f("is_active", B),
])

TEST_CASE = T.StructType([_f("call", S), _f("expected_output", T.VariantType())])

PROMPTS = T.StructType([
    _f("id", S, False), _f("experiment_id", S, False), _f("problem_statement", S, False),
    _f("language", S), _f("difficulty", S), _f("reference_tests", T.ArrayType(TEST_CASE)),
    _f("source_dataset", S),
])

GENERATED_SOLUTIONS = T.StructType([
    _f("id", S, False), _f("prompt_id", S, False), _f("model_id", S, False), _f("code", S, False),
    _f("raw_response", S), _f("temperature", D), _f("max_tokens", I), _f("tokens_used", I),
    _f("generation_latency_seconds", D), _f("created_at", TS),
])

EXECUTION_RESULTS = T.StructType([
    _f("id", S, False), _f("solution_id", S, False), _f("passed_tests", I), _f("total_tests", I),
    _f("pass_rate", D), _f("runtime_seconds", D), _f("memory_mb", D), _f("stdout", S),
    _f("stderr", S), _f("error_type", S), _f("executed_at", TS),
])

AST_SUMMARY = T.StructType([
    _f("node_counts", T.MapType(S, I)), _f("max_depth", I), _f("function_count", I),
    _f("loop_count", I), _f("loop_nesting_depth", I), _f("branch_count", I),
    _f("recursion_detected", B), _f("parse_error", S),
])

ANALYSIS_RESULTS = T.StructType([
    _f("id", S, False), _f("solution_id", S, False), _f("lines_of_code", I),
    _f("cyclomatic_complexity", D), _f("big_o_estimate", S), _f("maintainability_index", D),
    _f("style_score", D), _f("pep8_violations", I), _f("docstring_coverage", D),
    _f("ast_summary", AST_SUMMARY),
])

EMBEDDINGS = T.StructType([
    _f("id", S, False), _f("solution_id", S, False), _f("model_name", S),
    _f("vector", T.ArrayType(D)), _f("cluster_label", I),
])

SIMILARITY_SCORES = T.StructType([
    _f("id", S, False), _f("solution_a_id", S, False), _f("solution_b_id", S, False),
    _f("token_similarity", D), _f("ast_similarity", D), _f("embedding_similarity", D),
])

ENTITY_TABLES = {
    "users": USERS,
    "experiments": EXPERIMENTS,
    "ai_models": AI_MODELS,
    "prompts": PROMPTS,
    "generated_solutions": GENERATED_SOLUTIONS,
    "execution_results": EXECUTION_RESULTS,
    "analysis_results": ANALYSIS_RESULTS,
    "embeddings": EMBEDDINGS,
    "similarity_scores": SIMILARITY_SCORES,
}

# Problem-set file (multi-line JSON array); expected outputs stay as JSON text
# until they are rendered (X22), since they are heterogeneous.
PROBLEM_FILE = T.StructType([
    _f("problem_statement", S), _f("language", S), _f("difficulty", S), _f("source_dataset", S),
    _f("reference_tests", T.ArrayType(T.StructType([_f("call", S), _f("expected_output", S)]))),
])

# Raw generation result: success columns nullable, ``error`` set on failure.
GENERATION_RESULT = T.StructType([
    _f("prompt_id", S), _f("model_name", S), _f("code", S), _f("raw_response", S),
    _f("temperature", D), _f("max_tokens", I), _f("tokens_used", I), _f("latency_seconds", D),
    _f("error", S),
])

TEST_REPORT = T.StructType([
    _f("summary", T.StructType([_f("total", I), _f("passed", I)])), _f("duration", D),
])

# Driver test tables (read with these schemas, column pruning by Catalyst).
TESTDATA = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
               "value double, props string"),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
