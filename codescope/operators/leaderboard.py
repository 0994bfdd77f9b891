"""J1 fact load, A2 leaderboard (with A1, A3, W3, O3) and A4 experiment summary.

Plan shape at scale: solutions, executions and analysis are all keyed by
solution_id (1:1), so J1 is two sort-merge joins on one hash partitioning of
solution_id (one exchange per input, none between the joins). The model
aggregation is a partial + final hash aggregate: the shuffle after the join
carries one row per (task, model), however many solutions there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codescope.operators.describe import (
    describe_aggs, finish_describe, finish_pearson, medians, most_frequent, pearson_aggs, same_keys, spearman,
)
from codescope.sources.scratch import materialise


def fact_load(solutions: DataFrame, executions: DataFrame | None = None,
              analysis: DataFrame | None = None, embeddings: DataFrame | None = None) -> DataFrame:
    """Exactly one row per solution with its (optional) 1:1 children."""
    out = solutions
    for child in (executions, analysis, embeddings):
        if child is not None:
            out = out.join(child, "solution_id", "left")
    return out


def leaderboard(facts: DataFrame, model_col: str = "model", group_cols=None) -> DataFrame:
    """A2: one row per model (and group), ordered by correctness (NULL last), then first appearance.

    correctness = mean pass rate over executed solutions with its 95 % t
    interval; avg_runtime_s over non-null runtimes; complexity = most frequent
    non-empty Big-O label; n_solutions counts every solution. ``group_cols`` gives a leaderboard
    for each group, such as each experiment, in one pass.
    """
    g = [group_cols] if isinstance(group_cols, str) else list(group_cols or [])
    agg = facts.groupBy(*g, model_col).agg(
        *describe_aggs(F.col("pass_rate"), prefix="c_"),
        F.avg("runtime_seconds").alias("avg_runtime_s"),
        most_frequent(F.col("big_o_estimate")).alias("complexity"),
        F.count(F.lit(1)).alias("n_solutions"),
        F.min("solution_id").alias("first_seen"),
    )
    agg = finish_describe(agg, prefix="c_")
    # O3 over at most #models rows of a group: a window without further split is fine here.
    order = Window.partitionBy(*g).orderBy(F.col("c_mean").desc_nulls_last(), F.col("first_seen"))
    return agg.select(
        *g, F.col(model_col).alias("model"),
        F.col("c_mean").alias("correctness"),
        F.col("c_ci_95_low").alias("correctness_ci_low"),
        F.col("c_ci_95_high").alias("correctness_ci_high"),
        "avg_runtime_s", "complexity", "n_solutions",
        F.row_number().over(order).alias("position"),
    )


def experiment_summary(facts: DataFrame, group_col: str = "experiment_id", fingerprints: DataFrame | None = None) -> DataFrame:
    """A4: per experiment n_solutions, describe(code length / pass rate / complexity) and the
    code-length vs pass-rate Pearson and Spearman correlations, flattened.

    ``facts`` has ``code_length`` (from the analysis), so no source text travels here. Four numbers a row are
    written first: every statistic reads them, and the sources are parsed once. ``fingerprints`` (M6 per group, see
    ``forest.fingerprint_by``) adds the accuracy of telling models apart.
    """
    facts = materialise(facts.select(group_col, "code_length", "pass_rate", "cyclomatic_complexity"), "facts")
    length = F.col("code_length")
    executed = F.col("pass_rate").isNotNull()
    values = {"len_": length, "pass_": F.col("pass_rate"), "cc_": F.col("cyclomatic_complexity")}
    agg = facts.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n_solutions"),
        *[c for p, v in values.items() for c in describe_aggs(v, prefix=p)],
        *pearson_aggs(F.when(executed, length), F.col("pass_rate"), prefix="corr_"),
    )
    for p in values:
        agg = finish_describe(agg, prefix=p)
    out = finish_pearson(agg, prefix="corr_")
    med = medians(facts, {f"{p}median": v for p, v in values.items()}, group_col)
    rho = spearman(facts, "code_length", "pass_rate", group_col).select(
        group_col, F.col("spearman_r").alias("corr_spearman_r"), F.col("spearman_p").alias("corr_spearman_p"))
    out = same_keys(same_keys(out, med, [group_col]), rho, [group_col])
    if fingerprints is not None:
        named = fingerprints.select(group_col, *[F.col(c).alias(f"fingerprint_{c}") for c in fingerprints.columns if c != group_col])
        out = same_keys(out, named, [group_col])
    return out
