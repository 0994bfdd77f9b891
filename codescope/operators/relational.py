"""Projections, lookups, joins, set logic and paging over the entity tables.

P1–P8, J2, J4–J6, J8, E1–E4, O1–O2. Small dimensions (model registry, rate
table) carry no hint: the planner and AQE broadcast a side whose bytes are under
the session's threshold and shuffle otherwise, and no job runs while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_DEFAULT, PAGE_CEILING = 50, 100


# ---------------------------------------------------------------- P: lookups
def point_lookup(df: DataFrame, col: str, value) -> DataFrame:
    """The row with ``col == value`` (at most one); missing → empty."""
    return df.where(F.col(col) == F.lit(value)).limit(1)


def active_only(models: DataFrame) -> DataFrame:
    """``is_active IS TRUE`` (NULL excluded)."""
    return models.where(F.col("is_active").eqNullSafe(True))


def owned_by(experiments: DataFrame, owner_id) -> DataFrame:
    """Only the owner's experiments; foreign rows look absent."""
    return experiments.where(F.col("owner_id") == F.lit(owner_id))


def owned_rows(rows: DataFrame, experiments: DataFrame, owner_id, key: str = "experiment_id") -> DataFrame:
    """P3 for children: keep rows whose experiment belongs to the owner (semi join)."""
    mine = owned_by(experiments, owner_id).select(F.col("id").alias(key))
    return rows.join(mine, key, "left_semi")


def solution_summary(solutions: DataFrame, prompts: DataFrame, models: DataFrame) -> DataFrame:
    """Solution + problem statement + model name (J1 shape, projected)."""
    return (solutions.join(prompts.select(F.col("id").alias("prompt_id"), "problem_statement"),
                           "prompt_id", "left")
                     .join((models.select(F.col("id").alias("model_id"),
                                               F.col("name").alias("model_name"))), "model_id", "left")
                     .select("solution_id", "prompt_id", "problem_statement", "model_name"))


def solution_card(solutions: DataFrame, executions: DataFrame, analysis: DataFrame,
                  solution_id) -> DataFrame:
    """One solution with left-joined metrics; NULL when not executed/analysed."""
    one = solutions.where(F.col("solution_id") == F.lit(solution_id))
    return (one.join(executions.where(F.col("solution_id") == F.lit(solution_id)), "solution_id", "left")
               .join(analysis.where(F.col("solution_id") == F.lit(solution_id)), "solution_id", "left"))


def distinct_prompts(solutions: DataFrame) -> DataFrame:
    """One row per prompt with its first-appearing solution and a default flag."""
    firsts = solutions.groupBy("prompt_id").agg(F.min("solution_id").alias("first_solution_id"))
    first_prompt = firsts.agg(F.min(F.struct("first_solution_id", "prompt_id")).alias("m"))
    return (firsts.join(first_prompt.select(F.col("m.prompt_id").alias("_dp")),
                        F.col("prompt_id") == F.col("_dp"), "left")
                  .select("prompt_id", "first_solution_id", F.col("_dp").isNotNull().alias("is_default")))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``coalesce(c, default)`` for each named column."""
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
                       for c in df.columns])


# --------------------------------------------------------- P7 / E1 / E2: selection
def selection_violations(experiments: DataFrame, models: DataFrame) -> DataFrame:
    """P7 + E1: selected names that are not registered or not active, per experiment.

    Output: experiment_id, model_name, reason ('unregistered' | 'inactive').
    Experiments with no selection get one row with reason 'no_models'.
    """
    picked = experiments.select(F.col("id").alias("experiment_id"),
                                F.explode_outer("selected_models").alias("model_name"))
    reg = (models.select(F.col("name").alias("model_name"), "is_active",
                              F.lit(True).alias("_registered")))
    joined = picked.join(reg, "model_name", "left")
    reason = (F.when(F.col("model_name").isNull(), "no_models")
               .when(F.col("_registered").isNull(), "unregistered")
               .when(~F.col("is_active").eqNullSafe(True), "inactive"))
    return (joined.withColumn("reason", reason)
                  .where(F.col("reason").isNotNull())
                  .select("experiment_id", "model_name", "reason"))


def selected_registered(experiments: DataFrame, models: DataFrame) -> DataFrame:
    """Selected ∩ active registry (only these are run)."""
    picked = experiments.select(F.col("id").alias("experiment_id"),
                                F.explode("selected_models").alias("name"))
    return picked.join((active_only(models).select("name", F.col("id").alias("model_id"))),
                       "name", "inner")


def generation_plan(experiments: DataFrame, prompts: DataFrame, models: DataFrame) -> DataFrame:
    """Prompts × selected active models, per experiment (equi join on experiment)."""
    runs = selected_registered(experiments, models)
    return (prompts.select(F.col("id").alias("prompt_id"), "experiment_id", "problem_statement")
                   .join(runs, "experiment_id", "inner")
                   .select("experiment_id", "prompt_id", "model_id", F.col("name").alias("model_name"),
                           "problem_statement"))


def attach_model_id(results: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve registered model names; returns (resolved, unresolved)."""
    reg = (models.select(F.col("name").alias("model_name"), F.col("id").alias("model_id")))
    return results.join(reg, "model_name", "inner"), results.join(reg, "model_name", "left_anti")


def outcome_split(plan: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(successes, errors, gaps) of a generation run.

    successes: result rows without error; errors: rows with an error; gaps:
    planned (prompt, model) cells with no success at all.
    """
    ok = results.where(F.col("error").isNull())
    bad = results.where(F.col("error").isNotNull())
    gaps = plan.join(ok.select("prompt_id", "model_name").distinct(), ["prompt_id", "model_name"], "left_anti")
    return ok, bad, gaps


def all_outcomes(successes: DataFrame, errors: DataFrame) -> DataFrame:
    """Union of success and error records (missing columns NULL)."""
    return successes.unionByName(errors, allowMissingColumns=True)


def with_rate(df: DataFrame, rates: DataFrame, default_rate: float = 0.03) -> DataFrame:
    """Left join a per-model rate table (a dimension join), default rate."""
    r = (rates.select("model_name", F.col("rate_per_1k").alias("_rate")))
    return df.join(r, "model_name", "left").withColumn(
        "rate_per_1k", F.coalesce(F.col("_rate"), F.lit(default_rate))).drop("_rate")


# ------------------------------------------------------------------ O: paging
def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = PAGE_DEFAULT) -> DataFrame:
    """O1/O2: ordered page; the limit is capped at 100 (TakeOrderedAndProject)."""
    limit = max(0, min(int(limit), PAGE_CEILING))
    return df.orderBy(*order).offset(max(0, int(skip))).limit(limit)


def list_models(models: DataFrame, skip: int = 0, limit: int = PAGE_DEFAULT, active: bool = True):
    """O1: registry by name."""
    src = active_only(models) if active else models
    return page(src, [F.col("name")], skip, limit)


def list_experiments(experiments: DataFrame, owner_id, skip: int = 0, limit: int = PAGE_DEFAULT):
    """O2: owner's experiments, newest first (id breaks ties)."""
    return page(owned_by(experiments, owner_id), [F.col("created_at").desc(), F.col("id")], skip, limit)
