"""Sources, sinks and table maintenance of the evaluation store.

Tables are Parquet folders, one per entity. Maintenance operations are
set-based DataFrame rewrites (anti/semi joins, window dedup) that produce
the new table version; writing it is the caller's choice of path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.schema import PROBLEM_FILE

# ---- fixed values ----
PROBLEM_SOURCES = {"custom": "custom_problems.json"}
DEFAULT_LANGUAGE = "python"
DEFAULT_STATUS = "pending"
FINAL_STATUSES = ("completed", "failed")
EXECUTION_DEFAULTS = {"passed_tests": 0, "total_tests": 0, "pass_rate": 0.0}
SOLUTION_DEFAULTS = {"temperature": 0.2}
# -----------------------


class DuplicateKeyError(ValueError):
    """Raised by ``enforce_unique(mode='fail')`` with the offending keys."""


def load_problems(spark: SparkSession, folder: str, source: str = "custom") -> DataFrame:
    """Problem-set file (multi-line JSON array) → prompt rows. Unknown source → error before any read."""
    if source not in PROBLEM_SOURCES:
        raise ValueError(f"Unknown problem source: {source}")
    path = f"{folder.rstrip('/')}/{PROBLEM_SOURCES[source]}"
    return spark.read.schema(PROBLEM_FILE).option("multiLine", True).json(path)


def with_generated_id(df: DataFrame, key_cols: list[str], id_col: str = "id") -> DataFrame:
    """Deterministic id from key columns (sha2), stable across retries."""
    return df.withColumn(id_col, F.sha2(F.concat_ws("\u001f", *[F.col(c).cast("string") for c in key_cols]), 256))


def append_rows(df: DataFrame, path: str, defaults: dict[str, object] | None = None,
                key_cols: list[str] | None = None) -> DataFrame:
    """S3: fill defaults, generate ids, append to the table at ``path`` in one bulk write.

    Returns the rows as written (so callers can chain). One write per batch,
    not one commit per row.
    """
    out = df
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v))
    if key_cols:
        out = with_generated_id(out, key_cols)
    out.write.mode("append").parquet(path)
    return out


def enforce_unique(incoming: DataFrame, target: DataFrame | None, key: str, mode: str = "fail",
                   order_col: str | None = None) -> DataFrame:
    """One row per ``key`` (the unique index on solution_id).

    mode 'fail'    → raise DuplicateKeyError listing keys that repeat within
                     the batch or already exist in ``target``;
    mode 'skip'    → keep the first row per key (by ``order_col``, NULL first) not already in target;
    mode 'replace' → latest row per key wins (``order_col``, NULL last to win), replacing target rows.
    Ties, and all rows where there is no ``order_col``, are decided by the other columns' values.
    Returns the rows to write (for 'replace': the whole new table version).
    """
    if mode not in ("fail", "skip", "replace"):
        raise ValueError("mode must be 'fail', 'skip' or 'replace'")
    if mode == "fail":
        dup_in = incoming.groupBy(key).count().where(F.col("count") > 1).select(key)
        dup = dup_in
        if target is not None:
            dup = dup.unionByName(incoming.select(key).join(target.select(key), key, "left_semi"))
        bad = [r[0] for r in dup.distinct().limit(21).collect()]
        if bad:
            raise DuplicateKeyError(f"duplicate {key}: {bad[:20]}{' …' if len(bad) > 20 else ''}")
        return incoming
    # min_by / max_by are partial aggregates: a key repeated a billion times
    # is reduced map-side, never sorted inside one task.
    others = [c for c in incoming.columns if c != key]
    row = F.struct(*others)
    # a struct is never NULL itself, so a row whose order value is NULL still counts (it sorts first)
    order = F.struct(*([F.col(order_col)] if order_col else []), *[F.col(c) for c in others if c != order_col])
    if mode == "skip":
        first = incoming.groupBy(key).agg(F.min_by(row, order).alias("_r")).select(key, "_r.*")
        return first if target is None else first.join(target.select(key), key, "left_anti")
    latest = incoming.groupBy(key).agg(F.max_by(row, order).alias("_r")).select(key, "_r.*")
    if target is None:
        return latest
    return target.join(latest.select(key), key, "left_anti").unionByName(latest, allowMissingColumns=True)


def create_experiments(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Experiment requests → (experiment rows, prompt rows).

    ``requests``: id, owner_id, name, description, selected_models, created_at,
    prompts ARRAY<STRUCT<problem_statement, language, difficulty, reference_tests, source_dataset>>.
    Blank statements are dropped; language defaults to python; status 'pending'.
    """
    exps = requests.select("id", "owner_id", "name", "description",
                           F.lit(DEFAULT_STATUS).alias("status"), "selected_models", "created_at",
                           F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    p = requests.select(F.col("id").alias("experiment_id"), F.posexplode("prompts").alias("pos", "p"))
    prompts = (p.where(F.trim(F.col("p.problem_statement")) != "")
                .select(F.sha2(F.concat_ws(":", F.col("experiment_id").cast("string"),
                                           F.col("pos").cast("string")), 256).alias("id"),
                        "experiment_id", F.col("p.problem_statement").alias("problem_statement"),
                        F.coalesce(F.col("p.language"), F.lit(DEFAULT_LANGUAGE)).alias("language"),
                        F.col("p.difficulty").alias("difficulty"),
                        F.col("p.source_dataset").alias("source_dataset")))
    return exps, prompts


def upsert_registry(registry: DataFrame, incoming: DataFrame, order_col: str | None = None) -> DataFrame:
    """First registration of a name wins; later ones (in or across batches) are no-ops.

    First by ``order_col`` (NULL first); ties, or no order column, go to the smallest row by its values.
    """
    first = enforce_unique(incoming, None, "name", mode="skip", order_col=order_col)
    new = first.join(registry.select("name"), "name", "left_anti")
    return registry.unionByName(new.select(*registry.columns))


def update_status(experiments: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """Apply (id, status) changes; completed_at set only for completed/failed.

    Unknown ids in ``changes`` are no-ops (left join from the experiments); of several changes of one id
    the last by its status name counts, so no experiment is repeated.
    """
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    ch = changes.groupBy("id").agg(F.max("status").alias("_new"))
    j = experiments.join(ch, "id", "left")
    status = F.coalesce(F.col("_new"), F.col("status"))
    completed = F.when(F.col("_new").isin(*FINAL_STATUSES), now).otherwise(F.col("completed_at"))
    return j.withColumn("status", status).withColumn("completed_at", completed).drop("_new") \
            .select(*experiments.columns)


def cascade_delete(doomed_experiments: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Remove experiments and everything under them.

    experiments → prompts → generated_solutions → execution/analysis/embedding
    rows, plus similarity pairs touching a removed solution. Each level is a
    ``left_anti`` against the doomed key set of the level above; the planner
    broadcasts a key set whose bytes are under its threshold.
    """
    ex_ids = doomed_experiments.select(F.col("id").alias("experiment_id")).distinct()
    out = dict(tables)
    out["experiments"] = tables["experiments"].join(ex_ids.withColumnRenamed("experiment_id", "id"), "id", "left_anti")
    pr = tables["prompts"]
    doomed_prompts = pr.join((ex_ids), "experiment_id", "left_semi").select(F.col("id").alias("prompt_id"))
    out["prompts"] = pr.join((ex_ids), "experiment_id", "left_anti")
    sol = tables["generated_solutions"]
    doomed_sol = sol.join(doomed_prompts, "prompt_id", "left_semi").select(F.col("id").alias("solution_id"))
    out["generated_solutions"] = sol.join(doomed_prompts, "prompt_id", "left_anti")
    for t in ("execution_results", "analysis_results", "embeddings"):
        if t in tables:
            out[t] = tables[t].join(doomed_sol, "solution_id", "left_anti")
    if "similarity_scores" in tables:
        s = tables["similarity_scores"]
        out["similarity_scores"] = (s.join(doomed_sol.withColumnRenamed("solution_id", "solution_a_id"),
                                           "solution_a_id", "left_anti")
                                     .join(doomed_sol.withColumnRenamed("solution_id", "solution_b_id"),
                                           "solution_b_id", "left_anti"))
    return out


def results_document(leaderboard: DataFrame, group_col: str = "experiment_id",
                     summary: DataFrame | None = None) -> DataFrame:
    """Nested JSON per experiment: {experiment_id, models: [leaderboard rows in order], analytics: {…}}.

    The per-experiment list is bounded by the number of models; ``summary`` (A4) has one row per experiment.
    """
    rows = leaderboard.groupBy(group_col).agg(
        F.array_sort(F.collect_list(F.struct("position", F.struct(*[c for c in leaderboard.columns
                                                                       if c != group_col]).alias("row"))))
         .alias("_r"))
    parts = [F.col(group_col), F.transform("_r", lambda x: x["row"]).alias("models")]
    if summary is not None:
        rows = rows.join(summary.select(group_col, F.struct(*[c for c in summary.columns if c != group_col])
                                        .alias("analytics")), group_col, "left")
        parts.append(F.col("analytics"))
    return rows.select(group_col, F.to_json(F.struct(*parts)).alias("document"))
