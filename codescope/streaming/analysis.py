"""ST1–ST3: the incremental behaviours as Structured Streaming queries.

Every stream writes to a folder under the cluster's shared checkpoint
directory (``spark.checkpoint.dir``, read from the session) with a
checkpoint location next to it, so a restarted driver or lost executor
resumes from the last committed batch. Each micro-batch writes
``…/batch=<epoch>`` with overwrite, which makes a replayed epoch
idempotent and never replaces what a reader has open.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.functions.lint import lint_counts, style_score, violation_density, violation_total
from codescope.functions.tdist import t_quantile
from codescope.operators.codefacts import code_facts
from codescope.session import ensure_checkpoint_dir

def stream_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream's output + checkpoint in the shared checkpoint dir."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/codescope-streams/{name}-{uuid.uuid4().hex[:12]}"


def _run(writer, available_now: bool = True):
    q = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        q.awaitTermination()
    return q


def analyse_on_arrival(stream: DataFrame, out_dir: str, id_col: str = "solution_id", code_col: str = "code",
                       available_now: bool = True, ts_col: str | None = None, keep: str = "30 days"):
    """ST1: each arriving micro-batch of solutions → code facts and style columns, appended to ``out_dir``.

    S4 within the stream: an id is analysed once, as it first arrives. The ids seen are keyed state, dealt by a hash of
    the id, so the cost of a batch depends on its own rows and not on what was written before. Without ``ts_col`` an id is
    remembered for good; with it, for ``keep`` of event time after it came, which bounds the state: a repeat after that is
    analysed again, and a row more than ``keep`` older than the newest of earlier batches is late and left out. Of different sources with one id in one batch the one read first counts. All rows
    without an id are one. A source that does not parse yields an error row (X1 never raises), so one bad
    solution cannot stop the run.
    """
    if ts_col is None:
        new = stream.select(id_col, code_col).dropDuplicates([id_col])
    else:
        new = (stream.select(id_col, code_col, F.col(ts_col).cast("timestamp").alias("_ts")).withWatermark("_ts", keep)
               .dropDuplicatesWithinWatermark([id_col]).drop("_ts"))

    def per_batch(df: DataFrame, epoch: int):
        style_facts(df, id_col, code_col).write.mode("overwrite").parquet(f"{out_dir}/data/batch={epoch}")

    w = (new.writeStream.foreachBatch(per_batch)
            .option("checkpointLocation", f"{out_dir}/_checkpoint"))
    return _run(w, available_now)


def style_facts(df: DataFrame, id_col: str = "solution_id", code_col: str = "code") -> DataFrame:
    """Code facts with ``pep8_violations`` and ``style_score`` (X7), one row per row of ``df``, which is read once."""
    facts = code_facts(df, id_col, code_col, carry={"_lint": lint_counts(F.col(code_col))})
    total = violation_total(F.col("_lint"), F.col("parse_error"))
    return (facts.withColumn("pep8_violations", total)
                 .withColumn("style_score", style_score(violation_density(total, F.col("lines_of_code")),
                                                        F.col("docstring_coverage"))).drop("_lint"))


STATE = ("n_solutions", "n_exec", "c_mean", "c_m2", "rt_sum", "rt_n")


def live_leaderboard_state(solutions: DataFrame, executions: DataFrame, out_dir: str,
                           available_now: bool = True):
    """ST2: per-model parts of the leaderboard from two streams, one partial row per model and micro-batch.

    ``solutions`` (solution_id, model) and ``executions`` (solution_id, model, pass_rate,
    runtime_seconds) arrive in any order: an execution names its model, so it counts when it arrives.
    A batch writes count, mean and squared deviations (never a difference of large sums), which
    ``read_leaderboard`` merges; no state is kept in memory and nothing written is replaced.
    """
    none = F.lit(None).cast("double")
    rows = solutions.select("model", F.lit(1).alias("sol"), none.alias("pass_rate"), none.alias("runtime_seconds")).unionByName(
        executions.select("model", F.lit(0).alias("sol"), "pass_rate", "runtime_seconds"))

    def per_batch(df: DataFrame, epoch: int):
        df.groupBy("model").agg(
            F.sum("sol").alias("n_solutions"), F.count("pass_rate").alias("n_exec"),
            F.avg("pass_rate").alias("c_mean"),
            (F.var_pop("pass_rate") * F.count("pass_rate")).alias("c_m2"),
            F.sum("runtime_seconds").alias("rt_sum"), F.count("runtime_seconds").alias("rt_n"),
        ).write.mode("overwrite").parquet(f"{out_dir}/state/batch={epoch}")

    w = rows.writeStream.foreachBatch(per_batch).option("checkpointLocation", f"{out_dir}/_checkpoint")
    return _run(w, available_now)


def read_leaderboard(spark: SparkSession, out_dir: str) -> DataFrame:
    """Merge the parts: means weighted by count, squared deviations by the parallel variance rule."""
    parts = spark.read.parquet(f"{out_dir}/state")
    total = parts.groupBy("model").agg(
        F.sum("n_solutions").alias("n_solutions"), F.sum("n_exec").alias("n"),
        F.try_divide(F.sum(F.col("c_mean") * F.col("n_exec")), F.sum("n_exec")).alias("m"),
        F.sum("rt_sum").alias("rt_sum"), F.sum("rt_n").alias("rt_n"))
    spread = (parts.join(total.select("model", "m"), "model").groupBy("model").agg(
        F.sum(F.col("c_m2") + F.col("n_exec") * (F.col("c_mean") - F.col("m")) ** 2).alias("m2")))
    s = total.join(spread, "model")
    n, mean = F.col("n"), F.col("m")
    sd = F.sqrt(F.try_divide(F.col("m2"), n - 1))
    margin = t_quantile(0.975, n - 1) * sd / F.sqrt(n.cast("double"))
    return s.select(
        "model", mean.alias("correctness"),
        F.when(n == 1, mean).when(n >= 2, mean - margin).alias("correctness_ci_low"),
        F.when(n == 1, mean).when(n >= 2, mean + margin).alias("correctness_ci_high"),
        F.try_divide(F.col("rt_sum"), F.col("rt_n")).alias("avg_runtime_s"), "n_solutions")


def rate_breaches(stream: DataFrame, key_cols: list[str], ts_col: str, limit: int,
                  window: str = "1 minute", watermark: str = "1 minute") -> DataFrame:
    """ST3: more than ``limit`` requests per key in a tumbling ``window``.

    The event time is cast to TIMESTAMP (session zone UTC; the watermark refuses TIMESTAMP_NTZ).
    A row later than the watermark belongs to a window already closed.
    """
    ev = stream.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", watermark)
    counts = ev.groupBy(F.window("_ts", window).alias("w"), *key_cols).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > limit).select(
        *key_cols, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def run_rate_breaches(breaches: DataFrame, out_dir: str, available_now: bool = True):
    """Sink for ST3: update mode, one folder per epoch, state purged behind the watermark.

    A window that grows is written again in a later epoch; ``read_breaches`` takes its latest count.
    """
    def per_batch(df: DataFrame, epoch: int):
        df.write.mode("overwrite").parquet(f"{out_dir}/state/batch={epoch}")

    w = (breaches.writeStream.outputMode("update").foreachBatch(per_batch)
            .option("checkpointLocation", f"{out_dir}/_checkpoint"))
    return _run(w, available_now)


def read_breaches(spark: SparkSession, out_dir: str, key_cols: list[str]) -> DataFrame:
    """The breaches known so far: the largest (latest) count of each key and window."""
    return spark.read.parquet(f"{out_dir}/state").groupBy(*key_cols, "window_start", "window_end").agg(
        F.max("n").alias("n"))
