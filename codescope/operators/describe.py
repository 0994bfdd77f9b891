"""A1 describe, A3 most-frequent value, A5 Pearson, A6 Spearman, W1 average
ranks. All are grouped aggregations with partial (map-side) aggregation;
the t-distribution UDFs only ever see one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codescope.functions.tdist import t_quantile, t_two_sided_pvalue
from codescope.session import ensure_checkpoint_dir


def _cols(group_cols: Sequence[str] | str | None) -> list[str]:
    if group_cols is None:
        return []
    return [group_cols] if isinstance(group_cols, str) else list(group_cols)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the right side's keys go."""
    right = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"__{k}"])
    return left.join(right, on, how).drop(*[f"__{k}" for k in keys])


def describe_aggs(value: Column, prefix: str = "") -> list[Column]:
    """Partial-aggregate expressions for A1 (finished by ``finish_describe``); the median is ``medians``."""
    v = value.cast("double")
    return [F.avg(v).alias(f"{prefix}mean"), F.stddev_samp(v).alias(f"{prefix}_sd"), F.count(v).alias(f"{prefix}n")]


def _placed_counts(counts: DataFrame, group_cols: list[str], value_col: str, partitions: int | None = None) -> DataFrame:
    """(groups, value, _c) → the same with ``_below``, the rows of smaller values in the group.

    The counts are range-partitioned and written once (reliable checkpoint), because two reads of a range
    partitioning may get different bounds; then rows below = totals of the group's earlier
    partitions + counts before the value in its own. No group is one task's work.
    """
    spark = counts.sparkSession
    ensure_checkpoint_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, value_col]
    placed = (counts.repartitionByRange(parts, *keys).withColumn("_pid", F.spark_partition_id())
                    .checkpoint(eager=True))
    totals = placed.groupBy("_pid", *group_cols).agg(F.sum("_c").alias("_pt"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_pt").over(before), F.lit(0))).drop("_pt")
    inside = Window.partitionBy("_pid", *group_cols).orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    return same_keys(own, offsets, ["_pid", *group_cols], "inner").withColumn(
        "_below", F.col("_off") + F.col("_in")).drop("_pid", "_off", "_in")


def medians(df: DataFrame, values: dict[str, Column], group_cols=None) -> DataFrame:
    """Exact median of each of ``values`` (name → column) per group, by distributed selection.

    Value counts (a partial aggregate), rows below each value, and the one or two values that hold
    the middle rows; no buffer ever holds a group.
    """
    g = _cols(group_cols)
    long = df.select(*g, F.explode(F.array(*[F.struct(F.lit(k).alias("m"), v.cast("double").alias("v"))
                                             for k, v in values.items()])).alias("_x"))
    counts = (long.select(*g, F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v")).where("_v IS NOT NULL")
                  .groupBy(*g, "_m", "_v").agg(F.count(F.lit(1)).alias("_c")))
    placed = _placed_counts(counts, [*g, "_m"], "_v")
    n = placed.groupBy(*g, "_m").agg(F.sum("_c").alias("_n"))
    middle = same_keys(placed, n, [*g, "_m"], "inner").where(
        "(_below < (_n + 1) div 2 AND _below + _c >= (_n + 1) div 2) OR (_below < _n div 2 + 1 AND _below + _c >= _n div 2 + 1)")
    per = middle.groupBy(*g, "_m").agg(((F.min("_v") + F.max("_v")) / 2).alias("_med"))
    out = per.groupBy(*g) if g else per.groupBy()
    return out.agg(*[F.max(F.when(F.col("_m") == k, F.col("_med"))).alias(k) for k in values])


def finish_describe(df: DataFrame, prefix: str = "") -> DataFrame:
    """n=0 → all NULL; n=1 → stdev 0 and the interval collapses; else t interval."""
    n, mean, sd = F.col(f"{prefix}n"), F.col(f"{prefix}mean"), F.col(f"{prefix}_sd")
    stdev = F.when(n == 1, F.lit(0.0)).when(n >= 2, sd)
    margin = t_quantile(0.975, n - 1) * sd / F.sqrt(n.cast("double"))
    low = F.when(n == 1, mean).when(n >= 2, mean - margin)
    high = F.when(n == 1, mean).when(n >= 2, mean + margin)
    return (df.withColumn(f"{prefix}stdev", stdev)
              .withColumn(f"{prefix}ci_95_low", low)
              .withColumn(f"{prefix}ci_95_high", high)
              .drop(f"{prefix}_sd"))


def describe(df: DataFrame, value_col: str, group_cols=None) -> DataFrame:
    """A1: mean, median, stdev (ddof 1), 95 % t interval and n over non-null values."""
    g = _cols(group_cols)
    out = df.groupBy(*g).agg(*describe_aggs(F.col(value_col)))
    med = medians(df, {"median": F.col(value_col)}, g)
    out = same_keys(out, med, g) if g else out.join(med, how="cross")  # one row each
    return finish_describe(out).select(*g, "mean", "median", "stdev", "ci_95_low", "ci_95_high", "n")


def most_frequent(value: Column) -> Column:
    """A3: most frequent non-empty value; ties go to the smallest value."""
    return F.mode(F.when(value != "", value), deterministic=True)


def pearson_aggs(x: Column, y: Column, prefix: str = "") -> list[Column]:
    """Moments over complete pairs only; finished by ``finish_pearson``."""
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return [
        F.count_if(both).alias(f"{prefix}n"),
        F.covar_pop(xx, yy).alias(f"{prefix}_cov"),
        F.stddev_pop(xx).alias(f"{prefix}_sx"),
        F.stddev_pop(yy).alias(f"{prefix}_sy"),
        # exact constant-column test (rounding can leave a tiny non-zero variance)
        ((F.min(xx) == F.max(xx)) | (F.min(yy) == F.max(yy))).alias(f"{prefix}_const"),
    ]


def _r_and_p(df: DataFrame, prefix: str, r_name: str, p_name: str) -> DataFrame:
    n = F.col(f"{prefix}n")
    r = F.try_divide(F.col(f"{prefix}_cov"), F.col(f"{prefix}_sx") * F.col(f"{prefix}_sy"))
    r = F.when((n >= 3) & ~F.col(f"{prefix}_const"), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
    df = df.withColumn(r_name, r)
    rc = F.col(r_name)
    tstat = rc * F.sqrt(F.try_divide((n - 2).cast("double"), 1.0 - rc * rc))
    p = F.when(F.abs(rc) >= 1.0, F.lit(0.0)).otherwise(t_two_sided_pvalue(tstat, n - 2))
    return (df.withColumn(p_name, F.when(rc.isNotNull(), p))
              .drop(f"{prefix}_cov", f"{prefix}_sx", f"{prefix}_sy", f"{prefix}_const"))


def finish_pearson(df: DataFrame, prefix: str = "") -> DataFrame:
    return _r_and_p(df, prefix, f"{prefix}pearson_r", f"{prefix}pearson_p")


def pearson(df: DataFrame, x: str, y: str, group_cols=None) -> DataFrame:
    """A5: Pearson r and two-sided p over complete pairs; n < 3 → NULL, n kept.

    Not ``F.corr``: under ANSI mode it fails on a constant column.
    """
    g = _cols(group_cols)
    aggs = pearson_aggs(F.col(x), F.col(y))
    out = df.groupBy(*g).agg(*aggs) if g else df.agg(*aggs)
    return finish_pearson(out).select(*g, "pearson_r", "pearson_p", "n")


def average_rank(df: DataFrame, value_col: str, group_cols=None, rank_col: str = "rank",
                 partitions: int | None = None) -> DataFrame:
    """Average rank with ties, 1-based, within each group (a NULL group is a group).

    Value counts, then rows below each value (``_placed_counts``): rank = below + (count + 1) / 2,
    joined back to the rows on (group, value).
    """
    g = _cols(group_cols)
    keys = g + [value_col]
    counts = df.where(F.col(value_col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    ranked = _placed_counts(counts, g, value_col, partitions).select(
        *keys, (F.col("_below") + (F.col("_c") + 1) / 2.0).alias(rank_col))
    return same_keys(df, ranked, keys)


def spearman(df: DataFrame, x: str, y: str, group_cols=None) -> DataFrame:
    """Spearman rho and p = Pearson on average ranks of complete pairs."""
    g = _cols(group_cols)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*g, x, y)
    ranked = average_rank(average_rank(pairs, x, g, "_rx"), y, g, "_ry")
    aggs = pearson_aggs(F.col("_rx"), F.col("_ry"))
    out = ranked.groupBy(*g).agg(*aggs) if g else ranked.agg(*aggs)
    return _r_and_p(out, "", "spearman_r", "spearman_p").select(*g, "spearman_r", "spearman_p", "n")


def correlation(df: DataFrame, x: str, y: str, group_cols=None) -> DataFrame:
    """A5 + A6 in one record per group: pearson_r/p, spearman_r/p, n."""
    g = _cols(group_cols)
    p = pearson(df, x, y, g)
    s = spearman(df, x, y, g).drop("n")
    if not g:  # both sides are single-row aggregates: join on a constant key
        p, s, g = p.withColumn("_one", F.lit(1)), s.withColumn("_one", F.lit(1)), ["_one"]
    out = same_keys(p, s, g)
    return out.select(*[c for c in g if c != "_one"],
                      "pearson_r", "pearson_p", "spearman_r", "spearman_p", "n")


def class_balance(df: DataFrame, label_col: str, group_cols=None) -> DataFrame:
    """N, classes, majority baseline, folds = min(5, smallest class), sufficiency."""
    g = _cols(group_cols)
    per_class = df.groupBy(*g, label_col).agg(F.count(F.lit(1)).alias("_k"))
    aggs = [F.sum("_k").alias("n_samples"), F.count(F.lit(1)).alias("n_classes"),
            F.max("_k").alias("_maxk"), F.min("_k").alias("_mink")]
    out = per_class.groupBy(*g).agg(*aggs) if g else per_class.agg(*aggs)
    folds = F.least(F.lit(5), F.col("_mink"))
    return out.select(
        *g, "n_samples", "n_classes",
        (F.col("_maxk") / F.col("n_samples")).alias("baseline_accuracy"),
        folds.cast("int").alias("n_folds"),
        ((F.col("n_classes") >= 2) & (folds >= 2)).alias("sufficient_data"),
    )
