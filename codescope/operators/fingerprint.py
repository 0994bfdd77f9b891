"""W2 stratified folds and M6 model fingerprint classifier.

The classifier is one distributed ``pyspark.ml`` fit over all rows (no
per-group driver loop): StringIndexer → VectorAssembler → RandomForest
inside CrossValidator with a precomputed stratified fold column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.operators.describe import average_rank, class_balance
from codescope.session import ensure_checkpoint_dir
from codescope.sources.scratch import materialise


def stratified_folds(df: DataFrame, id_col: str, label_col: str, folds: int = 5,
                     seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """Rows ordered by a seeded hash inside each label, dealt round-robin to folds.

    The per-label order comes from the distributed rank (``average_rank``),
    so a label holding a third of all rows is not sorted inside one task.
    """
    keyed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col)).cast("binary")))
    ranked = average_rank(keyed, "_h", label_col, "_r")
    return ranked.withColumn(fold_col, ((F.floor(F.col("_r")) - 1) % folds).cast("int")).drop("_h", "_r")


#: Rows beyond this are bagged in blocks of equal rows, and features have the BINS (quantiles) that a tree tells apart.
ROWS, BINS = 100_000, 32


def equal_rows(data: DataFrame, feature_cols: list[str], others: list[str], n: int, rows: int = ROWS) -> DataFrame:
    """``data`` with a weight ``_w``: rows equal in features and ``others`` become blocks of at most ``ceil(n / rows)`` rows.

    With more than ``rows`` rows, a feature of more than BINS values becomes the number of its quantile bin, so there are
    ``rows`` blocks and one for each combination of bins at most. All rows count: the weights add up to ``n``.
    """
    if n <= rows:
        return data.withColumn("_w", F.lit(1.0))
    cuts = data.agg(*[F.percentile_approx(c, [q / BINS for q in range(1, BINS)], 10_000).alias(c) for c in feature_cols],
                    *[F.approx_count_distinct(c).alias(f"_n_{c}") for c in feature_cols]).first()
    for c in feature_cols:
        if cuts[f"_n_{c}"] > BINS // 2:
            data = data.withColumn(c, sum((F.when(F.col(c) > x, 1.0).otherwise(0.0) for x in sorted(set(cuts[c]))), F.lit(0.0)))
    alike = data.groupBy(*feature_cols, *others).agg(F.count(F.lit(1)).alias("_n"))
    size = -(-n // rows)
    blocks = alike.withColumn("_b", F.ceil(F.col("_n") / size)).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), "_b")))
    share = F.expr("_n div _b") + (F.col("_i") <= F.col("_n") % F.col("_b")).cast("int")
    return blocks.select(*feature_cols, *others, share.cast("double").alias("_w"))


def fingerprint(df: DataFrame, feature_cols: list[str], label_col: str, id_col: str = "solution_id",
                seed: int = 42, num_trees: int = 100) -> DataFrame:
    """M6: cross-validated accuracy of predicting the model from code features.

    Trees are grown from equal rows with weights (``equal_rows``), so their work follows the distinct rows.

    Returns one row: cv_accuracy, cv_accuracy_std (population), n_samples,
    n_classes, baseline_accuracy, sufficient_data. Insufficient data (fewer
    than 2 classes or a class with fewer than 2 rows) → NULL scores.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    spark = df.sparkSession
    written = materialise(df.select(id_col, *feature_cols, label_col), "features")  # many rows are parsed once, and read for balance, ranks and cells
    bal = class_balance(written, label_col).first()
    n_folds = int(bal["n_folds"] or 0)
    row = dict(n_samples=int(bal["n_samples"] or 0), n_classes=int(bal["n_classes"] or 0),
               baseline_accuracy=float(bal["baseline_accuracy"] or 0.0),
               sufficient_data=bool(bal["sufficient_data"]), cv_accuracy=None, cv_accuracy_std=None)
    if row["n_samples"] > ROWS:
        df = written
    if row["sufficient_data"]:
        data = stratified_folds(df.select(id_col, *feature_cols, label_col),
                                id_col, label_col, folds=n_folds, seed=seed)
        data = data.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feature_cols],
                           label_col, "fold")
        data = equal_rows(data, feature_cols, [label_col, "fold"], row["n_samples"])
        # Each fold fit re-reads its input many times: cut the lineage once
        # (reliable checkpoint in the shared spark.checkpoint.dir).
        ensure_checkpoint_dir(spark)
        data = data.checkpoint(eager=True)
        data = StringIndexer(inputCol=label_col, outputCol="_y").fit(data).transform(data).checkpoint(eager=True)
        rf = RandomForestClassifier(labelCol="_y", featuresCol="_x", weightCol="_w", numTrees=num_trees, seed=seed,
                                    maxDepth=30, featureSubsetStrategy="sqrt")
        pipe = Pipeline(stages=[VectorAssembler(inputCols=feature_cols, outputCol="_x"), rf])
        ev = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="prediction", metricName="accuracy", weightCol="_w")
        cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev,
                            numFolds=n_folds, foldCol="fold", seed=seed,
                            parallelism=n_folds)
        model = cv.fit(data)
        row["cv_accuracy"] = float(model.avgMetrics[0])
        row["cv_accuracy_std"] = float(model.stdMetrics[0]) if model.stdMetrics else None
    schema = ("cv_accuracy double, cv_accuracy_std double, n_samples long, n_classes long, "
              "baseline_accuracy double, sufficient_data boolean")
    return spark.createDataFrame([row], schema)
