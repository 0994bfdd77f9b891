"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from codescope.session import ensure_checkpoint_dir


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the plan once and stores
    compressed columns. Any executor can read the files, so a lost one costs nothing.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of numbers that share a file of a written table.
FILE_ROWS = 50_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` narrow rows at most, in as many partitions as its files should be."""
    return df.coalesce(1 + rows // FILE_ROWS)
