"""Scans of the driver's test tables and of the entity tables under a
declared schema. Column pruning and filter pushdown are left to Catalyst:
callers select what they need and the Parquet scan only reads that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codescope.schema import ENTITY_TABLES, TESTDATA


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one test table (``{sf_dir}/{name}.parquet``) with its declared schema."""
    if name not in TESTDATA:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.schema(TESTDATA[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_entity(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one entity table of the evaluation store (Parquet folder per table)."""
    if name not in ENTITY_TABLES:
        raise ValueError(f"unknown entity table {name!r}")
    return spark.read.schema(ENTITY_TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")
