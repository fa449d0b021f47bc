"""Reading the parquet tables the engine works on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Parquet table ``name`` under ``base``.  Column pruning and filter
    pushdown are left to Catalyst: callers select only what they use."""
    path = os.path.join(base, f"{name}.parquet")
    return spark.read.parquet(path)
