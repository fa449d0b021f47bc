"""Persisted index tables, upsert / delete / point fetch by id.

Tables are plain Parquet folders ``<base>/<table>/v=<n>-<token>``, each written
once under a name of its own; a version becomes current when its row in
``<base>/_versions`` is written after its data.  A reader never sees a
half-written version, no published path is ever written again, and only a
missing versions folder counts as "no table yet": other errors are raised.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _versions(spark: SparkSession, base: str) -> DataFrame | None:
    path = os.path.join(base, "_versions")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(path)


def _newest(spark: SparkSession, base: str, version: int | None = None):
    versions = _versions(spark, base)
    if versions is None:
        return None
    if version is not None:
        versions = versions.where(F.col("version") == version)
    return versions.orderBy(F.desc("version"), "token").select("version", "token").first()


def current_version(spark: SparkSession, base: str) -> int | None:
    row = _newest(spark, base)
    return None if row is None else row.version


def is_committed(spark: SparkSession, base: str, stream_id: str, batch_id: int) -> bool:
    """Whether the stream's batch is in a published version."""
    versions = _versions(spark, base)
    return versions is not None and not versions.where((F.col("batch_id") == batch_id) & (F.col("stream_id") == stream_id)).isEmpty()


def write_tables(spark: SparkSession, base: str, tables: dict[str, DataFrame],
                 batch_id: int | None = None, stream_id: str | None = None) -> int:
    """Write every table as a new version, then publish the version (with the
    stream's id and batch id, if any, so a replayed batch can be recognised)."""
    v, token = (current_version(spark, base) or 0) + 1, uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(os.path.join(base, name, f"v={v}-{token}"))
    (spark.createDataFrame([(v, token, stream_id, batch_id, list(tables))],
                           "version int, token string, stream_id string, batch_id long, tables array<string>")
          .withColumn("committed_at", F.current_timestamp())
          .coalesce(1).write.mode("append").parquet(os.path.join(base, "_versions")))
    return v


def read_table(spark: SparkSession, base: str, name: str, version: int | None = None) -> DataFrame | None:
    row = _newest(spark, base, version)
    return None if row is None else spark.read.parquet(os.path.join(base, name, f"v={row.version}-{row.token}"))


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id",
           order_col: str | None = None) -> DataFrame:
    """S3: replace rows of ``old`` whose key appears in ``new``; ``new`` keeps
    one row per key (the greatest ``order_col`` if given: last write wins)."""
    if order_col:
        w = Window.partitionBy(key).orderBy(F.col(order_col).desc())
        new = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    else:
        new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Drop rows whose key is listed."""
    return table.join(ids.select(key), key, "left_anti")


def fetch_ids(table: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Point fetch; the id list joins on the key (AQE broadcasts it when small)."""
    return ids.join(table, key, "inner")
