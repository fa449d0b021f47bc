"""S2, incremental: index tables kept as append-only deltas.

A batch appends its own rows to each table, as one Parquet folder under a name
of its own, and counts from the moment its row in ``_commits`` is written, after
its data: readers never see half a batch, and a writer that dies leaves only
folders that no commit names. What a batch writes follows what it changes.

Readers merge: a key's newest row wins (``newest``), and a deletion is a row
like any other. ``compact`` writes the merged tables as the first batch of a new
generation, apart from the batches that readers and writers work on; it bounds
how many folders a reader opens. One writer at a time per base folder.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = "generation long, batch long, token string, stream_id string, stream_batch long, tables array<string>"


def _commits(spark: SparkSession, base: str) -> DataFrame | None:
    path = os.path.join(base, "_commits")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(_COMMIT).parquet(path)


@dataclass(frozen=True)
class Log:
    """The newest generation's batches, oldest first, as (batch, token, tables); compaction bounds their number."""

    generation: int
    batches: tuple

    @property
    def next_batch(self) -> int:
        return self.batches[-1][0] + 1 if self.batches else 0

    def folders(self, base: str, name: str) -> list[str]:
        return [os.path.join(base, name, f"{batch}-{token}") for batch, token, tables in self.batches if name in tables]


def log(spark: SparkSession, base: str) -> Log | None:
    """What is committed; None before the first batch."""
    commits = _commits(spark, base)
    newest = None if commits is None else commits.agg(F.max("generation")).first()[0]
    if newest is None:
        return None
    rows = commits.where(F.col("generation") == newest).select("batch", "token", "tables").orderBy("batch").collect()
    return Log(newest, tuple((r.batch, r.token, tuple(r.tables)) for r in rows))


def is_applied(spark: SparkSession, base: str, stream_id: str, stream_batch: int) -> bool:
    """Whether a stream's batch is committed, in any generation."""
    commits = _commits(spark, base)
    return commits is not None and not commits.where(
        (F.col("stream_id") == stream_id) & (F.col("stream_batch") == stream_batch)).isEmpty()


def append(spark: SparkSession, base: str, tables: dict[str, DataFrame], batch: int, generation: int = 0,
           stream_id: str | None = None, stream_batch: int | None = None) -> int:
    """Write each table's rows of this batch (with a column ``batch``), then commit them together."""
    token = uuid.uuid4().hex
    for name, df in tables.items():
        df.withColumn("batch", F.lit(batch).cast("long")).write.parquet(os.path.join(base, name, f"{batch}-{token}"))
    (spark.createDataFrame([(generation, batch, token, stream_id, stream_batch, list(tables))], _COMMIT)
          .coalesce(1).write.mode("append").parquet(os.path.join(base, "_commits")))
    return batch


def read(spark: SparkSession, base: str, name: str, at: Log | None = None) -> DataFrame | None:
    """Every committed row of a table with its ``batch``; None if no batch has the table."""
    at = at or log(spark, base)
    folders = at.folders(base, name) if at else []
    return spark.read.parquet(*folders) if folders else None


def newest(rows: DataFrame, *key: str) -> DataFrame:
    """The row of the newest batch for each key (combined map-side; nothing is collected or sorted)."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return best.select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def compact(spark: SparkSession, base: str, tables: dict[str, DataFrame], at: Log) -> int:
    """Commit ``tables`` (the merged rows up to ``at``) as the first batch of the next generation, under the batch number of
    the last one merged. The folders of earlier generations stay for readers that still use them."""
    return append(spark, base, tables, at.batches[-1][0], at.generation + 1)
