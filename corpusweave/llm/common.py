"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.session import ensure_checkpoint_dir

#: ASCII white space: space and 09-0D (bytes.split() splits at the same bytes).
SPACE_RE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: With this setting Spark frees a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that run meanwhile leave no shuffle files; for those that run once."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: the
    lineage ends there, lost executors lose nothing, later reads prune columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def passing_table(df: DataFrame, name: str) -> DataFrame:
    """A ``shared_table`` whose shuffle files go as soon as it is written; ``drop_tables`` ends it."""
    with shuffles_freed(df.sparkSession):
        return shared_table(df, name)


def drop_tables(*tables: DataFrame) -> None:
    """Delete shared tables that no later query reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (a null id is in part 0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(parts), F.lit(0))


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def as_bytes(column) -> list:
    """The values of an Arrow text column as UTF-8 bytes (null stays None)."""
    import pyarrow as pa
    return column.cast(pa.binary()).to_pylist()
