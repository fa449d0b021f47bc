"""One extraction pass over source files.

``extract`` runs a single ``mapInPandas`` over ``(path, content)``: every file
is parsed once and yields a tagged union of chunk, call, import and error rows.
The typed tables below are projections of that union; ids are built with
Column expressions on the JVM.  When several tables are derived from one pass
in the same job, persist or write the union first (see ``changes.refresh``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.functions import ids
from corpusweave.functions.pyast import check_syntax, extract_file

EXTRACT_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("chunk_type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("class_name", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("modules", T.ArrayType(T.StringType())),
    T.StructField("level", T.IntegerType()),
    T.StructField("error", T.StringType()),
])
_COLS = [f.name for f in EXTRACT_SCHEMA.fields]


def _extract_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            rows.extend(extract_file(path, bytes(content) if content is not None else b""))
        # object columns keep None as null and ints as ints for Arrow
        out = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in _COLS})
        yield out


def extract(sources: DataFrame, partitions: int | None = None) -> DataFrame:
    """The tagged union for every file of ``sources(path, content)``.

    Parsing is CPU-bound Python.  A large ``binaryFile`` scan already comes
    in many splits and is parsed where it is read (``partitions=None``);
    small or filtered inputs (a change set, a table-derived corpus) pass a
    partition count so the files are spread by path across the cores.
    """
    src = sources.select("path", "content")
    if partitions:
        src = src.repartition(partitions, "path")
    return src.mapInPandas(_extract_batches, EXTRACT_SCHEMA)


def chunks(x: DataFrame) -> DataFrame:
    """Chunks table of the DDL."""
    c = x.where(F.col("kind") == "chunk")
    return c.select(
        ids.chunk_id(F.col("path"), F.col("chunk_type"), F.col("class_name"), F.col("name")).alias("chunk_id"),
        ids.symbol_id(F.col("path"), F.col("chunk_type"), F.col("class_name"), F.col("name")).alias("symbol_id"),
        F.col("name").alias("short_name"), "class_name", "path", "chunk_type",
        "start_line", "end_line", F.lit("python").alias("language"), "content")


def imports(x: DataFrame) -> DataFrame:
    """(path, pos, import_text), document order in ``pos``."""
    return x.where(F.col("kind") == "import").select("path", "pos", F.col("text").alias("import_text"))


def import_modules(x: DataFrame) -> DataFrame:
    """Top-level module names of absolute imports (input of D2)."""
    return (x.where((F.col("kind") == "import") & (F.col("level") == 0))
             .select("path", "pos", F.explode("modules").alias("module")))


def raw_calls(x: DataFrame) -> DataFrame:
    """(path, caller symbol id, pos, raw call text)."""
    return x.where(F.col("kind") == "call").select(
        "path",
        ids.symbol_id(F.col("path"), F.col("chunk_type"), F.col("class_name"), F.col("name")).alias("caller"),
        "pos", F.col("text").alias("raw_call"))


def parse_errors(x: DataFrame) -> DataFrame:
    return x.where(F.col("kind") == "error").select("path", "error")


def _check_batch(texts: pd.Series) -> pd.DataFrame:
    res = [check_syntax(t) for t in texts]
    return pd.DataFrame({"valid": [r[0] for r in res], "error": [r[1] for r in res]})


def syntax_check(col) -> "F.Column":
    """X9 as a vectorised UDF over a source-text column -> struct<valid, error>."""
    udf = F.pandas_udf(_check_batch, "struct<valid:boolean,error:string>")
    return udf(col)
