"""Scan a source tree into ``sources`` rows.

``binaryFile`` lists files on the executors' file system view and reads the
bytes lazily: when ``content`` is not selected (change detection's first
pass), no file body is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files whose paths the driver names in one read.
FILES_PER_READ = 10_000


def list_source_tree(spark: SparkSession, root: str, glob: str = "*.py", repo: str | None = None) -> DataFrame:
    """(repo, path, modificationTime, length): metadata only, no file is opened."""
    return scan_source_tree(spark, root, glob, repo).drop("content")


def read_files(spark: SparkSession, root: str, paths: DataFrame, repo: str | None = None) -> DataFrame:
    """sources rows of the given ``path``s below ``root``; no other file is opened.

    The file source takes paths, not a table of them, so they are named ``FILES_PER_READ`` at a time (as many rows pass
    through the driver at once); the files themselves are read by the tasks."""
    base, out, held = root.rstrip("/") + "/", None, []

    def read(some):
        df = spark.read.format("binaryFile").load([base + p for p in some])
        return _as_sources(df, root, repo)
    for row in paths.select("path").distinct().toLocalIterator():
        held.append(row.path)
        if len(held) == FILES_PER_READ:
            out, held = read(held) if out is None else out.unionByName(read(held)), []
    if held:
        out = read(held) if out is None else out.unionByName(read(held))
    return spark.createDataFrame([], _SOURCES) if out is None else out


def scan_source_tree(spark: SparkSession, root: str, glob: str = "*.py", repo: str | None = None) -> DataFrame:
    """sources(repo, path, modificationTime, length, content) for every file
    under ``root`` matching ``glob``, with ``path`` relative to the root."""
    df = (spark.read.format("binaryFile")
               .option("recursiveFileLookup", "true")
               .option("pathGlobFilter", glob)
               .load(root))
    return _as_sources(df, root, repo)


_SOURCES = "repo string, path string, modificationTime timestamp, length bigint, content binary"


def _as_sources(df: DataFrame, root: str, repo: str | None) -> DataFrame:
    prefix = root.rstrip("/") + "/"
    # binaryFile paths are URIs (file:/..., hdfs://...): keep the part after the root
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _regex_quote(prefix), "")
    return df.select(F.lit(repo or root.rstrip("/").split("/")[-1]).alias("repo"), rel.alias("path"),
                     "modificationTime", "length", "content")


def _regex_quote(s: str) -> str:
    import re
    return re.escape(s.lstrip("/"))
