"""Continuous index refresh on append-only deltas.

The source is an append-only directory of change rows (``CHANGE_SCHEMA``);
the file source only sees new files, so in-place edits and deletions travel
as rows, never as file-system events. Each micro-batch classifies its paths
against the index (C1), extracts only the new and changed files (X1-X8),
resolves only the calls that the change can reach (G3) and appends what came
of it (``sources.deltas``). The rows written follow the change, not the index:

* ``files``: one row for each path of the batch, the manifest's columns with the
  greatest ``seq`` applied, a deletion mark, and ``content_batch``, the batch
  whose rows hold the file's extraction;
* ``chunks``, ``imports``, ``raw_calls``, ``parse_errors``: rows of extracted files;
* ``targets``: what a (path, raw_call) resolves to, for the calls of extracted
  files and for calls elsewhere whose target this batch moved.

A row of an extraction is live while its batch is its file's content batch, so
an edit or deletion needs no rewrite. A call's target depends only on its short
name, its file and the symbols of that name, so only names whose set of symbols
differs between the old and the new extraction are resolved again.

Defined results: a batch that the same stream has committed is skipped; a
stream with a new checkpoint starts its batch ids again and loses nothing; of
several rows of a path the greatest seq counts; a row whose seq is not above
the path's last one, deletions included, changes nothing; a deletion of an
unknown path is remembered by its seq; rows that touch a file without changing
it keep its manifest row. Batches are compacted every ``compact_every`` batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.operators import changes as C
from corpusweave.operators import extract as X
from corpusweave.operators import graph as G
from corpusweave.session import materialize
from corpusweave.sources import deltas

EXTRACTED = ("chunks", "imports", "raw_calls", "parse_errors")
TABLES = ("files", *EXTRACTED, "targets")
COMPACT_EVERY = 20


def _files(spark: SparkSession, base: str, at: deltas.Log) -> DataFrame:
    return deltas.newest(deltas.read(spark, base, "files", at), "path")


def _live(table: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the extraction that each file's newest row names."""
    content = files.where("NOT deleted").select("path", F.col("content_batch").alias("batch"))
    return table.join(content, ["path", "batch"]).drop("batch")


def _targets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(path, raw_call, dst, resolved): the extraction's own target unless a later batch moved it."""
    content = files.where("NOT deleted").select("path", "content_batch")
    rows = targets.join(content, "path")
    moved = deltas.newest(rows.where("batch > content_batch").drop("content_batch"), "path", "raw_call").select(
        "path", "raw_call", F.col("dst").alias("_dst"), F.col("resolved").alias("_resolved"))
    own = rows.where("batch = content_batch").select("path", "raw_call", "dst", "resolved")
    return own.join(moved, ["path", "raw_call"], "left").select(
        "path", "raw_call", F.coalesce("_dst", "dst").alias("dst"), F.coalesce("_resolved", "resolved").alias("resolved"))


def load_index(spark: SparkSession, base: str) -> dict[str, DataFrame] | None:
    """The merged index: manifest, chunks, imports, raw_calls, parse_errors, symbols, resolved_calls, edges."""
    at = deltas.log(spark, base)
    if at is None:
        return None
    files = _files(spark, base, at)
    out = {n: _live(deltas.read(spark, base, n, at), files) for n in EXTRACTED}
    out["manifest"] = files.where("NOT deleted").select("path", "size", "mtime", "hash")
    out["symbols"] = G.symbol_table(out["chunks"])
    out["resolved_calls"] = out["raw_calls"].join(_targets(deltas.read(spark, base, "targets", at), files), ["path", "raw_call"]).select(
        "path", "caller", "pos", "raw_call", "dst", "resolved")
    out["edges"] = G.call_edges(out["resolved_calls"])
    return out


def _status(last: DataFrame, files: DataFrame | None) -> DataFrame:
    """One row for each path that this batch may change: its new metadata, what the index has, and its status (null for
    a deletion of an unknown path)."""
    known = ("seq", "size", "mtime", "hash", "deleted", "content_batch")
    if files is None:
        old = last.select("path", *[F.lit(None).cast(t).alias(f"old_{c}") for c, t in zip(
            known, ("long", "long", "timestamp", "string", "boolean", "long"))])
    else:
        old = files.select("path", *[F.col(c).alias(f"old_{c}") for c in known])
    rows = last.select("path", "seq", "op", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
                       F.coalesce(F.md5("content"), F.lit("")).alias("hash")).join(old, "path", "left")
    rows = rows.where("old_seq IS NULL OR seq > old_seq")
    present = F.coalesce(~F.col("old_deleted"), F.lit(False))
    metadata = ~F.col("size").eqNullSafe(F.col("old_size")) | ~F.col("mtime").eqNullSafe(F.col("old_mtime"))
    status = (F.when((F.col("op") == "delete") & present, C.DELETED).when(F.col("op") == "delete", None)
              .when(~present, C.NEW).when(metadata & (F.col("hash") != F.col("old_hash")), C.CHANGED).otherwise(C.UNCHANGED))
    return rows.withColumn("status", status)


def _file_rows(status: DataFrame, batch: int) -> DataFrame:
    gone = F.col("op") == "delete"
    fresh = F.col("status").isin(C.NEW, C.CHANGED)
    pick = lambda c: F.when(gone, None).when(fresh, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    return status.select("path", "seq", pick("size"), pick("mtime"), pick("hash"), F.coalesce(gone, F.lit(False)).alias("deleted"),
                         F.when(gone | fresh, F.lit(batch)).otherwise(F.col("old_content_batch")).cast("long").alias("content_batch"))


def _resolve(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, raw_call, dst, resolved) for distinct (path, raw_call)."""
    none = F.lit(None)
    return G.resolve_calls(calls.select("path", none.cast("string").alias("caller"), none.cast("int").alias("pos"), "raw_call"),
                           symbols).select("path", "raw_call", "dst", "resolved")


def _new_targets(fresh: dict[str, DataFrame], index: dict[str, DataFrame] | None, status: DataFrame) -> DataFrame:
    short = F.substring_index("raw_call", ".", -1)
    calls = fresh["raw_calls"].select("path", "raw_call").distinct()
    symbols = G.symbol_table(fresh["chunks"])
    if index is None:
        return _resolve(calls, symbols)
    stale = status.where(F.col("status").isin(C.CHANGED, C.DELETED)).select("path")
    names = lambda s: s.select("short_name", "symbol_id").distinct()
    before, after = names(index["symbols"].join(stale, "path", "left_semi")), names(symbols)
    redone = status.where(F.col("status").isin(C.NEW, C.CHANGED, C.DELETED)).select("path")
    touched = materialize(before.exceptAll(after).union(after.exceptAll(before)).select("short_name").distinct())
    others = index["raw_calls"].select("path", "raw_call").distinct().join(redone, "path", "left_anti")
    again = others.join(touched, short == F.col("short_name"), "left_semi")
    todo = materialize(calls.union(again))
    # unchanged files of the batch keep their symbols
    kept = index["symbols"].join(stale, "path", "left_anti").unionByName(symbols)
    needed = todo.select(short.alias("short_name")).distinct()
    found = _resolve(todo, kept.join(needed, "short_name", "left_semi"))
    now = index["resolved_calls"].select("path", "raw_call", F.col("dst").alias("_dst"), F.col("resolved").alias("_resolved")).distinct()
    now = now.join(todo, ["path", "raw_call"], "left_semi").join(redone, "path", "left_anti")
    moved = found.join(now, ["path", "raw_call"], "left")
    return moved.where("_dst IS NULL OR dst != _dst OR resolved != _resolved").select("path", "raw_call", "dst", "resolved")


def _no_rows(spark: SparkSession) -> dict[str, DataFrame]:
    """Every table but ``files``, without rows: an index whose first batch holds no file can be read too."""
    none = C.build_index(spark.createDataFrame([], X.EXTRACT_SCHEMA))
    return {**none, "targets": spark.createDataFrame([], "path string, raw_call string, dst string, resolved boolean")}


def apply_batch(spark: SparkSession, base: str, changes: DataFrame, batch_id: int | None,
                stream_id: str = "default", compact_every: int | None = COMPACT_EVERY) -> int | None:
    """Append one batch of changes; returns its number in the index, None if the stream's batch is there already."""
    if batch_id is not None and deltas.is_applied(spark, base, stream_id, batch_id):
        return None
    at = deltas.log(spark, base)
    batch, generation = (at.next_batch, at.generation) if at else (0, 0)
    w = Window.partitionBy("path").orderBy(F.col("seq").desc())
    last = changes.where("path IS NOT NULL AND seq IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    status = materialize(_status(last, _files(spark, base, at) if at else None))
    found = {r.status for r in status.select("status").distinct().collect()}
    if not found.intersection((C.NEW, C.CHANGED, C.DELETED)):  # nothing to extract or resolve: late, touched or unknown paths only
        rows = {"files": _file_rows(status, batch)} if found else {}
        return deltas.append(spark, base, rows if at else {"files": _file_rows(status, batch), **_no_rows(spark)}, batch, generation, stream_id, batch_id)
    todo = status.where(F.col("status").isin(C.NEW, C.CHANGED)).select("path", "seq")
    fresh_x = materialize(X.extract(last.join(todo, ["path", "seq"], "left_semi"),
                                    partitions=int(spark.conf.get("spark.sql.shuffle.partitions"))))
    fresh = C.build_index(fresh_x)
    index = load_index(spark, base) if at else None
    deltas.append(spark, base, {"files": _file_rows(status, batch), **fresh, "targets": _new_targets(fresh, index, status)},
                  batch, generation, stream_id, batch_id)
    if compact_every and at and len(at.batches) + 1 >= compact_every:
        compact(spark, base)
    return batch


def compact(spark: SparkSession, base: str) -> None:
    """Write the merged index as the first batch of a new generation. Deletions stay as rows, as late rows are still compared with them."""
    at = deltas.log(spark, base)
    if at is None:
        return
    files, batch = _files(spark, base, at), at.batches[-1][0]
    merged = {n: _live(deltas.read(spark, base, n, at), files) for n in EXTRACTED}
    merged["targets"] = _targets(deltas.read(spark, base, "targets", at), files)
    merged["files"] = files.drop("batch").withColumn("content_batch", F.lit(batch).cast("long"))
    deltas.compact(spark, base, merged, at)


def start(spark: SparkSession, change_dir: str, index_base: str, checkpoint: str,
          available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the refresh stream (its checkpoint path is its id); returns the StreamingQuery."""
    reader = spark.readStream.schema(C.CHANGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(change_dir)
    w = (stream.writeStream.foreachBatch(lambda df, bid: apply_batch(spark, index_base, df, bid, checkpoint))
               .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
