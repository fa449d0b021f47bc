"""Change detection and incremental index maintenance.

C1 plan: one full outer join of two metadata-sized tables.  The content hash
is computed map-side in the scan (``md5(content)``), so the shuffle carries
32-byte hashes, never file bytes; the hash is consulted only where size or
mtime differ (Q2), unless ``always_hash``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.operators import extract as X
from corpusweave.operators import graph as G

NEW, CHANGED, UNCHANGED, DELETED = "NEW", "CHANGED", "UNCHANGED", "DELETED"


def snapshot(sources: DataFrame) -> DataFrame:
    """sources(path, modificationTime, length, content) -> (path, size, mtime, hash)."""
    return sources.select("path", F.col("length").alias("size"),
                          F.col("modificationTime").alias("mtime"),
                          F.coalesce(F.md5("content"), F.lit("")).alias("hash"))


def classify(snap: DataFrame, manifest: DataFrame, always_hash: bool = False) -> DataFrame:
    """C1 + C2: (path, status, size, mtime, hash, old_size, old_mtime, old_hash)."""
    s = snap.select("path", "size", "mtime", "hash")
    m = manifest.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"),
                        F.col("hash").alias("old_hash"), F.lit(True).alias("_in_manifest"))
    j = s.withColumn("_on_disk", F.lit(True)).join(m, "path", "full_outer")
    meta_differs = (F.col("size") != F.col("old_size")) | (F.col("mtime") != F.col("old_mtime"))
    hash_differs = F.col("hash") != F.col("old_hash")
    changed = hash_differs if always_hash else (meta_differs & hash_differs)
    status = (F.when(F.col("_in_manifest").isNull(), F.lit(NEW))
               .when(F.col("_on_disk").isNull(), F.lit(DELETED))
               .when(changed, F.lit(CHANGED))
               .otherwise(F.lit(UNCHANGED)))
    return j.select("path", status.alias("status"), "size", "mtime", "hash", "old_size", "old_mtime", "old_hash")


def suspects(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """C1, first phase: the listed files (path, modificationTime, length) that the metadata cannot settle: unknown ones and
    those whose size or time differs from the manifest's. All others are UNCHANGED without being opened."""
    m = manifest.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    j = listing.join(m, "path", "left")
    return j.where(~F.col("length").eqNullSafe(F.col("_size")) | ~F.col("modificationTime").eqNullSafe(F.col("_mtime"))).select("path")


def classify_listing(listing: DataFrame, content: DataFrame, manifest: DataFrame) -> DataFrame:
    """C1 + C2 in two phases, the same rows as ``classify`` over a whole snapshot. ``content`` has (path, content) of the
    suspects; a listed file that is gone by then is DELETED if known, and otherwise not there."""
    hashes = content.select("path", F.md5("content").alias("hash"))
    read = listing.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).join(hashes, "path", "left")
    settled = manifest.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("hash").alias("_hash"))
    j = read.join(settled, "path", "left")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    snap = j.where(same | F.col("hash").isNotNull()).select("path", "size", "mtime", F.when(same, F.col("_hash")).otherwise(F.col("hash")).alias("hash"))
    return classify(snap, manifest)


def classify_tree(spark, root: str, manifest: DataFrame, glob: str = "*.py") -> tuple[DataFrame, DataFrame]:
    """C1 over a source tree, metadata first: (status rows, sources rows of the files that had to be opened)."""
    from corpusweave.session import materialize
    from corpusweave.sources import codetree
    listing = materialize(codetree.list_source_tree(spark, root, glob))
    content = codetree.read_files(spark, root, suspects(listing, manifest))
    return classify_listing(listing, content, manifest), content


def refresh_manifest(status: DataFrame) -> DataFrame:
    """NEW/CHANGED take the new size, mtime and hash; UNCHANGED keep the
    old row; DELETED drop out."""
    fresh = F.col("status").isin(NEW, CHANGED)
    return (status.where(F.col("status") != DELETED)
                  .select("path",
                          F.when(fresh, F.col("size")).otherwise(F.col("old_size")).alias("size"),
                          F.when(fresh, F.col("mtime")).otherwise(F.col("old_mtime")).alias("mtime"),
                          F.when(fresh, F.col("hash")).otherwise(F.col("old_hash")).alias("hash")))


def stale_paths(status: DataFrame) -> DataFrame:
    # NEW files are cleared too (as before any re-index); a consistent index has none
    return status.where(F.col("status") != UNCHANGED).select("path")


def invalidate(table: DataFrame, status: DataFrame, path_col: str = "path") -> DataFrame:
    """C4: drop every row of a file-scoped table whose file changed or vanished
    (by path, so method chunks are dropped too: Q3)."""
    stale = stale_paths(status).withColumnRenamed("path", path_col)
    return table.join(stale, path_col, "left_anti")


def build_index(x: DataFrame) -> dict[str, DataFrame]:
    """File-scoped tables from one extraction union."""
    return {"chunks": X.chunks(x), "imports": X.imports(x), "raw_calls": X.raw_calls(x),
            "parse_errors": X.parse_errors(x)}


def derive_graph(chunks: DataFrame, raw_calls: DataFrame) -> dict[str, DataFrame]:
    """Global passes (Q5): symbols from all chunks, then every raw call
    resolved against them; edges are derived, never patched (Q4)."""
    symbols = G.symbol_table(chunks).persist()
    resolved = G.resolve_calls(raw_calls, symbols).persist()  # written, then projected to edges
    return {"symbols": symbols, "resolved_calls": resolved, "edges": G.call_edges(resolved),
            "_cached": [symbols, resolved]}


def maintain_graph(index: dict[str, DataFrame], status: DataFrame, fresh_chunks: DataFrame,
                   fresh_calls: DataFrame) -> dict[str, DataFrame]:
    """Incremental form of ``derive_graph``, equal to it by construction.

    A call's target depends only on its short name, its file's module and
    the symbols carrying that short name.  So after a batch only these calls
    are resolved again: calls of new or changed files, and stored calls whose
    short name gained or lost a symbol in this batch.  Every other stored
    resolution is kept as is; the work follows the change, not the corpus.
    """
    old_syms, old_res = index["symbols"], index["resolved_calls"]
    fresh_syms = G.symbol_table(fresh_chunks)
    symbols = invalidate(old_syms, status).unionByName(fresh_syms).persist()
    touched = (old_syms.join(stale_paths(status), "path", "left_semi").select("short_name")
               .union(fresh_syms.select("short_name")).distinct())
    kept = invalidate(old_res, status).withColumn("_short", F.substring_index("raw_call", ".", -1))
    stay = kept.join(touched, kept["_short"] == touched["short_name"], "left_anti").drop("_short")
    again = (kept.join(touched, kept["_short"] == touched["short_name"], "left_semi")
                 .select("path", "caller", "pos", "raw_call")
                 .unionByName(fresh_calls.select("path", "caller", "pos", "raw_call")))
    resolved = stay.unionByName(G.resolve_calls(again, symbols)).persist()
    return {"symbols": symbols, "resolved_calls": resolved, "edges": G.call_edges(resolved),
            "_cached": [symbols, resolved]}


def release(tables: dict) -> None:
    """Drop the cached intermediates of a refresh once its tables are written."""
    for df in tables.get("_cached", []):
        df.unpersist()


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _graph(index, status, fresh, out):
    if index is not None and "symbols" in index and "resolved_calls" in index:
        return maintain_graph(index, status, fresh["chunks"], fresh["raw_calls"])
    return derive_graph(out["chunks"], out["raw_calls"])


def refresh_tree(spark, root: str, index: dict[str, DataFrame] | None, manifest: DataFrame | None, glob: str = "*.py") -> dict[str, DataFrame]:
    """C5 over a source tree: the listing decides which files are opened at all."""
    if manifest is None:
        manifest = spark.createDataFrame([], "path string, size bigint, mtime timestamp, hash string")
    status, content = classify_tree(spark, root, manifest, glob)
    return _refreshed(status, content, index, _shuffle_partitions(manifest))


def refresh(sources: DataFrame, index: dict[str, DataFrame] | None, manifest: DataFrame | None,
            always_hash: bool = False, partitions: int | None = None) -> dict[str, DataFrame]:
    """Incremental refresh.  Returns the new table set (not yet written).

    index: previous tables (chunks, imports, raw_calls, parse_errors, and
    optionally symbols + resolved_calls for incremental graph upkeep) or
    None for a first build.  Only NEW/CHANGED files go through the Python
    extraction pass.
    """
    snap = snapshot(sources)
    if manifest is None:
        manifest = snap.limit(0)
    return _refreshed(classify(snap, manifest, always_hash), sources, index, partitions or _shuffle_partitions(sources))


def _refreshed(status: DataFrame, sources: DataFrame, index, partitions: int) -> dict[str, DataFrame]:
    # status and the extraction union feed several tables: keep them for the
    # writes (executor loss recomputes the lost blocks from lineage)
    status = status.persist()
    todo = status.where(F.col("status").isin(NEW, CHANGED)).select("path")
    fresh_x = X.extract(sources.join(todo, "path", "left_semi"), partitions=partitions).persist()
    fresh = build_index(fresh_x)
    out: dict[str, DataFrame] = {}
    for name, df in fresh.items():
        if index is not None and name in index:
            out[name] = invalidate(index[name], status).unionByName(df)
        else:
            out[name] = df
    g = _graph(index, status, fresh, out)
    out.update(g)
    out["_cached"] = g["_cached"] + [status, fresh_x]
    out["manifest"] = refresh_manifest(status)
    out["status"] = status.select("path", "status")
    return out


CHANGE_SCHEMA = "seq BIGINT, path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY, op STRING"


def refresh_changes(changes: DataFrame, index: dict[str, DataFrame] | None, manifest: DataFrame | None,
                    always_hash: bool = False) -> dict[str, DataFrame]:
    """C5 for a batch of change rows (seq, path, modificationTime, length,
    content, op in {'upsert', 'delete'}): files not in the batch are
    unchanged.  The last row per path (by seq) wins within the batch."""
    from pyspark.sql import Window
    w = Window.partitionBy("path").orderBy(F.col("seq").desc())
    last = changes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    ups = last.where(F.col("op") != "delete")
    touched = last.select("path")
    if manifest is None:
        spark = changes.sparkSession
        manifest = spark.createDataFrame([], "path string, size bigint, mtime timestamp, hash string")
    man_t = manifest.join(touched, "path", "left_semi")
    st_up = classify(snapshot(ups), man_t.join(ups.select("path"), "path", "left_semi"), always_hash)
    gone = (man_t.join(last.where(F.col("op") == "delete").select("path"), "path", "left_semi")
                 .select("path", F.lit(DELETED).alias("status"), F.lit(None).cast("bigint").alias("size"),
                         F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("string").alias("hash"),
                         F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"),
                         F.col("hash").alias("old_hash")))
    status = st_up.unionByName(gone).persist()
    todo = status.where(F.col("status").isin(NEW, CHANGED)).select("path")
    fresh_x = X.extract(ups.join(todo, "path", "left_semi"), partitions=_shuffle_partitions(changes)).persist()
    fresh = build_index(fresh_x)
    out: dict[str, DataFrame] = {}
    for name, df in fresh.items():
        out[name] = invalidate(index[name], status).unionByName(df) if index and name in index else df
    g = _graph(index, status, fresh, out)
    out.update(g)
    out["_cached"] = g["_cached"] + [status, fresh_x]
    out["manifest"] = manifest.join(touched, "path", "left_anti").unionByName(refresh_manifest(status))
    out["status"] = status.select("path", "status")
    return out
