"""Hybrid retrieval for a batch of queries, and its summary row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.config import BFS_DEPTH, GRAPH_DEFAULT_SCORE, MAX_SYMBOLS, TOP_K
from corpusweave.operators import graph as G
from corpusweave.operators.segments import positions
from corpusweave.operators.vectors import semantic_topk
from corpusweave.session import materialize, spread


def hybrid_retrieve(queries: DataFrame, vectors: DataFrame, chunk_meta: DataFrame,
                    symbols: DataFrame, edges: DataFrame, k: int = TOP_K,
                    depth: int = BFS_DEPTH, budget: int = MAX_SYMBOLS,
                    **topk_opts) -> DataFrame:
    """R1 ranked hits; see ``hybrid_retrieve_parts``."""
    return hybrid_retrieve_parts(queries, vectors, chunk_meta, symbols, edges, k, depth, budget,
                                 **topk_opts)[0]


def hybrid_retrieve_parts(queries: DataFrame, vectors: DataFrame, chunk_meta: DataFrame,
                          symbols: DataFrame, edges: DataFrame, k: int = TOP_K,
                          depth: int = BFS_DEPTH, budget: int = MAX_SYMBOLS,
                          **topk_opts) -> tuple[DataFrame, DataFrame]:
    """R1 for ``queries(query_id, embedding)``.

    vectors(chunk_id, embedding); chunk_meta(chunk_id, symbol_id); symbols(
    symbol_id, chunk_id) maps expanded symbols back to chunks (a null chunk_id
    reproduces an index that never stored it: graph chunks then vanish, Q9);
    edges(src, dst) is the call graph.

    Semantic hits score 1.0 with their distance; graph chunks score their hop
    score (0.5 if absent) with null distance; a chunk found semantically is
    never replaced.  Rank: score desc, semantic first, distance, chunk_id.
    Returns (hits, expanded): hits (query_id, rank, chunk_id, symbol_id,
    score, source, distance, hop) and the budgeted expansion (G10/G11).
    """
    sem = semantic_topk(queries, vectors, k=k, **topk_opts)
    # read three times below: compute the Python top-k stage once
    sem = materialize(sem.join(spread(chunk_meta.select("chunk_id", "symbol_id")), "chunk_id", "left"))
    seeds = sem.where(F.col("symbol_id").isNotNull()).select("query_id", F.col("symbol_id").alias("symbol"))
    expanded = G.graph_expand(seeds, edges, depth=depth, budget=budget)
    gchunks = (expanded.join(spread(symbols.select("symbol_id", "chunk_id").where(F.col("chunk_id").isNotNull())),
                             expanded["symbol"] == symbols["symbol_id"])
                       .select("query_id", "chunk_id", "symbol_id", "score", "hop"))
    gonly = gchunks.join(spread(sem.select("query_id", "chunk_id")), ["query_id", "chunk_id"], "left_anti")
    both = (sem.select("query_id", "chunk_id", "symbol_id", F.lit(1.0).alias("score"),
                       F.lit("semantic").alias("source"), "distance", F.lit(None).cast("int").alias("hop"))
            .unionByName(gonly.select("query_id", "chunk_id", "symbol_id",
                                      F.coalesce("score", F.lit(GRAPH_DEFAULT_SCORE)).alias("score"),
                                      F.lit("graph").alias("source"),
                                      F.lit(None).cast("double").alias("distance"), "hop")))
    w = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), F.when(F.col("source") == "semantic", 0).otherwise(1),
        F.col("distance").asc_nulls_last(), F.col("chunk_id").asc())
    hits = both.withColumn("rank", F.row_number().over(w)).select(
        "query_id", "rank", "chunk_id", "symbol_id", "score", "source", "distance", "hop")
    return hits, expanded


def summary_items(hits: DataFrame, expanded: DataFrame, related: DataFrame) -> DataFrame:
    """R2 in long form: (query_id, kind, pos, item, score), a row for every list entry of a query.

    Kinds: seed (symbols of semantic hits, by rank), expanded (symbols with their hop score), chunk (ranked chunk ids), and
    dependency, dependent, related (distinct, in order, no score). The import lists grow with the corpus, so their positions
    are counted by ranges (``segments.positions``): a query that a large share of the corpus depends on is spread over tasks.
    Seeds and chunks without an id keep their row with a null item; queries without rows in a list have none."""
    none = F.lit(None).cast("double")
    def ranked(rows: DataFrame, kind: str, item: str) -> DataFrame:
        return rows.select("query_id", F.lit(kind).alias("kind"), F.col("rank").cast("long").alias("pos"),
                           F.col(item).cast("string").alias("item"), F.col("score").cast("double").alias("score"))
    lists = positions(related.select("query_id", "kind", F.col("item").cast("string").alias("item")).distinct(), ["query_id", "kind"], ["item"])
    return (ranked(hits.where(F.col("source") == "semantic"), "seed", "symbol_id")
            .unionByName(ranked(expanded, "expanded", "symbol")).unionByName(ranked(hits, "chunk", "chunk_id"))
            .unionByName(lists.select("query_id", "kind", F.col("pos").cast("long").alias("pos"), "item", none.alias("score"))))


def retrieval_summary(hits: DataFrame, expanded: DataFrame, related: DataFrame,
                      chunks: DataFrame) -> DataFrame:
    """R2: one row per query: seeds, expanded symbols, score map, related
    files, and the ranked chunk list.  Per-query arrays are bounded by k and
    the budget; ``related`` lists are whatever the import tables hold."""
    seeds = (hits.where(F.col("source") == "semantic").groupBy("query_id")
                 .agg(F.sort_array(F.collect_list(F.struct("rank", "symbol_id"))).alias("_s"))
                 .select("query_id", F.col("_s.symbol_id").alias("seed_symbols")))
    exp = (expanded.groupBy("query_id")
                   .agg(F.sort_array(F.collect_list(F.struct("rank", "symbol", "score"))).alias("_e"))
                   .select("query_id", F.col("_e.symbol").alias("expanded_symbols"),
                           F.map_from_arrays(F.col("_e.symbol"), F.col("_e.score")).alias("symbol_scores")))
    rel = related.groupBy("query_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("kind") == "dependency", F.col("item")))).alias("dependencies"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "dependent", F.col("item")))).alias("dependents"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "related", F.col("item")))).alias("related_files"))
    ch = (hits.join(spread(chunks.select("chunk_id", "path", "start_line", "end_line", "content")), "chunk_id", "left")
              .groupBy("query_id")
              .agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "symbol_id", "path", "start_line",
                                                        "end_line", "score", "source", "distance",
                                                        "content"))).alias("chunks")))
    return seeds.join(spread(exp), "query_id", "full").join(spread(rel), "query_id", "left").join(spread(ch), "query_id", "left")
