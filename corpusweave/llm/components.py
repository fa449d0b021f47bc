"""Connected components of a graph by alternating stars, on DataFrames.

Every round replaces each node's neighbours by links to the smallest of them:
first those above the node (large star), then those below (small star). The
rounds end when nothing changes; every node then links to its component's
smallest node. Rounds are logarithmic in practice; each is written to the
shared folder, so lost executors cost one round at most, and goes once the next
has been written. A node with very many
neighbours is only ever aggregated (map-side) and joined, never grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables
from .common import passing_table as shared_table


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a node, and the node itself, gets a link to the smallest of node and neighbours.

    The node's own link comes from the row that holds the smallest neighbour, so the links are read twice only."""
    both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a OR b = m").select(F.greatest("a", "b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node itself, gets a link to the smallest of them (b < a in every row)."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(least, "a").select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, any orderable type); root: the smallest node."""
    e = shared_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        # a table after each star: in one plan the first would stand three times, and the driver plans it anew after every stage
        large = shared_table(_large_star(e), "edges")
        drop_tables(e)
        e = shared_table(_small_star(large), "edges")
        drop_tables(large)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
