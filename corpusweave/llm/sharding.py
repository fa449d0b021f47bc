"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows of each stratum are put in a seeded random order; the row of rank r among
n gets the fractional rank (r - 1/2) / n; all rows are ordered by it and cut
into shards whose row counts differ by one at most. Every prefix of that order
holds every stratum in proportion, so every shard matches the mixture.

Global positions without a global sort: ranks are counted inside hash buckets
and shifted by a running sum over at most ``BUCKETS`` buckets, first within
each stratum, then over the fractional ranks. A stratum with a third of all
rows is thus spread over all buckets. Two shuffles of narrow rows, plus two of
at most ``BUCKETS`` counts a stratum.

Defined results: a null stratum is a stratum of its own; null ids and null
texts are rows like any other; fully equal rows are interchangeable, so their
order is of no effect; an empty table gives an empty result. Extra columns
pass through; columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 4096
SEED = "7"
_HEX_BUCKET = 3  # hexadecimal digits that name one of the 4096 buckets


def shuffle_key(*cols: Column, seed: str = SEED) -> Column:
    """Seeded pseudo-random order: the MD5 of seed and columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]))


def _offsets(df: DataFrame, by: list[str], bucket: str, out: str) -> DataFrame:
    """Rows in earlier buckets, for each bucket (of each stratum)."""
    counts = df.groupBy(*by, bucket).agg(F.count("*").alias("_rows"))
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def stratified_shards(rows: DataFrame, stratum: str, key: Column, n_shards: int) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (0 up, without gaps)."""
    own = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    df = rows.select(*own, key.alias("_key")).withColumns({
        "_stratum": F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")),
        "_bucket": F.conv(F.substring("_key", 1, _HEX_BUCKET), 16, 10).cast("int")})
    in_stratum = _offsets(df, ["_stratum"], "_bucket", "_before")
    totals = in_stratum.groupBy("_stratum").agg(F.sum("_rows").alias("_n"))
    offsets = in_stratum.join(totals, "_stratum").select("_stratum", "_bucket", "_before", "_n")
    rank = F.row_number().over(W.partitionBy("_stratum", "_bucket").orderBy("_key"))
    df = (df.withColumn("_r", rank).join(offsets, ["_stratum", "_bucket"])
          .withColumn("_r", F.col("_r") + F.col("_before"))
          # fractional rank (2r - 1) / 2n in whole numbers: no rounding decides an order
          .withColumn("_part", F.expr(f"cast(((2 * _r - 1) * {BUCKETS}) div (2 * _n) as int)"))
          .drop("_bucket", "_before"))
    over_all = _offsets(df, [], "_part", "_before").select("_part", "_before", F.sum("_rows").over(
        W.partitionBy()).alias("_all"))
    order = W.partitionBy("_part").orderBy(((2 * F.col("_r") - 1) / (2 * F.col("_n"))), "_stratum", "_r")
    df = df.withColumn("_pos", F.row_number().over(order)).join(over_all, "_part").withColumn(
        "_pos", F.col("_pos") + F.col("_before") - 1)
    shard = F.expr(f"cast((_pos * {n_shards}) div _all as int)")
    # the first position of shard s is ceil(s * all / shards)
    first = F.expr(f"(shard * _all + {n_shards - 1}) div {n_shards}")
    return df.withColumn("shard", shard).withColumn("slot", F.col("_pos") - first).select(*own, "shard", "slot")
