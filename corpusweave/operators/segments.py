"""Running values over long histories, without one task per history.

A window ordered within a key holds the key's whole history in one task. Here
a key's rows are cut by an order-keeping bucket (a range of the sequence or of
time): the running value is taken inside each (key, bucket), and each bucket
starts from what the earlier buckets of its key add up to, which is a running
value over one row per (key, bucket). A key with a third of all rows is spread
over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.session import materialize

#: Sequence numbers per bucket.
SPAN = 1 << 16


def bucket_of(seq: Column, span: int = SPAN) -> Column:
    """Order-keeping bucket of a whole-number sequence (negative ones too; a null sequence comes first, as in an ordering)."""
    return F.coalesce(F.floor(seq / F.lit(span)).cast("long"), F.lit(-(1 << 62)))


def running(df: DataFrame, by: str, order: list, bucket: Column, sums: dict[str, Column] | None = None,
            maxima: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with the sum (0 if none) or maximum (null if none) of each expression over the key's earlier rows. The order must
    be total within a key; ``bucket`` must not fall along it. Keys are compared like groups: null is a key."""
    sums, maxima = sums or {}, maxima or {}
    kinds = {**{n: (F.sum, e) for n, e in sums.items()}, **{n: (F.max, e) for n, e in maxima.items()}}
    df = df.withColumn("_bucket", bucket)
    own = Window.partitionBy(by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(F.col(by).alias("_key"), F.col("_bucket").alias("_of")).agg(*[f(e).alias(n) for n, (f, e) in kinds.items()])
    carried = totals.select("_key", "_of", *[f(n).over(earlier).alias(f"_before_{n}") for n, (f, _) in kinds.items()])
    inside = df.withColumns({f"_own_{n}": f(e).over(own) for n, (f, e) in kinds.items()})
    out = inside.join(carried, F.col(by).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_of")))
    zero = F.lit(0)
    values = [(F.coalesce(f"_before_{n}", zero) + F.coalesce(f"_own_{n}", zero)).alias(n) for n in sums]
    values += [F.greatest(f"_before_{n}", f"_own_{n}").alias(n) for n in maxima]
    return out.select(*[c for c in df.columns if c != "_bucket" and c not in kinds], *values)


def positions(df: DataFrame, by: list[str], order: list[str], name: str = "pos", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's position (from 1) among the rows of its key, in the given order, and ``n_rows``, the key's rows.

    The rows are dealt to ranges of (key, order), so a long list is spread over several tasks; each range counts its own rows
    and is shifted by what the key's earlier ranges hold (a row per key and range). ``ranges`` fixes their number; by default
    AQE picks it by size. Null is a key and comes first in an order;
    equal rows get different positions in any order; columns of the names ``name`` and ``n_rows`` are replaced."""
    own = [c for c in df.columns if c not in (name, "n_rows")]
    ranged = df.select(*own).repartitionByRange(*([ranges] if ranges else []), *by, *order).withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy("_range", *by).orderBy(*order)
    # computed once: the ranges come from a sample, and both reads below must see the same ones
    ranked = materialize(ranged.withColumn("_own", F.row_number().over(inside)))
    counts = ranked.groupBy("_range", *by).agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(*by)
    shifts = counts.select(
        F.col("_range").alias("_of"), *[F.col(c).alias(f"_key_{c}") for c in by], F.sum("_rows").over(whole).alias("n_rows"),
        F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return ranked.join(shifts, same).select(*own, (F.col("_own") + F.col("_before")).alias(name), "n_rows")
