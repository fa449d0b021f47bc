"""Streaming retry counter and routing (T4, T5, T6) per thread key, with expiry.

Events are (key, seq, event_time, passed, decision): a test run (``passed``) or,
if ``decision_row``, the answer to an escalation (``decision``). A passed test, and
any decision but ``retry``, ends the key's run; attempts count the tests of the
open run. Each micro-batch is routed by running counts (``operators.segments``),
so a key with a third of the events is spread over tasks, and joined with one
state row per key: run number, attempts of the open run, last seq, last time.
Routed rows, changed state rows and the watermark are appended together
(``sources.deltas``), so a replayed batch adds nothing.

Time: the watermark is the greatest event time of earlier batches less
``delay``. A key whose run has ended expires ``ttl`` after its last event, by the
watermark: its state no longer counts, and compaction drops it. Open runs never
expire, so no attempt is forgotten.

Defined results: rows whose seq is not above the key's last one are late or
repeated and give nothing, as do all but the first row of a seq within a batch
(tests before decisions, failed before passed, then by decision); null seqs give nothing;
null ``passed`` has failed. A row older than watermark - ttl whose key has no
state (it may have expired) gets status ``expired`` and no route, and changes
nothing; a newer one starts the key anew at run 0. Without ``ttl`` nothing expires.
The rows equal the batch ``retry_counts`` and ``route_after_test`` on the same events
delivered in seq order by batch, in any order within one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.config import MAX_RETRIES
from corpusweave.operators import runs
from corpusweave.operators.segments import SPAN, bucket_of, running
from corpusweave.session import materialize
from corpusweave.sources import deltas

OUT_SCHEMA = ("key STRING, seq BIGINT, run_no BIGINT, retry_count BIGINT, passed BOOLEAN, decision STRING, route STRING, status STRING, "
              "batch BIGINT")
COMPACT_EVERY = 50


def events_of(df: DataFrame, key: str = "key", seq: str = "seq", passed: str = "passed", event_time: str | None = None,
              decision: str | None = None, decision_row: str | None = None) -> DataFrame:
    """The columns that routing reads, from a stream's own."""
    of = lambda c, t: (F.col(c) if c else F.lit(None)).cast(t)
    return df.select(of(key, "string").alias("key"), of(seq, "bigint").alias("seq"), of(event_time, "timestamp").alias("event_time"),
                     F.coalesce(of(passed, "boolean"), F.lit(False)).alias("passed"), of(decision, "string").alias("decision"),
                     F.coalesce(of(decision_row, "boolean"), F.lit(False)).alias("decision_row"))


def _first_of_seq(events: DataFrame) -> DataFrame:
    rest = ("decision_row", "passed", "decision", "event_time")
    first = events.where("seq IS NOT NULL").groupBy("key", "seq").agg(F.min(F.struct(*rest)).alias("r"))
    return first.select("key", "seq", *[F.col("r")[c].alias(c) for c in rest])


def _with_state(events: DataFrame, state: DataFrame | None, oldest) -> DataFrame:
    """Events with their key's state; late and repeated rows gone; ``expired`` marks rows whose key may have expired before."""
    names = ("run_no", "attempts", "last_seq")
    if state is None:
        rows = events.withColumns({f"s_{c}": F.lit(None).cast("long") for c in names})
    else:
        known = state.select(F.col("key").alias("s_key"), *[F.col(c).alias(f"s_{c}") for c in names])
        rows = events.join(known, F.col("key").eqNullSafe(F.col("s_key")), "left").drop("s_key").where("s_last_seq IS NULL OR seq > s_last_seq")
    old = F.lit(False) if oldest is None else F.coalesce(F.col("event_time") < F.lit(oldest), F.lit(False))
    zero = F.lit(0).cast("long")
    return rows.select("key", "seq", "event_time", "passed", "decision", "decision_row", (F.col("s_last_seq").isNull() & old).alias("expired"),
                       F.coalesce("s_run_no", zero).alias("s_run_no"), F.coalesce("s_attempts", zero).alias("s_attempts"))


def route(rows: DataFrame, limit: int = MAX_RETRIES, span: int = SPAN) -> DataFrame:
    """Rows of ``_with_state`` with run_no, retry_count, route and the count ``tests`` of the batch's tests up to each row."""
    live = rows.where("NOT expired")
    test = F.when(F.col("decision_row"), 0).otherwise(1)
    ends = F.when(F.col("decision_row"), ~F.coalesce(F.col("decision") == "retry", F.lit(False))).otherwise(F.col("passed"))
    live = live.withColumns({"test": test, "ends": ends})
    counted = running(live, "key", ["seq"], bucket_of(F.col("seq"), span), {"tests_before": F.col("test"), "ended": F.col("ends").cast("int")})
    counted = counted.withColumn("tests", F.col("tests_before") + F.col("test"))
    # the batch's tests up to the end of the last run that ended before this row
    counted = running(counted, "key", ["seq"], bucket_of(F.col("seq"), span), maxima={"at_end": F.when(F.col("ends"), F.col("tests"))})
    since = F.when(F.col("ended") > 0, F.col("tests_before") - F.col("at_end")).otherwise(F.col("s_attempts") + F.col("tests_before"))
    routed = counted.withColumns({"run_no": F.col("s_run_no") + F.col("ended"), "retry_count": since})
    return routed.withColumn("route", F.when(F.col("decision_row"), runs.route_after_decision(F.col("decision"))).otherwise(
        runs.route_after_test(F.col("passed"), F.col("retry_count"), limit)))


def _new_state(routed: DataFrame) -> DataFrame:
    """One row for each key of the batch."""
    per = routed.groupBy("key").agg(
        F.max("seq").alias("last_seq"), F.max("event_time").alias("last_time"), F.max("s_run_no").alias("s_run_no"),
        F.max("s_attempts").alias("s_attempts"), F.sum("test").alias("tests"), F.sum(F.col("ends").cast("long")).alias("ended"),
        F.max(F.when(F.col("ends"), F.col("tests"))).alias("at_end"))
    return per.select("key", (F.col("s_run_no") + F.col("ended")).alias("run_no"),
                      F.when(F.col("ended") > 0, F.col("tests") - F.col("at_end")).otherwise(F.col("s_attempts") + F.col("tests")).alias("attempts"),
                      "last_seq", "last_time")


def _state(spark: SparkSession, base: str, at, oldest) -> DataFrame | None:
    """The newest row of every key that has not expired."""
    rows = deltas.read(spark, base, "state", at) if at else None
    if rows is None:
        return None
    state = deltas.newest(rows, "key")
    return state if oldest is None else state.where((F.col("attempts") > 0) | F.col("last_time").isNull() | (F.col("last_time") >= F.lit(oldest)))


def _oldest(spark: SparkSession, base: str, at, ttl):
    """The time before which ended runs have expired; None while nothing expires."""
    if at is None or ttl is None:
        return None
    watermark = deltas.read(spark, base, "watermark", at).agg(F.max("watermark")).first()[0]
    return None if watermark is None else watermark - ttl


def apply_batch(spark: SparkSession, base: str, events: DataFrame, batch_id: int | None, stream_id: str = "default", ttl=None, delay=None,
                limit: int = MAX_RETRIES, span: int = SPAN, compact_every: int | None = COMPACT_EVERY) -> int | None:
    """Route one micro-batch of ``events_of`` rows; ``ttl`` and ``delay`` are timedeltas. Returns its number, None for a replay."""
    if batch_id is not None and deltas.is_applied(spark, base, stream_id, batch_id):
        return None
    at = deltas.log(spark, base)
    oldest = _oldest(spark, base, at, ttl)
    rows = materialize(_with_state(_first_of_seq(events), _state(spark, base, at, oldest), oldest))
    routed = materialize(route(rows, limit, span))
    shown = lambda df, status: df.select(
        "key", "seq", "run_no", "retry_count", F.when(~F.col("decision_row"), F.col("passed")).alias("passed"), "decision", "route",
        F.lit(status).alias("status"))
    none = {c: F.lit(None).cast(t) for c, t in (("run_no", "long"), ("retry_count", "long"), ("route", "string"))}
    out = shown(routed, "routed").union(shown(rows.where("expired").withColumns(none), "expired"))
    top = F.max("event_time")
    seconds = 0 if delay is None else delay.total_seconds()
    watermark = rows.agg((top - F.expr(f"make_dt_interval(0, 0, 0, {seconds})")).alias("watermark"))
    batch, generation = (at.next_batch, at.generation) if at else (0, 0)
    deltas.append(spark, base, {"routed": out, "state": _new_state(routed), "watermark": watermark}, batch, generation, stream_id, batch_id)
    if compact_every and at and len(at.batches) + 1 >= compact_every:
        compact(spark, base, ttl)
    return batch


def compact(spark: SparkSession, base: str, ttl=None) -> None:
    """One state row per key that has not expired, one watermark, and the routed rows, as the next generation's first batch."""
    at = deltas.log(spark, base)
    state = _state(spark, base, at, _oldest(spark, base, at, ttl)).drop("batch")
    watermark = deltas.read(spark, base, "watermark", at).agg(F.max("watermark").alias("watermark"))
    deltas.compact(spark, base, {"routed": deltas.read(spark, base, "routed", at).drop("batch"), "state": state, "watermark": watermark}, at)


def start(spark: SparkSession, stream: DataFrame, base: str, checkpoint: str, **options):
    """A writer that routes ``stream`` (rows of ``events_of``) below ``base``; trigger and start it. The checkpoint path is its id."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: apply_batch(spark, base, df, batch_id, checkpoint, **options))


def routed(spark: SparkSession, base: str) -> DataFrame:
    """Every routed row so far."""
    rows = deltas.read(spark, base, "routed")
    return spark.createDataFrame([], OUT_SCHEMA) if rows is None else rows
