"""W1 idempotent refresh and W2 == batch routing."""

import uuid

from corpusweave.operators import changes as C
from corpusweave.sources import deltas
from corpusweave.streaming import refresh as W1
from corpusweave.streaming import routing as W2


def test_w1_batches_apply_once(spark, tmp_path):
    import datetime as dt
    base = str(tmp_path / "idx")
    rows = [(1, "m/a.py", dt.datetime(2024, 1, 1), 22, bytearray(b"def f():\n    g()\n"), "upsert"),
            (2, "m/b.py", dt.datetime(2024, 1, 1), 22, bytearray(b"def g():\n    pass\n"), "upsert")]
    b0 = spark.createDataFrame(rows, C.CHANGE_SCHEMA)
    assert W1.apply_batch(spark, base, b0, 0) == 0
    assert W1.apply_batch(spark, base, b0, 0) is None  # replay of batch 0 is skipped
    b1 = spark.createDataFrame([(3, "m/b.py", None, None, None, "delete")], C.CHANGE_SCHEMA)
    assert W1.apply_batch(spark, base, b1, 1) == 1
    index = W1.load_index(spark, base)
    assert {r["path"] for r in index["manifest"].collect()} == {"m/a.py"}
    edges = {(r["src"], r["dst"]) for r in index["edges"].collect()}
    assert ("m.a.f", "g") in edges  # g vanished with b.py: the call falls back to raw text


def test_w2_stream_equals_batch(spark, tmp_path):
    from corpusweave.plans import queries as Q
    d = "/root/testdata/sf0.001"
    got = {tuple(r) for r in Q.q_stream_routing(spark, d).select(
        "seq", "thread_id", "retry_count", "passed", "route").collect()}
    want = {tuple(r) for r in Q.q_retry_routing(spark, d).select(
        "seq", "thread_id", "retry_count", "passed", "route").collect()}
    assert got == want and len(got) > 0


def test_w1_restart_and_late_rows(spark, tmp_path):
    import datetime as dt
    base, t = str(tmp_path / "idx"), dt.datetime(2024, 1, 1)
    row = lambda seq, body: spark.createDataFrame([(seq, "m/a.py", t, len(body), bytearray(body), "upsert")], C.CHANGE_SCHEMA)
    assert W1.apply_batch(spark, base, row(9, b"def new():\n    pass\n"), 0, "one") == 0
    assert W1.apply_batch(spark, base, row(5, b"def old():\n    pass\n"), 1, "one") == 1  # late: ignored
    names = lambda: {r["short_name"] for r in W1.load_index(spark, base)["chunks"].collect()}
    assert names() == {"new"}
    assert W1.apply_batch(spark, base, row(10, b"def newer():\n    pass\n"), 0, "two") == 2  # another stream's batch 0
    assert names() == {"newer"}


def test_w2_order_duplicates_and_hot_key(spark, tmp_path):
    import random
    base = str(tmp_path / f"w2-{uuid.uuid4().hex}")
    schema = "seq BIGINT, key BIGINT, passed BOOLEAN"
    hot = [(s, 8, s % 7 == 0) for s in range(2000)]
    random.Random(1).shuffle(hot)
    batches = [[(1, 7, False), (2, 7, False), *hot], [(2, 7, False), (1, 7, False), (3, 7, True)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).write.parquet(f"{base}/in/b{i}")
        stream = W2.events_of(spark.readStream.schema(schema).parquet(f"{base}/in/*"))
        # a small span: the hot key's 2000 rows fall into many buckets
        q = W2.start(spark, stream, f"{base}/out", f"{base}/ck", span=64).trigger(availableNow=True).start()
        q.awaitTermination()
    out = W2.routed(spark, f"{base}/out")
    got = sorted(tuple(r) for r in out.where("key = '7'").select("seq", "retry_count", "route").collect())
    assert got == [(1, 0, "retry"), (2, 1, "retry"), (3, 2, "build")]
    hot_out = sorted(tuple(r) for r in out.where("key = '8'").select("seq", "run_no", "retry_count").collect())
    assert hot_out == [(s, -(-s // 7), (s - 1) % 7 if s else 0) for s in range(2000)]


def _change(spark, *rows):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(seq, path, t + dt.timedelta(seconds=seq), len(body) if body is not None else None,
                                   bytearray(body) if body is not None else None, "upsert" if body is not None else "delete")
                                  for seq, path, body in rows], C.CHANGE_SCHEMA)


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _written(spark, base, batch):
    return {n: deltas.read(spark, base, n).where(f"batch = {batch}").count() for n in W1.TABLES}


def _full(spark, sources):
    """The index of the newest texts, built at once."""
    import datetime as dt
    rows = [(p, dt.datetime(2024, 1, 1), len(b), bytearray(b)) for p, b in sources.items()]
    out = C.refresh(spark.createDataFrame(rows, "path string, modificationTime timestamp, length bigint, content binary"), None, None)
    return out


def test_w1_writes_follow_the_change_and_equal_a_rebuild(spark, tmp_path):
    base = str(tmp_path / "idx")
    files = {f"m/f{i}.py": f"import os\ndef f{i}():\n    f{i - 1}()\n    os.getpid()\n".encode() for i in range(40)}
    assert W1.apply_batch(spark, base, _change(spark, *[(i, p, b) for i, (p, b) in enumerate(files.items())]), 0) == 0
    assert _written(spark, base, 0)["files"] == 40

    # an edit that keeps the file's symbols: one file's rows, no call elsewhere is resolved again
    files["m/f5.py"] = b"def f5():\n    f4()\n    f3()\n"
    assert W1.apply_batch(spark, base, _change(spark, (100, "m/f5.py", files["m/f5.py"])), 1) == 1
    assert _written(spark, base, 1) == {"files": 1, "chunks": 1, "imports": 0, "raw_calls": 2, "parse_errors": 0, "targets": 2}

    # f7 is renamed: only the file itself and the one call of f7() elsewhere change
    files["m/f7.py"] = b"def other():\n    pass\n"
    assert W1.apply_batch(spark, base, _change(spark, (101, "m/f7.py", files["m/f7.py"])), 2) == 2
    assert _written(spark, base, 2) == {"files": 1, "chunks": 1, "imports": 0, "raw_calls": 0, "parse_errors": 0, "targets": 1}

    # deleted, touched without change, late, unknown
    del files["m/f9.py"]
    batch = _change(spark, (102, "m/f9.py", None), (103, "m/f1.py", files["m/f1.py"]), (50, "m/f5.py", b"late = 1\n"), (104, "m/none.py", None))
    assert W1.apply_batch(spark, base, batch, 3) == 3
    assert _written(spark, base, 3) == {"files": 3, "chunks": 0, "imports": 0, "raw_calls": 0, "parse_errors": 0, "targets": 1}

    def check():
        got, want = W1.load_index(spark, base), _full(spark, files)
        for name, cols in (("chunks", ("path", "symbol_id", "content")), ("imports", ("path", "pos", "import_text")), ("symbols", ("symbol_id", "path")),
                           ("raw_calls", ("path", "caller", "pos", "raw_call")), ("edges", ("src", "dst", "resolved")), ("manifest", ("path", "size", "hash"))):
            assert _rows(got[name], *cols) == _rows(want[name], *cols), name
        C.release(want)
    check()
    W1.compact(spark, base)
    assert len(deltas.log(spark, base).batches) == 1 and deltas.log(spark, base).generation == 1
    check()
    # after compaction: replays are known, late rows still lose, an f9 comes back, calls of it resolve again
    assert W1.apply_batch(spark, base, batch, 3) is None
    files["m/f9.py"] = b"def f9():\n    f8()\n"
    batch = _change(spark, (90, "m/f9.py", b"late = 1\n"), (105, "m/f9.py", files["m/f9.py"]), (103, "m/none.py", b"late = 1\n"))
    assert W1.apply_batch(spark, base, batch, 4) == 4
    check()


def test_w1_nothing_to_do_and_automatic_compaction(spark, tmp_path):
    base = str(tmp_path / "idx")
    assert W1.load_index(spark, base) is None
    assert W1.apply_batch(spark, base, _change(spark, (1, "a.py", None)), 0) == 0  # an unknown path's deletion first
    assert W1.load_index(spark, base)["edges"].count() == 0
    assert W1.apply_batch(spark, base, _change(spark, (1, "a.py", b"def late():\n    pass\n")), 1) == 1
    assert W1.load_index(spark, base)["manifest"].count() == 0
    assert W1.apply_batch(spark, base, _change(spark, (2, "a.py", b"def a():\n    pass\n")), 2, compact_every=3) == 2
    assert len(deltas.log(spark, base).batches) == 1
    assert _rows(W1.load_index(spark, base)["symbols"], "symbol_id") == [("a.a",)]


def test_deltas_show_committed_batches_only(spark, tmp_path):
    base = str(tmp_path / "d")
    row = lambda k, v: spark.createDataFrame([(k, v)], "k string, v int")
    assert deltas.log(spark, base) is None and deltas.read(spark, base, "t") is None
    deltas.append(spark, base, {"t": row("a", 1)}, 0, stream_id="s", stream_batch=0)
    row("a", 9).selectExpr("*", "1L AS batch").write.parquet(f"{base}/t/1-died")  # never committed
    deltas.append(spark, base, {"t": row("a", 2).union(row("b", 3))}, 1)
    assert _rows(deltas.newest(deltas.read(spark, base, "t"), "k"), "k", "v") == [("a", 2), ("b", 3)]
    assert deltas.read(spark, base, "t").count() == 3 and deltas.read(spark, base, "other") is None
    assert deltas.is_applied(spark, base, "s", 0) and not deltas.is_applied(spark, base, "s", 1)


def test_w2_decisions_end_or_continue_runs(spark, tmp_path):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    test = lambda k, s, ok=False: (k, s, t, ok, None, False)
    say = lambda k, s, d: (k, s, t, None, d, True)
    batches = [[test("a", i) for i in range(4)] + [say("b", 1, "approve")],
               [say("a", 4, "retry"), test("a", 5), say("a", 6, "abandon"), test("a", 7), (None, 1, None, None, None, None)],
               [test("a", 8, True), test("a", 9), (None, 2, t, True, None, False), ("b", None, t, True, None, False)]]
    for span, base in ((1 << 16, "one"), (2, "two")):
        got = _drain(spark, str(tmp_path / base), [batches[0][::-1], batches[1], batches[2][::-1]], span=span)
        assert [r for r in got if r[0] == "a"] == [
            ("a", 0, 0, 0, "retry", "routed"), ("a", 1, 0, 1, "retry", "routed"), ("a", 2, 0, 2, "retry", "routed"), ("a", 3, 0, 3, "escalate", "routed"),
            ("a", 4, 0, 4, "retry", "routed"), ("a", 5, 0, 4, "escalate", "routed"), ("a", 6, 0, 5, "end", "routed"),
            ("a", 7, 1, 0, "retry", "routed"), ("a", 8, 1, 1, "build", "routed"), ("a", 9, 2, 0, "retry", "routed")]
        assert [r for r in got if r[0] == "b"] == [("b", 1, 0, 0, "build", "routed")]
        assert [r for r in got if r[0] is None] == [(None, 1, 0, 0, "retry", "routed"), (None, 2, 0, 1, "build", "routed")]


def _drain(spark, base, batches, **options):
    schema = "key string, seq long, event_time timestamp, passed boolean, decision string, decision_row boolean"
    for i, b in enumerate(batches):
        events = W2.events_of(spark.createDataFrame(b, schema), event_time="event_time", decision="decision", decision_row="decision_row")
        assert W2.apply_batch(spark, base, events, i, **options) == i
        assert W2.apply_batch(spark, base, events, i, **options) is None  # a replay adds nothing
    rows = W2.routed(spark, base).select("key", "seq", "run_no", "retry_count", "route", "status").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] or "", r[1]))


def test_w2_ended_runs_expire(spark, tmp_path):
    import datetime as dt
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    row = lambda k, s, n, ok=False: (k, s, day(n), ok, None, False)
    batches = [[row("done", 1, 0, True), row("open", 1, 0), row("open", 2, 0)], [row("new", 1, 30)],
               # older than watermark - ttl: the key's state may be gone; with state, an old row is judged by its seq alone
               [row("done", 2, 1), row("unseen", 1, 1), row("open", 3, 1), row("open", 2, 1), row("done", 3, 29, True)],
               [row("done", 4, 29)]]
    got = _drain(spark, str(tmp_path / "ttl"), batches, ttl=dt.timedelta(days=7), delay=dt.timedelta(days=2))
    assert got == [("done", 1, 0, 0, "build", "routed"), ("done", 2, None, None, None, "expired"), ("done", 3, 0, 0, "build", "routed"),
                   ("done", 4, 1, 0, "retry", "routed"), ("new", 1, 0, 0, "retry", "routed"), ("open", 1, 0, 0, "retry", "routed"),
                   ("open", 2, 0, 1, "retry", "routed"), ("open", 3, 0, 2, "retry", "routed"), ("unseen", 1, None, None, None, "expired")]
    base = str(tmp_path / "ttl")
    kept = lambda: {r["key"] for r in deltas.read(spark, base, "state").collect()}
    assert kept() == {"done", "open", "new"}
    assert W2.apply_batch(spark, base, W2.events_of(spark.createDataFrame([("new", 2, day(90), True)], "key string, seq long, t timestamp, passed boolean"),
                                                    event_time="t"), 9) == 4
    W2.compact(spark, base, dt.timedelta(days=7))
    assert kept() == {"done", "open", "new"}  # both still open, new ended just now
    assert len(W2.routed(spark, base).collect()) == 10


def test_running_values_equal_plain_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from corpusweave.operators.segments import bucket_of, running
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
                                  (F.col("id") - 1000).alias("seq"), (F.col("id") * 37 % 11).alias("v"))
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "seq", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w).alias("m"))
    got = running(df, "k", ["seq"], bucket_of(F.col("seq"), 50), {"s": F.col("v")}, {"m": F.col("v")}).select("k", "seq", "s", "m")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # the hot key is spread: no task of the windows over rows is dealt by the key alone
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan.replace(" ", "") and "_bucket" in plan
