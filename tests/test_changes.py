"""Classification rules, and incremental refresh == full rebuild."""

import datetime as dt

from corpusweave.operators import changes as C
from corpusweave.sources import store as S
from tests.conftest import sources_df

T0 = dt.datetime(2024, 1, 1)


def snap(spark, rows):
    return spark.createDataFrame(rows, "path string, size bigint, mtime timestamp, hash string")


def test_classify_rules(spark):
    s = snap(spark, [("new", 1, T0, "h"), ("chg", 2, T0, "h2"), ("touch", 1, T0, "h"),
                     ("samemeta", 1, T0, "h2"), ("same", 1, T0, "h")])
    m = snap(spark, [("chg", 1, T0, "h"), ("touch", 1, T0 - dt.timedelta(seconds=1), "h"),
                     ("samemeta", 1, T0, "h"), ("same", 1, T0, "h"), ("gone", 1, T0, "h")])
    got = {r["path"]: r["status"] for r in C.classify(s, m).collect()}
    assert got == {"new": "NEW", "chg": "CHANGED", "touch": "UNCHANGED", "samemeta": "UNCHANGED",
                   "same": "UNCHANGED", "gone": "DELETED"}
    assert {r["path"]: r["status"] for r in C.classify(s, m, always_hash=True).collect()}["samemeta"] == "CHANGED"


def _files(v):
    base = {
        "pkg/a.py": b"from pkg.b import helper\ndef main():\n    helper()\n",
        "pkg/b.py": b"def helper():\n    return 1\n",
        "pkg/c.py": b"import os\nclass K:\n    def helper(self):\n        main()\n",
    }
    if v == 2:
        base["pkg/b.py"] = b"def helper():\n    return 2\ndef extra():\n    helper()\n"
        del base["pkg/c.py"]
        base["pkg/d.py"] = b"def main():\n    pass\n"
    return base


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_incremental_equals_full_rebuild(spark, tmp_path):
    v1 = sources_df(spark, _files(1))
    first = C.refresh(v1, None, None)
    base = str(tmp_path / "idx")
    S.write_tables(spark, base, {k: first[k] for k in ("chunks", "imports", "raw_calls", "parse_errors",
                                                       "manifest", "symbols", "resolved_calls")})
    import datetime
    rows2 = [(p, datetime.datetime(2024, 1, 2), len(b), bytearray(b)) for p, b in _files(2).items()]
    v2 = spark.createDataFrame(rows2, "path string, modificationTime timestamp, length bigint, content binary")
    names = ("chunks", "imports", "raw_calls", "parse_errors")
    idx = {k: S.read_table(spark, base, k) for k in names}
    inc_full_graph = C.refresh(v2, idx, S.read_table(spark, base, "manifest"))
    idx2 = {k: S.read_table(spark, base, k) for k in names + ("symbols", "resolved_calls")}
    inc = C.refresh(v2, idx2, S.read_table(spark, base, "manifest"))  # incremental graph upkeep
    full = C.refresh(v2, None, None)
    assert _rows(inc_full_graph["edges"], ["src", "dst", "resolved"]) == _rows(full["edges"], ["src", "dst", "resolved"])
    assert {r["path"]: r["status"] for r in inc["status"].collect()} == {
        "pkg/a.py": "UNCHANGED", "pkg/b.py": "CHANGED", "pkg/c.py": "DELETED", "pkg/d.py": "NEW"}
    for name, cols in [("chunks", ["chunk_id", "symbol_id", "path", "start_line", "content"]),
                       ("imports", ["path", "pos", "import_text"]),
                       ("symbols", ["symbol_id", "chunk_id", "start_line"]),
                       ("edges", ["src", "dst", "resolved"])]:
        assert _rows(inc[name], cols) == _rows(full[name], cols), name
    # calls into a changed file are re-resolved (Q4/Q5): main() now has two candidates
    e = {(r["src"], r["dst"]) for r in inc["edges"].collect()}
    assert ("pkg.b.extra", "pkg.b.helper") in e and ("pkg.a.main", "pkg.b.helper") in e


def test_store_versions_and_upsert(spark, tmp_path):
    base = str(tmp_path / "s")
    old = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "chunk_id string, v int")
    up = S.upsert(old, new, order_col="v")
    assert _rows(up, ["chunk_id", "v"]) == [("a", 1), ("b", 4), ("c", 5)]
    assert S.write_tables(spark, base, {"t": up}) == 1
    assert S.write_tables(spark, base, {"t": S.delete_ids(up, new.select("chunk_id"))}, batch_id=0, stream_id="s") == 2
    assert _rows(S.read_table(spark, base, "t"), ["chunk_id", "v"]) == [("a", 1)]
    assert _rows(S.read_table(spark, base, "t", 1), ["chunk_id"]) == [("a",), ("b",), ("c",)]
    assert S.is_committed(spark, base, "s", 0) and not S.is_committed(spark, base, "other", 0)
    ids = spark.createDataFrame([("a",), ("z",)], "chunk_id string")
    assert _rows(S.fetch_ids(up, ids), ["chunk_id", "v"]) == [("a", 1)]


def test_scan_source_tree(spark, tmp_path):
    from corpusweave.sources.codetree import scan_source_tree
    root = tmp_path / "repo"
    (root / "pkg" / "sub").mkdir(parents=True)
    (root / "pkg" / "a.py").write_bytes(b"def f():\n    pass\n")
    (root / "pkg" / "sub" / "b.py").write_bytes(b"x = 1\n")
    (root / "notes.txt").write_bytes(b"skip me")
    rows = {r["path"]: r for r in scan_source_tree(spark, str(root)).collect()}
    assert set(rows) == {"pkg/a.py", "pkg/sub/b.py"}
    assert rows["pkg/a.py"]["length"] == 18 and rows["pkg/a.py"]["repo"] == "repo"
    st = C.classify(C.snapshot(scan_source_tree(spark, str(root))), snap(spark, [])).collect()
    assert {r["status"] for r in st} == {"NEW"}


def test_listing_decides_which_files_are_opened(spark, tmp_path):
    import os
    from pyspark.sql import functions as F
    from corpusweave.sources import codetree
    root = tmp_path / "tree"
    (root / "pkg").mkdir(parents=True)
    for i in range(6):
        (root / "pkg" / f"m{i}.py").write_bytes(f"def f{i}():\n    pass\n".encode())
        os.utime(root / "pkg" / f"m{i}.py", (1_700_000_000 + i, 1_700_000_000 + i))
    manifest = C.refresh_manifest(C.classify(C.snapshot(codetree.scan_source_tree(spark, str(root))), spark.createDataFrame(
        [], "path string, size bigint, mtime timestamp, hash string"))).checkpoint()
    (root / "pkg" / "m1.py").write_bytes(b"def g1():\n    return 1\n")     # size differs
    os.utime(root / "pkg" / "m2.py", (1_800_000_000, 1_800_000_000))          # touched only
    (root / "pkg" / "m3.py").write_bytes(b"def g3():\n    pass\n")          # other bytes, same size and time: not seen, by rule
    os.utime(root / "pkg" / "m3.py", (1_700_000_003, 1_700_000_003))
    (root / "pkg" / "m4.py").unlink()
    (root / "pkg" / "n.py").write_bytes(b"x = 1\n")
    listing = codetree.list_source_tree(spark, str(root))
    assert "content" not in listing.columns and "content" not in listing._jdf.queryExecution().executedPlan().toString()
    status, opened = C.classify_tree(spark, str(root), manifest)
    assert sorted(r["path"] for r in opened.collect()) == ["pkg/m1.py", "pkg/m2.py", "pkg/n.py"]
    want = C.classify(C.snapshot(codetree.scan_source_tree(spark, str(root))), manifest)
    cols = ("path", "status", "size", "mtime", "old_size", "old_mtime", "old_hash")
    assert _rows(status, cols) == _rows(want, cols)
    assert {r["path"]: r["status"] for r in status.collect()}["pkg/m3.py"] == C.UNCHANGED
    # nothing differs: no file is opened at all
    same = C.refresh_manifest(status).checkpoint()
    assert C.suspects(codetree.list_source_tree(spark, str(root)).where(F.col("path") != "pkg/m2.py"), same).count() == 0
    out = C.refresh_tree(spark, str(root), None, None)
    assert {r["short_name"] for r in out["symbols"].collect()} >= {"g1", "f0", "f5"}
    C.release(out)
