"""L1-L8, T1-T12, D1-D5, P1-P3, S7 on small literal frames."""

import json

from pyspark.sql import functions as F

from corpusweave.operators import deps as D
from corpusweave.operators import prompts as P
from corpusweave.operators import replies as L
from corpusweave.operators import runs as RU
from corpusweave.sources import runlog
from tests.conftest import sources_df


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col(F.col("x")).alias("y")).first()["y"]


def test_normalize_path_q15(spark):
    cases = {"../corpus/svc/a.py": "svc/a.py", "corpus/svc/a.py": "svc/a.py", "/svc/a.py": "svc/a.py",
             "svc/a.py": "svc/a.py", "../corpus2/svc/a.py": "../corpus2/svc/a.py"}
    for raw, want in cases.items():
        assert one(spark, lambda c: L.normalize_path(c, "../corpus/"), raw) == want


def test_reply_parsing_and_coverage(spark):
    plan = {"analysis": "a", "files_to_modify": [{"file_path": "x.py", "changes": []}]}
    rows = [(1, "```json\n" + json.dumps(plan) + "\n```"), (2, "  \n" + json.dumps(plan) + "\n"),
            (3, json.dumps(plan)[:-1]), (4, '```json\n{"needs_new_tests": true, "reasoning": "r"}\n```')]
    df = spark.createDataFrame(rows, "plan_id long, raw_text string")
    p = {r["plan_id"]: r for r in L.parse_replies(df).collect()}
    assert p[1]["parse_ok"] and p[2]["parse_ok"] and not p[3]["parse_ok"]
    assert p[1]["parsed"]["files_to_modify"][0]["file_path"] == "x.py" and p[3]["parsed"] is None
    cov = {r["plan_id"]: r for r in L.coverage_decision(df).collect()}
    assert cov[4]["needs_new_tests"] and cov[4]["reason_code"] == "COVERAGE_ANALYSIS_SUCCESS"
    assert not cov[3]["needs_new_tests"] and cov[3]["reason_code"] == "COVERAGE_ANALYSIS_PARSE_ERROR"


def test_error_classes_in_order_and_schedule(spark):
    rows = [(1, 0, None, "429 RESOURCE_EXHAUSTED"), (2, 0, None, "quota 503"), (3, 0, "ServerError", "401"),
            (4, 0, None, "read Timeout"), (5, 0, None, "401 bad key"),
            (6, 0, None, "503 a"), (6, 1, None, "503 b"), (6, 2, None, "503 c"),
            (7, 0, None, "503 a"), (7, 1, None, "bad request"), (7, 2, None, "503 never reached")]
    df = spark.createDataFrame(rows, "call_id long, attempt int, error_class string, message string")
    t = {(r["call_id"], r["attempt"]): r["error_kind"] for r in L.triage_errors(df).collect()}
    assert [t[(i, 0)] for i in range(1, 6)] == ["QUOTA_EXCEEDED", "QUOTA_EXCEEDED", "TRANSIENT", "TRANSIENT",
                                                 "FATAL"]
    s = {(r["call_id"], r["attempt"]): (r["reached"], r["will_retry"], r["wait_s"], r["gave_up"])
         for r in L.retry_schedule(df).collect()}
    assert [s[(6, a)] for a in range(3)] == [(True, True, 5, False), (True, True, 10, False), (True, False, 0, True)]
    assert s[(7, 1)] == (True, False, 0, True) and s[(7, 2)][0] is False
    long = "x" * 250 + "\nsecond"
    assert one(spark, L.short_error, long) == "x" * 200 + "..."


def test_edit_fold(spark):
    src = sources_df(spark, {"m.py": b"def f(self):\n    return g(self)\n"})
    edits = spark.createDataFrame([
        (1, 0, "m.py", 0, "f", "(self)", "(me)"), (1, 0, "m.py", 1, "f", "g(me)", "g(me, {TIMESTAMP!r})"),
        (1, 0, "m.py", 2, "f", "absent", "x"), (2, 0, "m.py", 0, "f", "return", "return return"),
        (3, 0, "nope.py", 0, "f", "a", "b")],
        "plan_id long, file_pos int, path string, change_pos int, function_name string, "
        "original_code string, modified_code string")
    ev = {(r["plan_id"], r["change_pos"]): r for r in L.evaluate_edits(edits, src, stamp="T").collect()}
    assert [ev[(1, i)]["edit_status"] for i in range(3)] == ["applied", "rejected_invalid", "skipped_not_found"]
    assert ev[(1, 0)]["new_content"] == "def f(me):\n    return g(me)\n"  # every occurrence (Q16)
    assert ev[(2, 0)]["edit_status"] == "rejected_invalid" and ev[(2, 0)]["reason"].startswith("invalid syntax")
    assert ev[(3, 0)]["file_status"] == "missing"


def test_a_file_listed_twice_is_folded_in_order(spark):
    src = sources_df(spark, {"a.py": b"x = 1\n", "b.py": b"y = 1\n"})
    edits = spark.createDataFrame([
        (1, 0, "a.py", 0, "f", "x = 1", "x = 2"), (1, 1, "b.py", 0, "f", "y = 1", "y = ="),
        (1, 2, "a.py", 0, "f", "x = 2", "x = 3"), (1, 2, "a.py", 1, "f", "x = 1", "x = 4"),
        (2, 0, "a.py", 0, "f", "x = 2", "x = 9")],  # another plan starts from the file as it is
        "plan_id long, file_pos int, path string, change_pos int, function_name string, original_code string, modified_code string")
    got = {(r["plan_id"], r["file_pos"], r["change_pos"]): (r["edit_status"], r["file_status"], r["new_content"])
           for r in L.evaluate_edits(edits, src, stamp="T").collect()}
    assert got == {(1, 0, 0): ("applied", "modified", "x = 2\n"), (1, 1, 0): ("rejected_invalid", "unchanged", None),
                   (1, 2, 0): ("applied", "modified", "x = 3\n"), (1, 2, 1): ("skipped_not_found", "modified", "x = 3\n"),
                   (2, 0, 0): ("skipped_not_found", "unchanged", None)}


def test_test_summary_routes_and_state(spark):
    runs = spark.createDataFrame([(0, "a\n1 passed in 0.1s\nDone"), (1, "Error: boom\n2 failed\nbye"), (1, "")],
                                 "returncode int, output string")
    got = [(r["summary"], r["reason_code"]) for r in RU.summarize_test_run(runs).collect()]
    assert got == [("1 passed in 0.1s", "TESTS_PASSED"), ("2 failed", "TESTS_FAILED"), ("Tests failed", "TESTS_FAILED")]
    df = spark.createDataFrame([(True, 5, "approve"), (False, 3, "retry"), (False, 2, None), (None, None, "x")],
                               "p boolean, n int, d string")
    r = df.select(RU.route_after_test(F.col("p"), F.col("n")).alias("t"),
                  RU.route_after_decision(F.col("d")).alias("h")).collect()
    assert [(x["t"], x["h"]) for x in r] == [("build", "build"), ("escalate", "retry"), ("retry", "end"),
                                             ("retry", "end")]
    ev = spark.createDataFrame([("t1", 1, "code", "a"), ("t1", 2, "passed", "x"), ("t1", 3, "code", "b")],
                               "thread_id string, seq long, key string, value string")
    st = RU.latest_state(ev, ["code", "passed"]).first()
    assert st["code"] == "b" and st["passed"] == "x"  # stale keys survive


def test_transitions_and_tickets(spark):
    w = spark.createDataFrame([("T1", "in progress"), ("T2", "Done")], "ticket_key string, status_name string")
    tr = spark.createDataFrame([("T1", 0, "11", "To Do"), ("T1", 1, "21", "In Progress"), ("T2", 0, "31", "Open")],
                               "ticket_key string, pos int, id string, name string")
    got = {r["ticket_key"]: r for r in RU.match_transitions(w, tr).collect()}
    assert got["T1"]["transition_id"] == "21" and got["T1"]["success"]
    assert got["T2"]["error"] == "Status 'Done' not available. Available: ['Open']"
    t = spark.createDataFrame([(1, "s", "d", "FEATURE", "Critical"), (2, "s", "d", None, "weird")],
                              "ticket_id long, summary string, description string, issue_type string, priority string")
    n = {r["ticket_id"]: r for r in RU.normalize_tickets(t).collect()}
    assert (n[1]["issue_type_name"], n[1]["priority_name"]) == ("Story", "Highest")
    assert (n[2]["issue_type_name"], n[2]["priority_name"]) == ("Bug", "Medium")
    assert json.loads(n[1]["payload"])["fields"]["description"]["content"][0]["content"][0]["text"] == "d"


def test_dependency_audit(spark):
    src = sources_df(spark, {"app.py": b"", "svc/a.py": b"", "tests/t.py": b"", ".hidden/x.py": b"",
                             "data/d.py": b""}).withColumn("repo", F.lit("r"))
    loc = {r["module"] for r in D.local_modules(src).collect()}
    assert loc == {"app", "svc"}
    mods = spark.createDataFrame([("r", "svc/a.py", "yaml"), ("r", "svc/a.py", "os"), ("r", "svc/a.py", "svc"),
                                  ("r", "tests/t.py", "pytest"), ("r", "app.py", "Flask")],
                                 "repo string, path string, module string")
    tp = {r["package"] for r in D.third_party(spark, src, mods).collect()}
    assert tp == {"pyyaml", "Flask"}
    lines = spark.createDataFrame([("r", 0, "PyYAML==6"), ("r", 1, "# flask"), ("r", 2, ""), ("r", 3, "svc>=1")],
                                  "repo string, pos int, line string")
    res = D.missing_packages(D.third_party(spark, src, mods), lines, src).collect()
    assert [(r["reason_code"], r["rank"], r["package"]) for r in res] == [("REQUIREMENTS_UPDATED", 1, "Flask")]
    cl = {r["pos"]: r["kept"] for r in D.clean_requirements(lines, src).collect()}
    assert cl == {0: True, 1: True, 3: False}


def test_prompt_and_log_display(spark):
    hits = spark.createDataFrame([(1, 2, "m.g", "m.py", 3, 4, "graph", 0.6, "def g(): pass"),
                                  (1, 1, "m.f", "m.py", 0, 1, "semantic", 1.0, "def f(): pass")],
                                 "query_id long, rank int, symbol_id string, path string, start_line int, "
                                 "end_line int, source string, score double, content string")
    txt = P.render_chunks(hits).first()["chunks_text"]
    assert txt.index("Symbol: m.f") < txt.index("Symbol: m.g") and "Relevance score: 0.60" in txt
    t = spark.createDataFrame([(1, "K-1", "u", "q")], "query_id long, ticket_key string, url string, query string")
    s = spark.createDataFrame([(1, [], ["m.f"], [], [])], "query_id long, seed_symbols array<string>, "
                              "expanded_symbols array<string>, dependencies array<string>, dependents array<string>")
    f = spark.createDataFrame([(1, 2, "sum", "x" * 5000)], "query_id long, retry_count int, summary string, "
                              "full_output string")
    pr = P.assemble(t, s, P.render_chunks(hits), None, f).first()["prompt"]
    assert "None identified" in pr and "- m.f" in pr and "RETRY ATTEMPT #2" in pr
    assert "x" * 3000 in pr and "x" * 3001 not in pr and "No full files provided." in pr
    d = spark.createDataFrame([(None,), ("  \n ",), ("a" * 600,)], "t string").select(
        runlog.display(F.col("t")).alias("d")).collect()
    assert d[0]["d"] == "(no output)" and d[1]["d"] == ""
    assert d[2]["d"].startswith("... [100 earlier characters hidden") and d[2]["d"].endswith("\n" + "a" * 500)


def test_run_log_roundtrip(spark, tmp_path):
    import datetime as dt
    ev = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12, 0, 5), "STEP", "indexing")],
                               "ts timestamp, level string, message string")
    runlog.append_log(ev, str(tmp_path / "log"))
    r = runlog.read_log(spark, str(tmp_path / "log")).first()
    assert r["value"] == "[2024-01-01T12:00:05] STEP: indexing" and r["level"] == "STEP"


def test_requirement_file_states(spark):
    repos = spark.createDataFrame([("none",), ("empty",), ("notes",), ("full",), ("bare",), ("void",)], "repo string")
    files = spark.createDataFrame([("empty",), ("notes",), ("full",), ("bare",)], "repo string")
    lines = spark.createDataFrame([("notes", 0, "# x"), ("notes", 1, " "), ("full", 0, "A==1"), ("full", 1, "b"), ("full", 2, "svc"), ("full", 3, "svc")],
                                  "repo string, pos int, line string")
    scanned = spark.createDataFrame([("none", "b"), ("none", "a"), ("empty", "a"), ("notes", "x"), ("full", "a"), ("full", "B"), ("none", "a")],
                                    "repo string, package string")
    assert {tuple(r) for r in D.requirement_files(repos, files, lines).collect()} == {
        ("none", "absent"), ("void", "absent"), ("empty", "empty"), ("notes", "empty"), ("bare", "empty"), ("full", "present")}
    got = sorted(map(tuple, D.missing_packages(scanned, lines, repos, files).collect()), key=str)
    assert got == sorted([
        ("bare", "REQUIREMENTS_UP_TO_DATE", None, None), ("empty", "REQUIREMENTS_UPDATED", 1, "a"), ("full", "REQUIREMENTS_UP_TO_DATE", 1, "a"),
        ("full", "REQUIREMENTS_UP_TO_DATE", 2, "b"), ("full", "REQUIREMENTS_UP_TO_DATE", 3, "svc"), ("none", "REQUIREMENTS_CREATED", 1, "a"),
        ("none", "REQUIREMENTS_CREATED", 2, "b"), ("notes", "REQUIREMENTS_UPDATED", 1, "x"), ("void", "REQUIREMENTS_CREATED", None, None)], key=str)
    src = spark.createDataFrame([(r, "svc/a.py") for r in ("none", "empty", "notes", "full", "bare", "void")], "repo string, path string")
    cleaned = D.clean_requirements(lines, src)
    st = sorted(map(tuple, D.clean_status(cleaned, scanned, lines, repos, files).collect()), key=str)
    assert st == sorted([
        ("bare", "REQUIREMENTS_ALREADY_CLEAN", None, None), ("empty", "REQUIREMENTS_ALREADY_CLEAN", None, None),
        ("full", "REQUIREMENTS_CLEANED", 1, "svc"), ("none", "REQUIREMENTS_CREATED", 1, "a"), ("none", "REQUIREMENTS_CREATED", 2, "b"),
        ("notes", "REQUIREMENTS_ALREADY_CLEAN", None, None), ("void", "REQUIREMENTS_CREATED", None, None)], key=str)
