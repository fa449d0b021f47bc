"""Registered queries: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the given tables whole (or data Spark derives from them).
Doubles are rounded to 6 places after ranking; integer outputs are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.operators import vectors
from corpusweave.session import materialize, spread
from corpusweave.sources.tables import table


def r6(c) -> F.Column:
    """Round to 6 places; adding 0.0 turns -0.0 into 0.0."""
    return F.round(c, 6) + F.lit(0.0)


def q_semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    hits = vectors.semantic_topk(emb.withColumnRenamed("vec_id", "query_id"),
                                 emb.withColumnRenamed("vec_id", "chunk_id"))
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"),
                       "chunk_id", r6(F.col("distance")).alias("distance"))


QUERIES = {
    "semantic_topk": q_semantic_topk,
}


# ------------------------------------------------------------ index build
from corpusweave.operators import extract as X  # noqa: E402
from corpusweave.operators import graph as G  # noqa: E402
from corpusweave.plans.fixtures import broken_corpus, code_corpus  # noqa: E402


def _parallel(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _corpus_x(spark, d):
    # the corpus derives from one small table: spread the files over the cores
    return X.extract(code_corpus(spark, d), partitions=_parallel(spark))


def q_chunk_extract(spark, d):
    c = X.chunks(_corpus_x(spark, d))
    return c.select("chunk_id", "symbol_id", "short_name", "class_name", "path", "chunk_type",
                    F.col("start_line").cast("bigint").alias("start_line"),
                    F.col("end_line").cast("bigint").alias("end_line"), "language", "content")


def q_import_extract(spark, d):
    i = X.imports(_corpus_x(spark, d))
    return i.select("path", F.col("pos").cast("bigint").alias("pos"), "import_text")


def q_call_extract(spark, d):
    r = X.raw_calls(_corpus_x(spark, d))
    return r.select("path", "caller", F.col("pos").cast("bigint").alias("pos"), "raw_call")


def q_tolerant_extract(spark, d):
    """Everything that files hold which do not parse as a whole: kind, name or place in ``name``, lines from 0 in ``start`` and ``end`` (-1: none)."""
    x = X.extract(broken_corpus(spark, d), partitions=_parallel(spark))
    big = lambda c: c.cast("bigint")
    none = F.lit(-1).cast("bigint")
    error_line = F.regexp_extract("error", r"at line (\d+)$", 1).cast("bigint") - 1
    rows = F.when(F.col("kind") == "error", F.struct(F.lit("").alias("name"), error_line.alias("start"), none.alias("end"), F.lit("").alias("text")))
    row = lambda name, start, end, text: F.struct(name.alias("name"), big(start).alias("start"), big(end).alias("end"), text.alias("text"))
    rows = rows.when(F.col("kind") == "chunk", row(
        F.concat_ws(".", F.when(F.col("chunk_type") == "function_definition", F.col("class_name")), "name"), F.col("start_line"), F.col("end_line"), F.col("content")))
    rows = rows.when(F.col("kind") == "call", row(F.col("name"), F.col("pos"), none, F.col("text")))
    rows = rows.otherwise(row(F.lit(""), F.col("pos"), none, F.col("text")))
    return x.select("path", "kind", rows.alias("r")).select("path", "kind", "r.*")


def q_symbol_table(spark, d):
    s = G.symbol_table(X.chunks(_corpus_x(spark, d)))
    return s.select("symbol_id", "short_name", "path", "chunk_id", "type",
                    F.col("start_line").cast("bigint").alias("start_line"),
                    F.col("end_line").cast("bigint").alias("end_line"))


def q_call_resolution(spark, d):
    x = materialize(_corpus_x(spark, d))  # one Python pass feeds symbols and calls
    syms = G.symbol_table(X.chunks(x))
    res = G.resolve_calls(X.raw_calls(x), syms)
    return G.call_edges(res)


QUERIES.update({
    "chunk_extract": q_chunk_extract,
    "import_extract": q_import_extract,
    "call_extract": q_call_extract,
    "tolerant_extract": q_tolerant_extract,
    "symbol_table": q_symbol_table,
    "call_resolution": q_call_resolution,
})


# ------------------------------------------------------------ graph + retrieval
from corpusweave.operators import retrieve as R  # noqa: E402
from corpusweave.plans.fixtures import page_edges, page_links, vector_edges  # noqa: E402


def q_graph_expand(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("symbol"))
    out = G.graph_expand(pages, page_edges(spark, d))
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "symbol",
                      F.col("hop").cast("bigint").alias("hop"), r6(F.col("score")).alias("score"))


def q_callers_callees(spark, d):
    e = page_edges(spark, d)
    nodes = e.select(F.col("src").alias("symbol_id")).union(e.select(F.col("dst").alias("symbol_id"))).distinct()
    callers = G.callers_of(e, nodes).select(F.col("symbol_id").alias("node"), F.lit("caller").alias("direction"),
                                            F.col("caller").alias("other"))
    callees = G.callees_of(e, nodes).select(F.col("symbol_id").alias("node"), F.lit("callee").alias("direction"),
                                            F.col("callee").alias("other"))
    return callers.union(callees)


def q_dependents_contains(spark, d):
    links = page_links(spark, d)
    modules = links.select(F.regexp_extract("href", "[^/]*$", 0).alias("module")).distinct()
    hits = G.substring_matches(modules, links.select(F.col("href").alias("text")))
    return (hits.join(links, hits["text"] == links["href"])
                .select("module", F.col("url").alias("dependent")).distinct())


def q_related_files(spark, d):
    x = _corpus_x(spark, d)
    src = code_corpus(spark, d).select(F.col("path"), F.regexp_extract("path", r"s_(\d+)", 1)
                                       .cast("bigint").alias("query_id"))
    return G.related_files(X.imports(x), src.select("query_id", "path"))


def q_hybrid_retrieve(spark, d):
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    ids = emb.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("symbol_id"))
    hits = R.hybrid_retrieve(emb.withColumnRenamed("vec_id", "query_id"),
                             emb.withColumnRenamed("vec_id", "chunk_id"), ids, ids, vector_edges(emb))
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id",
                       r6(F.col("score")).alias("score"), "source", r6(F.col("distance")).alias("distance"))


QUERIES.update({
    "graph_expand": q_graph_expand,
    "callers_callees": q_callers_callees,
    "dependents_contains": q_dependents_contains,
    "related_files": q_related_files,
    "hybrid_retrieve": q_hybrid_retrieve,
})


# ------------------------------------------------------------ change detection
from corpusweave.operators import changes as C  # noqa: E402
from corpusweave.plans.fixtures import doc_manifest, doc_snapshot  # noqa: E402
from corpusweave.sources import store as S  # noqa: E402


def q_change_status(spark, d):
    snap = C.snapshot(doc_snapshot(spark, d))
    man = doc_manifest(spark, d)
    a = C.classify(snap, man).select("path", "status")
    b = C.classify(snap, man, always_hash=True).select("path", F.col("status").alias("status_always_hash"))
    return a.join(b, "path")


def q_manifest_refresh(spark, d):
    st = C.classify(C.snapshot(doc_snapshot(spark, d)), doc_manifest(spark, d))
    m = C.refresh_manifest(st)
    return m.select("path", "size", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("mtime"), "hash")


def q_invalidate(spark, d):
    """C4 on a file-scoped table of document lines."""
    snap = doc_snapshot(spark, d)
    st = C.classify(C.snapshot(snap), doc_manifest(spark, d))
    lines = snap.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kept = C.invalidate(lines, st)
    return kept.select("path", F.col("pos").cast("bigint").alias("pos"),
                       F.length("line").cast("bigint").alias("line_chars"))


def q_vector_upsert(spark, d):
    """S3 + S4: vectors keyed by id; new rows for every id divisible by 4
    (shifted by n/2, half replace, half are new), then ids divisible by 10 deleted."""
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = emb.count()
    old = emb.select(F.col("vec_id").alias("chunk_id"), F.lit("old").alias("origin"), "embedding")
    new = emb.where(F.col("vec_id") % 4 == 0).select(
        (F.col("vec_id") + F.lit(n // 2)).alias("chunk_id"), F.lit("new").alias("origin"), "embedding")
    up = S.upsert(old, new, "chunk_id")
    gone = emb.where(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("chunk_id"))
    out = S.delete_ids(up, gone, "chunk_id")
    return out.select("chunk_id", "origin", r6(F.col("embedding")[0].cast("double")).alias("emb_head"))


QUERIES.update({
    "change_status": q_change_status,
    "manifest_refresh": q_manifest_refresh,
    "invalidate": q_invalidate,
    "vector_upsert": q_vector_upsert,
})


# ------------------------------------------------------------ replies, errors, log
from pyspark.sql import types as T  # noqa: E402

from corpusweave.operators import replies as L  # noqa: E402
from corpusweave.plans.fixtures import api_errors, coverage_replies, model_replies, run_events, test_runs  # noqa: E402
from corpusweave.sources import runlog  # noqa: E402


def q_error_triage(spark, d):
    t = L.triage_errors(api_errors(spark, d))
    return t.select("event_id", "call_id", F.col("attempt").cast("bigint").alias("attempt"), "error_kind", "short")


def q_retry_schedule(spark, d):
    s = L.retry_schedule(api_errors(spark, d))
    return s.select("call_id", F.col("attempt").cast("bigint").alias("attempt"), "error_kind", "reached",
                    "will_retry", F.col("wait_s").cast("bigint").alias("wait_s"), "gave_up")


def q_reply_parse(spark, d):
    rep = model_replies(spark, d)
    p = L.parse_replies(rep, T.StructType([T.StructField("k", T.LongType())]))
    cov = L.coverage_decision(rep)
    return (p.select("plan_id", "cleaned", "parse_ok", F.col("parsed.k").cast("string").alias("k"))
             .join(cov.select("plan_id", "reason_code", "needs_new_tests"), "plan_id"))


def q_coverage_decisions(spark, d):
    return L.coverage_decision(coverage_replies(spark, d), api_failed_col="api_failed")


def q_run_log(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "text")
    lv = F.element_at(F.array(*[F.lit(x) for x in runlog.LEVELS]), (F.col("doc_id") % 5 + 1).cast("int"))
    ev = doc.select("doc_id", lv.alias("level"), F.col("text").alias("message"),
                    (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("doc_id").cast("int")))
                    .alias("ts"))
    lines = ev.select("doc_id", "level", runlog.display(F.col("message")).alias("display"),
                      F.format_string("[%s] %s: %s", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
                                      F.col("level"), F.col("message")).alias("log_line"))
    return lines


QUERIES.update({
    "error_triage": q_error_triage,
    "retry_schedule": q_retry_schedule,
    "reply_parse": q_reply_parse,
    "coverage_decisions": q_coverage_decisions,
    "run_log": q_run_log,
})


# ------------------------------------------------------------ run analytics
from corpusweave.operators import runs as RU  # noqa: E402
from corpusweave.operators.segments import bucket_of, running  # noqa: E402

PRIORITY_WORDS = {"1-URGENT": "Critical", "2-HIGH": "HIGH", "3-MEDIUM": "medium",
                  "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
TYPE_WORDS = {"F": "bug", "O": "Feature", "P": "task"}
WANTED_STATUS = {"F": "done", "O": "IN PROGRESS", "P": "In Review"}


def _lookup(d: dict, col: str) -> F.Column:
    return F.element_at(RU._map(d), F.col(col))


def q_ticket_normalise(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    t = o.select(F.col("o_orderkey").alias("ticket_id"),
                 F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("summary"),
                 F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" ordered on "),
                          F.date_format("o_orderdate", "yyyy-MM-dd")).alias("description"),
                 _lookup(TYPE_WORDS, "o_orderstatus").alias("issue_type"),
                 _lookup(PRIORITY_WORDS, "o_orderpriority").alias("priority"))
    return RU.normalize_tickets(t)


def q_status_match(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    wanted = o.select(F.col("o_orderkey").alias("ticket_key"), _lookup(WANTED_STATUS, "o_orderstatus").alias("status_name"))
    name = (F.when(F.col("l_returnflag") == "R", F.lit("In Review"))
             .when(F.col("l_returnflag") == "A", F.lit("In Progress"))
             .when(F.col("l_linestatus") == "F", F.lit("Done")).otherwise(F.lit("To Do")))
    tr = li.select(F.col("l_orderkey").alias("ticket_key"), F.col("l_linenumber").alias("pos"),
                   F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
                   .alias("id"), name.alias("name"))
    return RU.match_transitions(wanted, tr)


def q_test_summary(spark, d):
    s = RU.summarize_test_run(test_runs(spark, d))
    return s.select("doc_id", "passed", "summary", "reason_code")


def _routed(spark, d):
    ev = RU.retry_counts(run_events(spark, d), "thread_id", "event_id")
    return ev.withColumn("route", RU.route_after_test(F.col("passed"), F.col("retry_count")))


def q_retry_routing(spark, d):
    r = _routed(spark, d)
    return r.select(F.col("event_id").alias("seq"), "thread_id",
                    F.col("retry_count").cast("bigint").alias("retry_count"), "passed", "route")


DECISIONS = ["retry", "approve", "abandon", "maybe", None]


def _decision() -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in DECISIONS]), (F.col("event_id") % 5 + 1).cast("int"))


def q_decision_routing(spark, d):
    r = _routed(spark, d).where(F.col("route") == "escalate")
    return r.select(F.col("event_id").alias("seq"), _decision().alias("decision"),
                    RU.route_after_decision(_decision()).alias("next_route"))


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def q_gates(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type", "props")
    intended = F.col("event_type") != "view"
    applied = _k() % 3 != 0
    build_ok = F.when(F.col("event_type") == "signup", F.lit(None).cast("boolean")).otherwise(_k() % 2 == 0)
    return ev.select("event_id", RU.build_gate(intended, applied).alias("build_gate"),
                     RU.deploy_gate(build_ok).alias("deploy_gate"))


def q_escalations(spark, d):
    r = _routed(spark, d).select(
        "event_id", F.concat(F.lit("U-"), F.col("user_id").cast("string")).alias("ticket_key"), "retry_count",
        F.when(F.col("event_type") == "click", F.lit(None).cast("string")).otherwise(F.col("props")).alias("summary"),
        "route")
    e = RU.escalation_report(r)
    return e.select(F.col("event_id").alias("seq"), "reason", "ticket",
                    F.col("retry_count").cast("bigint").alias("retry_count"), "test_summary", "message")


STATE_KEYS = ["signup", "error", "click", "view", "purchase"]


def q_latest_state(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    s = RU.latest_state(ev, STATE_KEYS, thread="user_id", seq="event_id", key="event_type", value="value")
    return s.select(F.col("user_id").alias("thread_id"), *[r6(F.col(k)).alias(k) for k in STATE_KEYS])


NODE_OF = {"signup": "pm", "view": "dev", "click": "test", "error": "escalate", "purchase": "deploy"}


def q_incomplete_runs(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    ev = running(ev, "user_id", ["event_id"], bucket_of(F.col("event_id")), {"clicks_before": F.when(F.col("event_type") == "click", 1).otherwise(0)})
    clicks_before = F.col("clicks_before")
    node = _lookup(NODE_OF, "event_type")
    route = (F.when(node == "test", RU.route_after_test(F.col("value") > 25, clicks_before))
              .when(node == "escalate", RU.route_after_decision(_decision())))
    e = ev.select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"),
                  node.alias("node"), route.alias("route"))
    return RU.incomplete_runs(spark, e)


def q_audit_comments(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    per = li.groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"),
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))).alias("mod"),
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber")))).alias("rej"))
    j = o.join(per, o["o_orderkey"] == per["l_orderkey"], "left")
    ticket = F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string"))
    modified = F.transform(F.coalesce("mod", F.array().cast("array<int>")),
                           lambda n: F.concat(F.lit("line_"), n.cast("string"), F.lit(".py")))
    rejected = F.transform(F.coalesce("rej", F.array().cast("array<int>")),
                           lambda n: F.format_string("  - line_%d.py (f%d): invalid syntax at line %d", n, n, n))
    analysis = F.when(F.col("o_orderstatus") == "F", F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("Order status "), F.col("o_orderstatus")))
    commit = F.when(F.size(modified) > 0, F.concat(F.lit("https://git.example/commit/"),
                                                   F.col("o_orderkey").cast("string")))
    retry = (F.col("o_orderkey") % 4).cast("int")
    summ = F.concat(F.coalesce(F.col("n_lines"), F.lit(0)).cast("string"), F.lit(" passed"))
    key = F.col("o_orderkey")
    image = F.concat(F.lit("app:"), key.cast("string"))
    gate = RU.build_gate((F.size(modified) > 0) | (F.size(rejected) > 0), F.size(modified) > 0)
    built = (gate == "PROCEED") & (key % 3 != 0)
    output = F.when(key % 2 == 0, F.concat(F.lit("log "), F.expr("repeat(cast(o_orderkey AS string), 200)")))
    # all stages from one pass over the per-order aggregate
    stages = F.array(*[F.struct(F.lit(name).alias("stage"), text.alias("comment")) for name, text in (
        ("dev", RU.dev_comment(ticket, retry, analysis, modified, commit, rejected)),
        ("test", RU.test_comment(ticket, F.col("o_orderstatus") == "F", summ, key % 5 == 0, F.when(key % 2 == 0, F.lit("covered")))),
        ("build", RU.build_comment(ticket, gate, built, F.when(key % 7 > 0, F.lit("BUILD_FAILED")), image, commit, output)),
        ("deploy", RU.deploy_comment(ticket, RU.deploy_gate(built), image, F.concat(F.lit("pod-"), key.cast("string")),
                                     F.when(key % 4 > 0, 30000 + key % 100), F.lit("open app"))))])
    stages = F.filter(stages, lambda x: x["comment"].isNotNull())
    return j.select(ticket.alias("ticket"), F.explode(stages).alias("s")).select("ticket", "s.stage", "s.comment")


QUERIES.update({
    "ticket_normalise": q_ticket_normalise,
    "status_match": q_status_match,
    "test_summary": q_test_summary,
    "retry_routing": q_retry_routing,
    "decision_routing": q_decision_routing,
    "gates": q_gates,
    "escalations": q_escalations,
    "latest_state": q_latest_state,
    "incomplete_runs": q_incomplete_runs,
    "audit_comments": q_audit_comments,
})


# ------------------------------------------------------------ dependency audit
from corpusweave.operators import deps as D  # noqa: E402
from corpusweave.plans.fixtures import REPO, change_plans, repositories, requirement_lines  # noqa: E402


def q_third_party(spark, d):
    src = code_corpus(spark, d)
    mods = X.import_modules(X.extract(src, partitions=_parallel(spark))).withColumn("repo", F.lit(REPO))
    return D.third_party(spark, src.select("repo", "path"), mods)


def q_requirements_diff(spark, d):
    src = code_corpus(spark, d)
    mods = X.import_modules(X.extract(src, partitions=_parallel(spark))).withColumn("repo", F.lit(REPO))
    scanned = D.third_party(spark, src.select("repo", "path"), mods)
    res = D.missing_packages(scanned, requirement_lines(spark, d), src.select("repo"))
    return res.where("package IS NOT NULL").select("repo", "reason_code", "package")


def q_requirements_clean(spark, d):
    src = code_corpus(spark, d)
    lines = requirement_lines(spark, d)
    cl = D.clean_requirements(lines, src.select("repo", "path"))
    none = src.select("repo", F.lit("").alias("package")).limit(0)  # the file exists: no scan is asked for
    st = D.clean_status(cl, none, lines, src.select("repo"))
    return cl.join(st.select("repo", "reason_code").distinct(), "repo").select(
        "repo", F.col("pos").cast("bigint").alias("pos"), "line", "kept", "reason_code")


def q_requirements_repos(spark, d):
    """D4 (part ``add``) and D5 (part ``clean``) over many repositories, one with every part: all statuses, entries ranked."""
    sources, scanned, files, lines = repositories(spark, d)
    repos = sources.select("repo")
    add = D.missing_packages(scanned, lines, repos, files).select("repo", F.lit("add").alias("part"), "reason_code", "rank", F.col("package").alias("entry"))
    clean = D.clean_status(D.clean_requirements(lines, sources), scanned, lines, repos, files)
    both = add.union(clean.select("repo", F.lit("clean"), "reason_code", "rank", "entry"))
    return both.select("repo", "part", "reason_code", F.coalesce("rank", F.lit(0).cast("long")).alias("rank"), F.coalesce("entry", F.lit("")).alias("entry"))


QUERIES.update({
    "requirements_repos": q_requirements_repos,
    "third_party": q_third_party,
    "requirements_diff": q_requirements_diff,
    "requirements_clean": q_requirements_clean,
})


# ------------------------------------------------------------ proposed edits
PATCH_STAMP = "2024-01-01T00:00:00"


def _patches(spark, d):
    parsed = L.parse_replies(change_plans(spark, d))
    flat = L.flatten_plans(parsed, "../corpus")
    src = code_corpus(spark, d).select("path", "content")
    return parsed, L.evaluate_edits(flat, src, stamp=PATCH_STAMP)


def q_patch_eval(spark, d):
    _, ev = _patches(spark, d)
    return ev.select(F.col("plan_id").cast("bigint").alias("plan_id"),
                     F.col("file_pos").cast("bigint").alias("file_pos"), "path",
                     F.col("change_pos").cast("string").alias("change_pos"), "edit_status", "reason",
                     "file_status", F.col("applied_count").cast("bigint").alias("applied_count"),
                     F.md5("new_content").alias("content_md5"))


def q_change_flags(spark, d):
    parsed, ev = _patches(spark, d)
    fl = L.change_flags(parsed, ev)
    return fl.select(F.col("plan_id").cast("bigint").alias("plan_id"), "had_intended_changes",
                     "code_changes_applied", F.size("rejected").cast("bigint").alias("n_rejected"))


QUERIES.update({
    "patch_eval": q_patch_eval,
    "change_flags": q_change_flags,
})


# ------------------------------------------------------------ prompt assembly
from corpusweave.operators import prompts as P  # noqa: E402


def conversation_hits(spark, d):
    """Conversations as retrieval hits: conv = query, turn + 1 = rank."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    role = F.col("role")
    return c.select(
        F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"),
        F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit("."), role, F.lit("_"),
                 F.col("turn").cast("string")).alias("symbol_id"),
        F.format_string("conv/%d.py", "conv_id").alias("path"),
        (F.col("turn") * 10).alias("start_line"), (F.col("turn") * 10 + 9).alias("end_line"),
        F.when(role == "user", F.lit("semantic")).otherwise(F.lit("graph")).alias("source"),
        F.when(role == "user", F.lit(1.0)).when(role == "assistant", F.lit(0.8)).otherwise(F.lit(0.6)).alias("score"),
        F.col("text").alias("content"))


def q_prompt_render(spark, d):
    hits = conversation_hits(spark, d)
    chunks = P.render_chunks(hits)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "symbol_id")))
    seeds = F.sort_array(F.collect_list(F.when(F.col("source") == "semantic", F.struct("rank", "symbol_id"))))
    summ = hits.groupBy("query_id").agg(
        F.transform(seeds, lambda x: x["symbol_id"]).alias("seed_symbols"),
        F.transform(ordered, lambda x: x["symbol_id"]).alias("expanded_symbols"),
        F.array().cast("array<string>").alias("dependencies"),
        F.array().cast("array<string>").alias("dependents"))
    conv = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "text")
    # the retry section shows only the last 3000 chars of the run's output
    tails = P.tail_of_concat(conv, "query_id", "turn", "text")
    per = conv.groupBy("query_id").agg(F.min_by("text", "turn").alias("query")).join(tails, "query_id")
    tickets = per.select("query_id", F.concat(F.lit("CONV-"), F.col("query_id").cast("string")).alias("ticket_key"),
                         F.concat(F.lit("https://tracker.example/CONV-"), F.col("query_id").cast("string")).alias("url"),
                         "query")
    fails = per.select("query_id", (F.col("query_id") % 3).cast("int").alias("retry_count"),
                       F.format_string("attempt %d failed", F.col("query_id") % 3).alias("summary"), "full_output")
    return P.assemble(tickets, summ, chunks, None, fails).select("query_id", "ticket_key", "prompt")


QUERIES["prompt_render"] = q_prompt_render


# ------------------------------------------------------------ streaming
import uuid  # noqa: E402

from corpusweave.session import scratch_path  # noqa: E402
from corpusweave.streaming import refresh as W1  # noqa: E402
from corpusweave.streaming import routing as W2  # noqa: E402


def _run_available_now(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def corpus_changes(spark, d):
    """Two change batches over the templated corpus: every file, then an edit
    of the files with k % 5 = 1 and a deletion of those with k % 10 = 4."""
    src = code_corpus(spark, d)
    k = F.regexp_extract("path", r"s_(\d+)", 1).cast("bigint")
    b0 = src.select(k.alias("seq"), "path", "modificationTime", "length", "content", F.lit("upsert").alias("op"))
    text = F.decode("content", "UTF-8")
    edited = F.replace(text, F.lit("import os\n"), F.lit("import os\nimport sys\n"))
    b1_edit = src.where(k % 5 == 1).select(
        (k + 1000000).alias("seq"), "path", (F.col("modificationTime") + F.expr("INTERVAL 1 DAY")).alias("modificationTime"),
        F.octet_length(edited).cast("bigint").alias("length"), F.encode(edited, "UTF-8").alias("content"),
        F.lit("upsert").alias("op"))
    b1_del = src.where(k % 10 == 4).select(
        (k + 2000000).alias("seq"), "path", "modificationTime", F.lit(None).cast("bigint").alias("length"),
        F.lit(None).cast("binary").alias("content"), F.lit("delete").alias("op"))
    return [b0, b1_edit.unionByName(b1_del)]


def q_stream_refresh(spark, d):
    """The second batch holds a late row for each path of the first; then the stream restarts with a new checkpoint
    (batch ids from 0 again) and sees everything once more."""
    base = scratch_path(spark, f"stream-refresh-{uuid.uuid4().hex}")
    idx = f"{base}/index"
    first, second = corpus_changes(spark, d)
    late = first.select((F.col("seq") - 1).alias("seq"), "path", "modificationTime", F.lit(1).cast("bigint").alias("length"),
                        F.encode(F.lit("\n"), "UTF-8").alias("content"), "op")
    for i, (batch, ck) in enumerate([(first, "a"), (second.unionByName(late), "a"), (None, "b")]):
        if batch is not None:
            batch.write.parquet(f"{base}/changes/b{i}")
        ck = f"{base}/checkpoint-{ck}"
        reader = spark.readStream.schema(C.CHANGE_SCHEMA).parquet(f"{base}/changes/*")
        _run_available_now(reader.writeStream.option("checkpointLocation", ck)
                           .foreachBatch(lambda df, bid, ck=ck: W1.apply_batch(spark, idx, df, bid, ck)))
    index = W1.load_index(spark, idx)
    nch = index["chunks"].groupBy("path").agg(F.count("*").alias("n_chunks"))
    nim = index["imports"].groupBy("path").agg(F.count("*").alias("n_imports"))
    edge = F.concat("caller", F.lit(" > "), "dst", F.when(F.col("resolved"), "").otherwise(" ?"))
    edges = index["resolved_calls"].groupBy("path").agg(F.array_join(F.sort_array(F.collect_set(edge)), "\n").alias("edges"))
    return (index["manifest"].join(nch, "path", "left").join(nim, "path", "left").join(edges, "path", "left")
               .select("path", "size", "hash", "n_chunks", "n_imports", "edges"))


def q_stream_routing(spark, d):
    """Four triggers; within each, the events arrive in no order and over several Arrow batches."""
    ev = table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", (F.col("event_type") == "purchase").alias("passed"))
    out = _route_in_triggers(spark, ev, lambda df: W2.events_of(df, "user_id"))
    return out.select("seq", F.format_string("U%s-%d", "key", "run_no").alias("thread_id"), "retry_count", "passed", "route")


def _route_in_triggers(spark, events, columns, triggers: int = 4, **options):
    """``events`` through the routing stream, cut by seq into as many triggers."""
    base = scratch_path(spark, f"stream-routing-{uuid.uuid4().hex}")
    top = events.agg(F.max("seq")).first()[0] or 0
    chunk = (F.col("seq") * triggers / (top + 1)).cast("int")
    for i in range(triggers):
        events.where(chunk == i).orderBy(F.xxhash64("seq")).write.parquet(f"{base}/events/c{i}")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/events/*")
        _run_available_now(W2.start(spark, columns(stream), f"{base}/out", f"{base}/ck", **options))
    return W2.routed(spark, f"{base}/out")


def q_stream_decisions(spark, d):
    """T4-T6 on the stream: signups answer escalations (by event_id % 5), all other events are tests, with a time to live."""
    import datetime as dt
    ev = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), "user_id", "ts", (F.col("event_type") == "purchase").alias("passed"),
        F.when(F.col("event_type") == "signup", _decision()).alias("decision"), (F.col("event_type") == "signup").alias("answer"))
    out = _route_in_triggers(spark, ev, lambda df: W2.events_of(df, "user_id", "seq", "passed", "ts", "decision", "answer"),
                             ttl=dt.timedelta(days=3650), delay=dt.timedelta(hours=1))
    return out.select("seq", F.col("key").cast("bigint").alias("user_id"), "run_no", "retry_count", "passed", "decision", "route", "status")


QUERIES.update({
    "stream_refresh": q_stream_refresh,
    "stream_routing": q_stream_routing,
    "stream_decisions": q_stream_decisions,
})


# ------------------------------------------------------------ end to end
def q_code_search(spark, d):
    """Index the corpus, embed chunks (V1) and one query per supplier (V2),
    hybrid-retrieve (V3, G10, G11, S5, R1), summarise (R2, G12), fetch full
    files (S6) and assemble the prompt (P1, P2).  Rows-only check."""
    src = code_corpus(spark, d)
    # index job: extract once, write the index tables, read them back
    base = scratch_path(spark, f"code-index-{uuid.uuid4().hex}")
    idx = C.build_index(materialize(X.extract(src, partitions=_parallel(spark))))
    g = C.derive_graph(idx["chunks"], idx["raw_calls"])
    vec = vectors.embed_texts(idx["chunks"].select("chunk_id", "content"), "content").select("chunk_id", "embedding")
    S.write_tables(spark, base, {"chunks": idx["chunks"], "imports": idx["imports"], "symbols": g["symbols"],
                                 "edges": g["edges"], "vectors": vec})
    C.release(g)
    chunks, vecs = S.read_table(spark, base, "chunks"), S.read_table(spark, base, "vectors")
    g = {"symbols": S.read_table(spark, base, "symbols"), "edges": S.read_table(spark, base, "edges")}
    idx = {"imports": S.read_table(spark, base, "imports")}
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"))
    qtext = F.format_string("where is run_%d called from S%d", F.col("query_id") + 1, F.col("query_id"))
    qs = vectors.embed_texts(sup.select("query_id", qtext.alias("query")), "query")
    hits, expanded = R.hybrid_retrieve_parts(qs.select("query_id", "embedding"), vecs,
                                             chunks.select("chunk_id", "symbol_id"), g["symbols"], g["edges"])
    # per-query results (at most queries x (k + budget) rows) feed several
    # branches below: compute them once
    hits, expanded = materialize(hits), materialize(expanded)
    meta = hits.join(spread(chunks.select("chunk_id", "path", "start_line", "end_line", "content")), "chunk_id")
    hit_files = materialize(meta.select("query_id", "path").distinct())
    related = materialize(G.related_files(idx["imports"], hit_files))
    summary = R.retrieval_summary(hits, expanded, related, chunks)
    files = P.render_full_files(P.gather_full_files(hit_files, src.select("path", "content")))
    tickets = qs.select("query_id", F.concat(F.lit("S-"), F.col("query_id").cast("string")).alias("ticket_key"),
                        F.lit("").alias("url"), "query")
    prompts = P.assemble(tickets, summary, P.render_chunks(meta), files)
    return summary.join(spread(prompts.select("query_id", "prompt")), "query_id", "left").select(
        "query_id", "seed_symbols", "expanded_symbols", "symbol_scores", "dependencies", "dependents",
        "related_files", F.size("chunks").alias("n_chunks"), "chunks", "prompt")


QUERIES["code_search"] = q_code_search


# ------------------------------------------------------------ embeddings, summaries, symbol fetch
def q_embed_texts(spark, d):
    """V1 over every whole document (as chunks), V2 over every benchmark item (as queries): the non-zero places of each vector."""
    texts = table(spark, d, "documents").select(F.concat(F.lit("chunk "), F.col("doc_id").cast("string")).alias("text_id"), "text")
    items = table(spark, d, "benchmark").select(F.concat(F.lit("query "), F.col("item_id").cast("string")).alias("text_id"), "text")
    vecs = vectors.embed_native(texts.unionByName(items), "text_id", "text")
    return (vecs.select("text_id", F.posexplode("embedding").alias("place", "value")).where("value != 0")
                .select("text_id", F.col("place").cast("bigint").alias("place"), r6(F.col("value").cast("double")).alias("value")))


def q_retrieval_summary(spark, d):
    """R2 in long form for every vector as a query: its hits lie in corpus files (vector id modulo the number of files)."""
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    ids = emb.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("symbol_id"))
    hits, expanded = R.hybrid_retrieve_parts(emb.withColumnRenamed("vec_id", "query_id"),
                                             emb.withColumnRenamed("vec_id", "chunk_id"), ids, ids, vector_edges(emb))
    hits, expanded = materialize(hits), materialize(expanded)
    n = table(spark, d, "supplier").count()
    files = hits.where("rank = 1").select("query_id", F.format_string("svc/s_%d.py", F.col("chunk_id") % n).alias("path"))
    out = R.summary_items(hits, expanded, G.related_files(X.imports(_corpus_x(spark, d)), files))
    return out.withColumn("score", r6(F.col("score")))


def q_symbol_fetch(spark, d):
    """The symbols of every name that a call of the corpus uses, and their chunks by id."""
    x = materialize(_corpus_x(spark, d))
    c = X.chunks(x)
    names = X.raw_calls(x).select(F.substring_index("raw_call", ".", -1).alias("name")).distinct()
    found = G.find_symbol(G.symbol_table(c), names)
    return S.fetch_ids(c.select("chunk_id", "content"), found.select("symbol_id", "short_name", "chunk_id"))


QUERIES.update({
    "embed_texts": q_embed_texts,
    "retrieval_summary": q_retrieval_summary,
    "symbol_fetch": q_symbol_fetch,
})
