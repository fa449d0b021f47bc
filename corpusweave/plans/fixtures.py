"""Inputs derived by Spark from the driver tables (see FIXTURES.md §3-§6).

Each derivation is a projection of a whole table, so it grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.sources.tables import table

# Templated source file, one per supplier (fixed text; %1$s LIB, %2$d p,
# %3$d k, %4$s the method name).
CODE_TEMPLATE = (
    "import os\n"
    "%1$s\n"
    "from svc.s_%2$d import run_%2$d\n"
    "\n"
    "\n"
    "class S%3$d:\n"
    "    def %4$s(self):\n"
    "        return run_%2$d(self)\n"
    "\n"
    "    @property\n"
    "    def size(self):\n"
    "        return len(str(self))\n"
    "\n"
    "\n"
    "def run_%3$d(x):\n"
    "    return S%3$d().go()\n"
    "\n"
    "\n"
    'if __name__ == "__main__":\n'
    "    run_%3$d(os.getpid())\n"
)
REPO = "corpus"


def code_corpus(spark: SparkSession, d: str) -> DataFrame:
    """sources(repo, path, modificationTime, length, content) of the templated corpus."""
    sup = table(spark, d, "supplier").select("s_suppkey")
    n = sup.count()
    k = F.col("s_suppkey")
    p = F.when(k == 0, F.lit(n - 1)).otherwise(k - 1)
    lib = (F.when(k % 3 == 0, F.lit("import yaml"))
            .when(k % 3 == 1, F.lit("from flask import Flask"))
            .otherwise(F.lit("import requests")))
    go = F.when(k.isin(3, 8), F.lit("went")).otherwise(F.lit("go"))
    text = F.format_string(CODE_TEMPLATE, lib, p, k, go)
    return sup.select(
        F.lit(REPO).alias("repo"),
        F.format_string("svc/s_%d.py", k).alias("path"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=k.cast("int"))).alias("modificationTime"),
        F.octet_length(text).cast("bigint").alias("length"),
        F.encode(text, "UTF-8").alias("content"))


#: Files that do not parse as a whole, one per ``part`` by p_partkey % 4 (fixed text; %1$d key). Shapes: statements of an older
#: language version between good ones; a byte order mark and CR LF line ends; a bracket that never closes before decorated and
#: nested definitions; a text in quotes that looks like code, and a block that goes on with ``else``.
BROKEN_TEMPLATES = (
    'import os\nprint "old %1$d"\ndef a%1$d():\n    return os.getpid()\nprint "more"\nY = f(%1$d)\n',
    '\ufeffimport os\r\ndef b%1$d(x):\r\n    return g(x)\r\nprint "crlf"\r\n',
    'x = (1,\ndef c%1$d():\n    return h("(")\n@deco\nasync def d%1$d():\n    pass\nclass E%1$d:\n    def m(self):\n        return self.n()\n',
    'DOC = """\ndef not_code():\n"""\nif DOC:\n    i%1$d()\nelse:\n    j()\nexec "old"\n',
)


def broken_corpus(spark: SparkSession, d: str) -> DataFrame:
    """sources(path, content): one file that does not parse for every part."""
    k = F.col("p_partkey")
    shapes = [F.format_string(t, k) for t in BROKEN_TEMPLATES]
    text = F.element_at(F.array(*shapes), (k % 4 + 1).cast("int"))
    return table(spark, d, "part").select(F.format_string("old/p_%d.py", k).alias("path"), F.encode(text, "UTF-8").alias("content"))


HREF_RE = 'href="([^"]*)"'


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """(url, href) for every link of every page (duplicates kept)."""
    p = table(spark, d, "pages").select("url", "html")
    return p.select("url", F.explode(F.expr(f"regexp_extract_all(html, '{HREF_RE}', 1)")).alias("href"))


def page_edges(spark: SparkSession, d: str) -> DataFrame:
    """Link graph: page url -> href text, distinct."""
    return page_links(spark, d).select(F.col("url").alias("src"), F.col("href").alias("dst")).distinct()


def vector_edges(emb: DataFrame) -> DataFrame:
    """Two synthetic call edges per vector: id -> (7 id + 3) % n, (13 id + 5) % n."""
    n = emb.count()
    v = F.col("vec_id")
    return (emb.select(v.alias("src"), ((v * 7 + 3) % n).alias("dst"))
               .union(emb.select(v.alias("src"), ((v * 13 + 5) % n).alias("dst"))).distinct())


def doc_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot of documents as files: path doc/{id}, size n_chars,
    mtime 2024-01-01 + id seconds, content = text."""
    doc = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    return doc.select(
        "doc_id", F.format_string("doc/%d", "doc_id").alias("path"),
        F.col("n_chars").alias("length"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("doc_id").cast("int")))
        .alias("modificationTime"),
        F.encode("text", "UTF-8").alias("content"), "text")


def doc_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifest by doc_id % 5 (FIXTURES §4): 0 absent, 1 size+1 and other
    hash, 2 mtime - 1 s, 3 other hash only, 4 identical; plus a copy of
    doc_id % 10 = 4 under doc/{id + 1000000} that no longer exists."""
    s = doc_snapshot(spark, d)
    r = F.col("doc_id") % 5
    x = F.md5(F.lit("x"))
    base = s.where(r != 0).select(
        "path",
        F.when(r == 1, F.col("length") + 1).otherwise(F.col("length")).alias("size"),
        F.when(r == 2, F.col("modificationTime") - F.expr("INTERVAL 1 SECOND"))
         .otherwise(F.col("modificationTime")).alias("mtime"),
        F.when(r.isin(1, 3), x).otherwise(F.md5("text")).alias("hash"))
    gone = s.where(F.col("doc_id") % 10 == 4).select(
        F.format_string("doc/%d", F.col("doc_id") + 1000000).alias("path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.md5("text").alias("hash"))
    return base.union(gone)


# ------------------------------------------------------------ derived run tables
ERROR_TEMPLATES = ["429 RESOURCE_EXHAUSTED", "Daily Quota hit", "503 busy", "read Timeout",
                   "401 bad key", "quota 503"]


def api_errors(spark: SparkSession, d: str) -> DataFrame:
    """errors(event_id, call_id, attempt, error_class, message) from events."""
    ev = table(spark, d, "events").select("event_id", "event_type", "props")
    tmpl = F.element_at(F.array(*[F.lit(t) for t in ERROR_TEMPLATES]), (F.col("event_id") % 6 + 1).cast("int"))
    msg = F.concat(tmpl, F.lit(" "), F.expr("repeat(event_type, 1 + cast(event_id % 40 as int))"),
                   F.lit("\ndetail "), F.col("props"))
    cls = (F.when(F.col("event_type") == "error", F.lit("ServerError"))
            .when(F.col("event_type") == "click", F.lit("ClientError")))
    return ev.select("event_id", (F.col("event_id") / 3).cast("bigint").alias("call_id"),
                     (F.col("event_id") % 3).cast("int").alias("attempt"), cls.alias("error_class"),
                     msg.alias("message"))


def model_replies(spark: SparkSession, d: str) -> DataFrame:
    """replies(plan_id, raw_text): fenced / plain / padded / cut JSON by event_id % 4."""
    ev = table(spark, d, "events").select("event_id", "props")
    r = F.col("event_id") % 4
    raw = (F.when(r == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
            .when(r == 1, F.col("props"))
            .when(r == 2, F.concat(F.lit("\n\n"), F.col("props"), F.lit("\n")))
            .otherwise(F.expr("substring(props, 1, length(props) - 1)")))
    return ev.select(F.col("event_id").alias("plan_id"), raw.alias("raw_text"))


def test_runs(spark: SparkSession, d: str) -> DataFrame:
    """runs(doc_id, returncode, output): document text with words swapped in."""
    doc = table(spark, d, "documents").select("doc_id", "text")
    out = F.replace(F.replace(F.replace("text", F.lit(" de "), F.lit(" passed ")),
                              F.lit(" the "), F.lit(" failed ")), F.lit(" la "), F.lit(" ERROR "))
    return doc.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("returncode"), out.alias("output"))


def run_events(spark: SparkSession, d: str) -> DataFrame:
    """events as test results: a run ends at each purchase (= passed); thread
    = user and run number (earlier purchases of the user)."""
    from corpusweave.operators.segments import bucket_of, running
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")
    ev = running(ev, "user_id", ["event_id"], bucket_of(F.col("event_id")), {"run_no": F.when(F.col("event_type") == "purchase", 1).otherwise(0)})
    return ev.withColumns({
        "run_no": F.col("run_no").cast("bigint"), "passed": F.col("event_type") == "purchase",
        "thread_id": F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("-"), F.col("run_no").cast("string"))})


def requirement_lines(spark: SparkSession, d: str) -> DataFrame:
    """requirement lines(repo, pos, line) by p_partkey % 5: pinned, lower
    bound (mixed case), upper bound, comment, blank; plus a local module
    line ``svc`` and ``Flask`` (listed in another case)."""
    part = table(spark, d, "part").select("p_partkey")
    k = F.col("p_partkey")
    r = k % 5
    line = (F.when(r == 0, F.format_string("pkg%d==1.0", k))
             .when(r == 1, F.format_string("Pkg%d>=2", k))
             .when(r == 2, F.format_string("pkg%d<=3", k))
             .when(r == 3, F.format_string("# pkg%d", k))
             .otherwise(F.lit("")))
    body = part.select(F.lit(REPO).alias("repo"), k.alias("pos"), line.alias("line"))
    extra = part.agg(F.max("p_partkey").alias("m")).select(
        F.lit(REPO).alias("repo"), F.explode(F.array(
            F.struct((F.col("m") + 1).alias("pos"), F.lit("svc").alias("line")),
            F.struct((F.col("m") + 2).alias("pos"), F.lit("Flask").alias("line")))).alias("x")
    ).select("repo", "x.pos", "x.line")
    return body.unionByName(extra)


def repositories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sources, scanned, files, lines) of one repository per supplier and one that holds every part.

    By s_suppkey % 5 a repository has no requirement file (0), an empty one (1), one that lists all in other cases and with
    bounds (2), one that lacks packages (3), or one that lists a local module (4). Repository ``hot`` uses a package per
    part and lists the even ones."""
    sup, part = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), table(spark, d, "part").select(F.col("p_partkey").alias("p"))
    repo, k, hot = F.format_string("repo_%d", F.col("k")), F.col("k"), F.lit("hot")
    own = F.format_string("pkg%d", k)
    even = F.when(k % 2 == 0, F.lit("requests"))
    sources = sup.select(repo.alias("repo"), F.lit("svc/a.py").alias("path")).union(part.select(hot, F.format_string("svc/p_%d.py", "p")))
    scanned = sup.select(repo.alias("repo"), F.explode(F.array(F.lit("Flask"), own, even)).alias("package")).where("package IS NOT NULL")
    scanned = scanned.union(part.select(hot, F.format_string("pkg%d", "p")))
    text = (F.when(k % 5 == 2, F.array(F.lit("FLASK==1"), F.format_string("Pkg%d>=2", k), F.lit("requests<=3")))
            .when(k % 5 == 3, F.array(F.lit("flask"), F.format_string("# pkg%d", k), F.lit("")))
            .when(k % 5 == 4, F.array(F.lit("svc==1"), F.lit("Flask"), own, F.lit("requests"))))
    lines = sup.select(repo.alias("repo"), F.posexplode(text).alias("pos", "line")).select("repo", F.col("pos").cast("long").alias("pos"), "line")
    lines = lines.union(part.where("p % 2 = 0").select(hot, "p", F.format_string("pkg%d==1.0", "p")))
    files = sup.where(k % 5 != 0).select(repo.alias("repo")).union(spark.range(1).select(hot))
    return sources, scanned, files, lines


def coverage_replies(spark: SparkSession, d: str) -> DataFrame:
    """replies(plan_id, raw_text, api_failed) by event_id % 8: fenced, plain, text after the value, single quotes, cut, fields
    missing, call failed, null."""
    ev = table(spark, d, "events").select("event_id", "event_type")
    r = F.col("event_id") % 8
    body = F.concat(F.lit('{"needs_new_tests": true, "reasoning": "'), F.col("event_type"), F.lit('", "new_test_code": "def test_'),
                    F.col("event_id").cast("string"), F.lit('(): pass"}'))
    raw = (F.when(r == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(r == 2, F.concat(body, F.lit(" that is all")))
            .when(r == 3, F.translate(body, '"', "'")).when(r == 4, F.expr("'{\"needs_new_tests\": tr'"))
            .when(r == 5, F.lit('{"needs_new_tests": true}')).when(r == 7, F.lit(None).cast("string")).otherwise(body))
    return ev.select(F.col("event_id").alias("plan_id"), raw.alias("raw_text"), (r == 6).alias("api_failed"))


def change_plans(spark: SparkSession, d: str) -> DataFrame:
    """replies(plan_id, raw_text): one proposed change plan per corpus file
    (FIXTURES §5), serialised as JSON, fenced for even ids."""
    sup = table(spark, d, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    r5, r4 = k % 5, k % 4
    path = (F.when(r4 == 0, F.format_string("../corpus/svc/s_%d.py", k))
             .when(r4 == 1, F.format_string("corpus/svc/s_%d.py", k))
             .when(r4 == 2, F.format_string("/svc/s_%d.py", k))
             .otherwise(F.format_string("svc/s_%d.py", k)))

    def ch(fn, orig, mod):
        return F.struct(F.lit(fn).alias("function_name") if isinstance(fn, str) else fn.alias("function_name"),
                        F.lit(orig).alias("original_code"), F.lit(mod).alias("modified_code"),
                        F.lit("requested").alias("reason"))

    changes = (F.when(r5 == 0, F.array(ch("size", "len(str(self))", "1  # {TIMESTAMP}")))
                .when(r5 == 1, F.array(ch("go", "no such text", "x")))
                .when(r5 == 2, F.array(ch(F.format_string("run_%d", k), "return S", "return return S")))
                .when(r5 == 3, F.array(ch("all", "(self)", "(me)"), ch("size", "len(str(me))", "1"))))
    main = F.when(r5 != 4, F.array(F.struct(path.alias("file_path"), changes.alias("changes"))))
    extra = F.when(k % 7 == 0, F.array(
        F.struct(F.lit("../corpus2/svc/s_0.py").alias("file_path"), F.array(ch("x", "import os", "import sys"))
                 .alias("changes")),
        F.struct(F.lit("svc/missing.py").alias("file_path"), F.array(ch("x", "import os", "import sys"))
                 .alias("changes"))))
    files = F.concat(F.coalesce(main, F.array().cast(
        "array<struct<file_path:string,changes:array<struct<function_name:string,original_code:string,"
        "modified_code:string,reason:string>>>>")), F.coalesce(extra, F.array().cast(
        "array<struct<file_path:string,changes:array<struct<function_name:string,original_code:string,"
        "modified_code:string,reason:string>>>>")))
    plan = F.struct(F.format_string("plan %d", k).alias("analysis"), files.alias("files_to_modify"),
                    F.format_string("fix(S-%d): edit", k).alias("commit_message"),
                    F.array().cast("array<string>").alias("files_not_to_modify"))
    js = F.to_json(plan)
    raw = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(js)
    return sup.select(k.alias("plan_id"), raw.alias("raw_text"))
