"""DuckDB SQL equal in meaning to each registered query (driver oracle)."""

SEMANTIC_TOPK = """
WITH s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
         1.0 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]),
                                      CAST(c.embedding AS DOUBLE[])) AS d
  FROM embeddings q, embeddings c)
SELECT query_id, rank, chunk_id, ROUND(d, 6) + 0.0 AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM s)
WHERE rank <= 10
"""

ORACLE = {
    "semantic_topk": SEMANTIC_TOPK,
}


# ------------------------------------------------------------ templated corpus
def _sql_concat(text: str) -> str:
    """Template text -> DuckDB concatenation with placeholders as columns."""
    import re
    parts = []
    for piece in re.split(r"(\{LIB\}|\{P\}|\{K\}|\{GO\}|\n)", text):
        if piece == "":
            continue
        if piece == "\n":
            parts.append("chr(10)")
        elif piece in ("{LIB}", "{P}", "{K}", "{GO}"):
            parts.append({"{LIB}": "lib", "{P}": "CAST(p AS VARCHAR)",
                          "{K}": "CAST(k AS VARCHAR)", "{GO}": "go"}[piece])
        else:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)


_LINES = [
    "import os", "{LIB}", "from svc.s_{P} import run_{P}", "", "",
    "class S{K}:", "    def {GO}(self):", "        return run_{P}(self)", "",
    "    @property", "    def size(self):", "        return len(str(self))", "", "",
    "def run_{K}(x):", "    return S{K}().go()", "", "",
    'if __name__ == "__main__":', "    run_{K}(os.getpid())",
]


def _span(a: int, b: int, first_col: int = 0) -> str:
    lines = _LINES[a:b + 1]
    lines = [lines[0][first_col:]] + lines[1:]
    return _sql_concat("\n".join(lines))


CORPUS_CTE = f"""
corpus AS (
  SELECT s_suppkey AS k,
         CASE WHEN s_suppkey = 0 THEN (SELECT count(*) FROM supplier) - 1 ELSE s_suppkey - 1 END AS p,
         CASE s_suppkey % 3 WHEN 0 THEN 'import yaml' WHEN 1 THEN 'from flask import Flask'
              ELSE 'import requests' END AS lib,
         CASE WHEN s_suppkey IN (3, 8) THEN 'went' ELSE 'go' END AS go,
         'svc/s_' || s_suppkey || '.py' AS path,
         'svc.s_' || s_suppkey AS module
  FROM supplier),
chunks AS (
  SELECT md5(path || '::' || qual) AS chunk_id, module || '.' || qual AS symbol_id,
         name AS short_name, class_name, path, chunk_type,
         CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line,
         'python' AS language, content, module
  FROM (
    SELECT path, module, 'S' || k AS name, 'S' || k AS qual, 'S' || k AS class_name,
           'class_definition' AS chunk_type, 5 AS start_line, 11 AS end_line,
           {_span(5, 11)} AS content FROM corpus
    UNION ALL
    SELECT path, module, go, 'S' || k || '.' || go, 'S' || k, 'function_definition', 6, 7,
           {_span(6, 7, 4)} FROM corpus
    UNION ALL
    SELECT path, module, 'run_' || k, 'run_' || k, NULL, 'function_definition', 14, 15,
           {_span(14, 15)} FROM corpus
    UNION ALL
    SELECT path, module, '__module_level__', '__module_level__', NULL, 'module_level', 0, 19,
           {_span(0, 19)} FROM corpus)),
imports AS (
  SELECT path, CAST(0 AS BIGINT) AS pos, 'import os' AS import_text FROM corpus
  UNION ALL SELECT path, 1, lib FROM corpus
  UNION ALL SELECT path, 2, 'from svc.s_' || p || ' import run_' || p FROM corpus),
raw_calls AS (
  SELECT path, module, caller, CAST(pos AS BIGINT) AS pos, raw_call FROM (
    SELECT path, module, module || '.S' || k AS caller, 0 AS pos, 'run_' || p AS raw_call FROM corpus
    UNION ALL SELECT path, module, module || '.S' || k, 1, 'len' FROM corpus
    UNION ALL SELECT path, module, module || '.S' || k, 2, 'str' FROM corpus
    UNION ALL SELECT path, module, module || '.S' || k || '.' || go, 0, 'run_' || p FROM corpus
    UNION ALL SELECT path, module, module || '.run_' || k, 0, 'S' || k || '().go' FROM corpus
    UNION ALL SELECT path, module, module || '.run_' || k, 1, 'S' || k FROM corpus
    UNION ALL SELECT path, module, module || '.__module_level__', 0, 'run_' || p FROM corpus
    UNION ALL SELECT path, module, module || '.__module_level__', 1, 'len' FROM corpus
    UNION ALL SELECT path, module, module || '.__module_level__', 2, 'str' FROM corpus
    UNION ALL SELECT path, module, module || '.__module_level__', 3, 'S' || k || '().go' FROM corpus
    UNION ALL SELECT path, module, module || '.__module_level__', 4, 'S' || k FROM corpus
    UNION ALL SELECT path, module, module || '.__module_level__', 5, 'run_' || k FROM corpus
    UNION ALL SELECT path, module, module || '.__module_level__', 6, 'os.getpid' FROM corpus)),
names AS (SELECT short_name, count(DISTINCT symbol_id) AS n, min(symbol_id) AS first_id
          FROM chunks GROUP BY short_name),
resolved AS (
  SELECT r.path, r.caller, r.pos, r.raw_call,
         CASE WHEN nm.n = 1 THEN nm.first_id
              WHEN pk.picked IS NOT NULL THEN pk.picked ELSE r.raw_call END AS dst,
         (COALESCE(nm.n = 1, false) OR pk.picked IS NOT NULL) AS resolved
  FROM raw_calls r
  LEFT JOIN names nm ON nm.short_name = regexp_extract(r.raw_call, '[^.]*$')
  LEFT JOIN (SELECT r2.raw_call, r2.module, min(c.symbol_id) AS picked
             FROM (SELECT DISTINCT raw_call, module FROM raw_calls) r2
             JOIN chunks c ON c.short_name = regexp_extract(r2.raw_call, '[^.]*$')
                          AND starts_with(c.symbol_id, r2.module)
             GROUP BY r2.raw_call, r2.module) pk
    ON pk.raw_call = r.raw_call AND pk.module = r.module AND nm.n > 1)
"""

ORACLE.update({
    "chunk_extract": f"WITH {CORPUS_CTE} SELECT chunk_id, symbol_id, short_name, class_name, path, "
                     "chunk_type, start_line, end_line, language, content FROM chunks",
    "import_extract": f"WITH {CORPUS_CTE} SELECT path, pos, import_text FROM imports",
    "call_extract": f"WITH {CORPUS_CTE} SELECT path, caller, pos, raw_call FROM raw_calls",
    "symbol_table": f"WITH {CORPUS_CTE} SELECT symbol_id, short_name, path, chunk_id, "
                    "chunk_type AS type, start_line, end_line FROM chunks",
    "call_resolution": f"WITH {CORPUS_CTE} SELECT DISTINCT caller AS src, dst, resolved FROM resolved",
})


def _broken(shape: int, kind: str, name: str, start: int, end: int | None, text: str) -> str:
    """Rows of one kind for all files of a shape; {K} stands for the key."""
    def lit(t: str) -> str:
        parts = [f"'{x}'" for x in t.replace("'", "''").split("{K}")]
        return " || k || ".join(parts).replace("\\r", "' || chr(13) || '").replace("\\n", "' || chr(10) || '")
    return (f"SELECT path, '{kind}' AS kind, {lit(name)} AS name, CAST({start} AS BIGINT) AS start, "
            f"CAST({-1 if end is None else end} AS BIGINT) AS \"end\", {lit(text)} AS text FROM p WHERE k % 4 = {shape}")


ORACLE["tolerant_extract"] = "WITH p AS (SELECT p_partkey AS k, 'old/p_' || p_partkey || '.py' AS path FROM part)\n" + "\nUNION ALL ".join([
    _broken(0, "error", "", 1, None, ""), _broken(0, "error", "", 4, None, ""),
    _broken(0, "chunk", "a{K}", 2, 3, r"def a{K}():\n    return os.getpid()"),
    _broken(0, "chunk", "__module_level__", 0, 5,
            r'import os\nprint "old {K}"\ndef a{K}():\n    return os.getpid()\nprint "more"\nY = f({K})'),
    _broken(0, "call", "a{K}", 0, None, "os.getpid"), _broken(0, "call", "__module_level__", 0, None, "os.getpid"),
    _broken(0, "call", "__module_level__", 1, None, "f"), _broken(0, "import", "", 0, None, "import os"),
    _broken(1, "error", "", 3, None, ""), _broken(1, "chunk", "b{K}", 1, 2, r"def b{K}(x):\r\n    return g(x)"),
    _broken(1, "chunk", "__module_level__", 0, 0, "import os"), _broken(1, "call", "b{K}", 0, None, "g"),
    _broken(1, "import", "", 0, None, "import os"),
    _broken(2, "error", "", 0, None, ""), _broken(2, "chunk", "c{K}", 1, 2, r'def c{K}():\n    return h("(")'),
    _broken(2, "chunk", "E{K}", 6, 8, r"class E{K}:\n    def m(self):\n        return self.n()"),
    _broken(2, "chunk", "E{K}.m", 7, 8, r"def m(self):\n        return self.n()"),
    _broken(2, "chunk", "__module_level__", 3, 5, r"@deco\nasync def d{K}():\n    pass"),
    _broken(2, "call", "c{K}", 0, None, "h"), _broken(2, "call", "E{K}", 0, None, "self.n"), _broken(2, "call", "m", 0, None, "self.n"),
    _broken(3, "error", "", 7, None, ""),
    _broken(3, "chunk", "__module_level__", 0, 6, r'DOC = """\ndef not_code():\n"""\nif DOC:\n    i{K}()\nelse:\n    j()'),
    _broken(3, "call", "__module_level__", 0, None, "i{K}"), _broken(3, "call", "__module_level__", 1, None, "j"),
])


# ------------------------------------------------------------ graph + retrieval
def _bfs(seeds: str, edges: str, budget: int = 30) -> str:
    """CTEs und, h1, h2, expanded: 2-hop BFS from seeds(query_id, symbol)
    over edges(src, dst), scored and cut to the budget (unpruned)."""
    return f"""
e_ AS ({edges}),
und AS (SELECT src, dst FROM (SELECT src, dst FROM e_ UNION SELECT dst, src FROM e_) WHERE src <> dst),
s0 AS (SELECT DISTINCT query_id, symbol FROM ({seeds})),
h1 AS (SELECT DISTINCT s.query_id, u.dst AS symbol FROM s0 s JOIN und u ON u.src = s.symbol
       WHERE NOT EXISTS (SELECT 1 FROM s0 v WHERE v.query_id = s.query_id AND v.symbol = u.dst)),
h2 AS (SELECT DISTINCT s.query_id, u.dst AS symbol FROM h1 s JOIN und u ON u.src = s.symbol
       WHERE NOT EXISTS (SELECT 1 FROM s0 v WHERE v.query_id = s.query_id AND v.symbol = u.dst)
         AND NOT EXISTS (SELECT 1 FROM h1 v WHERE v.query_id = s.query_id AND v.symbol = u.dst)),
allv AS (SELECT query_id, symbol, 0 AS hop FROM s0 UNION ALL SELECT query_id, symbol, 1 FROM h1
         UNION ALL SELECT query_id, symbol, 2 FROM h2),
scored AS (SELECT query_id, symbol, hop,
                  CASE WHEN hop = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - 0.2 * hop) END::DOUBLE AS score FROM allv),
expanded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol)
                            AS rank FROM scored) WHERE rank <= {budget})
"""


PAGE_EDGES = ("SELECT DISTINCT src, dst FROM (SELECT url AS src, "
              "unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages)")
PAGE_LINKS = "SELECT url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages"

SEM_CTE = """
sem AS (SELECT * FROM (
  SELECT query_id, chunk_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
               1.0 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS d
        FROM embeddings q, embeddings c)) WHERE rank <= 10)"""

VEC_EDGES = ("SELECT vec_id AS src, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS dst FROM embeddings "
             "UNION SELECT vec_id, (vec_id * 13 + 5) % (SELECT count(*) FROM embeddings) FROM embeddings")

ORACLE.update({
    "graph_expand": f"""WITH {_bfs("SELECT page_id AS query_id, url AS symbol FROM pages", PAGE_EDGES)}
SELECT query_id, rank, symbol, CAST(hop AS BIGINT) AS hop, ROUND(score, 6) AS score FROM expanded""",
    "callers_callees": f"""WITH e AS ({PAGE_EDGES})
SELECT dst AS node, 'caller' AS direction, src AS other FROM e
UNION ALL SELECT src, 'callee', dst FROM e""",
    "dependents_contains": f"""WITH l AS ({PAGE_LINKS}),
m AS (SELECT DISTINCT regexp_extract(href, '[^/]*$') AS module FROM l)
SELECT DISTINCT m.module, l.url AS dependent FROM m JOIN l ON contains(l.href, m.module)
WHERE m.module <> ''""",
    "related_files": f"""WITH {CORPUS_CTE},
deps AS (SELECT c.k AS query_id, 'dependency' AS kind, i.import_text AS item
         FROM corpus c JOIN imports i ON i.path = c.path),
dnts AS (SELECT c.k AS query_id, 'dependent' AS kind, i.path AS item
         FROM corpus c JOIN imports i ON contains(i.import_text, c.module)),
b AS (SELECT * FROM deps UNION SELECT * FROM dnts)
SELECT query_id, kind, item FROM b UNION SELECT query_id, 'related', item FROM b""",
    "hybrid_retrieve": f"""WITH {SEM_CTE},
{_bfs("SELECT query_id, chunk_id AS symbol FROM sem", VEC_EDGES)},
g AS (SELECT t.query_id, t.symbol AS chunk_id, t.score FROM expanded t
      WHERE NOT EXISTS (SELECT 1 FROM sem s WHERE s.query_id = t.query_id AND s.chunk_id = t.symbol)),
u AS (SELECT query_id, chunk_id, 1.0::DOUBLE AS score, 'semantic' AS source, 0 AS srank, d AS distance FROM sem
      UNION ALL SELECT query_id, chunk_id, score, 'graph', 1, NULL FROM g)
SELECT query_id,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, srank, distance NULLS LAST, chunk_id) AS rank,
       chunk_id, ROUND(score, 6) AS score, source, ROUND(distance, 6) + 0.0 AS distance FROM u""",
})


# ------------------------------------------------------------ change detection
DOC_CTE = """
snap AS (SELECT doc_id, 'doc/' || doc_id AS path, n_chars AS size,
                TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS mtime, md5(text) AS hash, text
         FROM documents),
man AS (SELECT path, CASE WHEN doc_id % 5 = 1 THEN size + 1 ELSE size END AS size,
               CASE WHEN doc_id % 5 = 2 THEN mtime - INTERVAL 1 SECOND ELSE mtime END AS mtime,
               CASE WHEN doc_id % 5 IN (1, 3) THEN md5('x') ELSE hash END AS hash
        FROM snap WHERE doc_id % 5 <> 0
        UNION ALL
        SELECT 'doc/' || (doc_id + 1000000), size, mtime, hash FROM snap WHERE doc_id % 10 = 4),
st AS (SELECT coalesce(s.path, m.path) AS path,
              CASE WHEN m.path IS NULL THEN 'NEW' WHEN s.path IS NULL THEN 'DELETED'
                   WHEN (s.size <> m.size OR s.mtime <> m.mtime) AND s.hash <> m.hash THEN 'CHANGED'
                   ELSE 'UNCHANGED' END AS status,
              CASE WHEN m.path IS NULL THEN 'NEW' WHEN s.path IS NULL THEN 'DELETED'
                   WHEN s.hash <> m.hash THEN 'CHANGED' ELSE 'UNCHANGED' END AS status_always_hash,
              s.size, s.mtime, s.hash, m.size AS old_size, m.mtime AS old_mtime, m.hash AS old_hash
       FROM snap s FULL OUTER JOIN man m ON s.path = m.path)
"""

ORACLE.update({
    "change_status": f"WITH {DOC_CTE} SELECT path, status, status_always_hash FROM st",
    "manifest_refresh": f"""WITH {DOC_CTE}
SELECT path, CASE WHEN status IN ('NEW', 'CHANGED') THEN size ELSE old_size END AS size,
       strftime(CASE WHEN status IN ('NEW', 'CHANGED') THEN mtime ELSE old_mtime END, '%Y-%m-%d %H:%M:%S') AS mtime,
       CASE WHEN status IN ('NEW', 'CHANGED') THEN hash ELSE old_hash END AS hash
FROM st WHERE status <> 'DELETED'""",
    "invalidate": f"""WITH {DOC_CTE},
lines AS (SELECT path, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos,
                 CAST(length(unnest(string_split(text, chr(10)))) AS BIGINT) AS line_chars FROM snap)
SELECT l.path, l.pos, l.line_chars FROM lines l
WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.path = l.path AND st.status <> 'UNCHANGED')""",
    "vector_upsert": """WITH n AS (SELECT count(*) AS n FROM embeddings),
old AS (SELECT vec_id AS chunk_id, 'old' AS origin, embedding FROM embeddings),
new AS (SELECT vec_id + (SELECT n FROM n) // 2 AS chunk_id, 'new' AS origin, embedding
        FROM embeddings WHERE vec_id % 4 = 0),
up AS (SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new) UNION ALL SELECT * FROM new)
SELECT chunk_id, origin, ROUND(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS emb_head FROM up
WHERE chunk_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 10 = 0)""",
})


# ------------------------------------------------------------ replies, errors, log
from corpusweave.functions.text import PY_SPACE as _PS  # noqa: E402

_ERR_CTE = """
e AS (SELECT event_id, event_id // 3 AS call_id, CAST(event_id % 3 AS BIGINT) AS attempt,
             CASE event_type WHEN 'error' THEN 'ServerError' WHEN 'click' THEN 'ClientError' END AS error_class,
             (['429 RESOURCE_EXHAUSTED', 'Daily Quota hit', '503 busy', 'read Timeout', '401 bad key',
               'quota 503'])[event_id % 6 + 1] || ' ' || repeat(event_type, CAST(1 + event_id % 40 AS INT))
             || chr(10) || 'detail ' || props AS message
      FROM events),
t AS (SELECT *, CASE WHEN contains(message, 'RESOURCE_EXHAUSTED') OR contains(lower(message), 'quota')
                     THEN 'QUOTA_EXCEEDED'
                     WHEN coalesce(error_class = 'ServerError', false) OR contains(message, '503')
                          OR contains(message, 'UNAVAILABLE') OR contains(lower(message), 'timeout')
                     THEN 'TRANSIENT' ELSE 'FATAL' END AS error_kind,
             split_part(message, chr(10), 1) AS fl FROM e)"""

_RUN_CTE = """
ev AS (SELECT event_id, user_id, event_type, value, props, event_type = 'purchase' AS passed,
              coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (
                PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run_no
       FROM events),
th AS (SELECT *, 'U' || user_id || '-' || run_no AS thread_id FROM ev),
rc AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY event_id) - 1 AS retry_count FROM th),
rt AS (SELECT *, CASE WHEN passed THEN 'build' WHEN retry_count >= 3 THEN 'escalate' ELSE 'retry' END AS route
       FROM rc)"""

_DECISION = "(['retry', 'approve', 'abandon', 'maybe', NULL])[event_id % 5 + 1]"
_ROUTE_DECISION = "CASE WHEN {d} = 'retry' THEN 'retry' WHEN {d} = 'approve' THEN 'build' ELSE 'end' END"


def _pri(col):
    word = ("CASE " + col + " WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'medium' "
            "WHEN '4-NOT SPECIFIED' THEN 'unspecified' WHEN '5-LOW' THEN 'low' END")
    return (f"coalesce(CASE lower({word}) WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' WHEN 'high' THEN 'High' "
            "WHEN 'critical' THEN 'Highest' END, 'Medium')")


def _typ(col):
    word = f"CASE {col} WHEN 'F' THEN 'bug' WHEN 'O' THEN 'Feature' WHEN 'P' THEN 'task' END"
    return f"coalesce(CASE lower({word}) WHEN 'bug' THEN 'Bug' WHEN 'feature' THEN 'Story' END, 'Bug')"


ORACLE.update({
    "error_triage": f"""WITH {_ERR_CTE}
SELECT event_id, call_id, attempt, error_kind,
       CASE WHEN length(fl) <= 200 THEN fl ELSE substr(fl, 1, 200) || '...' END AS short FROM t""",
    "retry_schedule": f"""WITH {_ERR_CTE},
s AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY attempt) - 1 AS n,
             coalesce(sum(CASE WHEN error_kind <> 'TRANSIENT' THEN 1 ELSE 0 END) OVER (
               PARTITION BY call_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops
      FROM t),
r AS (SELECT *, (stops = 0 AND n < 3) AS reached FROM s),
w AS (SELECT *, (reached AND error_kind = 'TRANSIENT' AND n < 2) AS will_retry FROM r)
SELECT call_id, attempt, error_kind, reached, will_retry,
       CAST(CASE WHEN will_retry THEN (n + 1) * 5 ELSE 0 END AS BIGINT) AS wait_s,
       (reached AND NOT will_retry) AS gave_up FROM w""",
    "reply_parse": f"""WITH r AS (
  SELECT event_id AS plan_id,
         CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN props
              WHEN 2 THEN chr(10) || chr(10) || props || chr(10) ELSE substr(props, 1, length(props) - 1) END AS raw
  FROM events),
c AS (SELECT plan_id, regexp_replace(regexp_replace(raw, '^{_PS}+|{_PS}+$', '', 'g'),
                                     '(?m)^```json\\s*|\\s*```$', '', 'g') AS cleaned FROM r),
v AS (SELECT *, coalesce(json_valid(cleaned), false) AND cleaned <> '' AS ok FROM c)
SELECT plan_id, cleaned, ok AS parse_ok,
       CASE WHEN ok THEN CAST(CAST(json_extract(cleaned, '$.k') AS BIGINT) AS VARCHAR) END AS k,
       'COVERAGE_ANALYSIS_' || CASE WHEN ok THEN 'SUCCESS' ELSE 'PARSE_ERROR' END AS reason_code, false AS needs_new_tests FROM v""",
    "run_log": f"""WITH d AS (
  SELECT doc_id, (['STEP', 'SUCCESS', 'WARN', 'ERROR', 'DETAIL'])[doc_id % 5 + 1] AS level, text,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS ts,
         regexp_replace(text, '^{_PS}+|{_PS}+$', '', 'g') AS s FROM documents)
SELECT doc_id, level,
       CASE WHEN text IS NULL OR text = '' THEN '(no output)' WHEN length(s) <= 500 THEN s
            ELSE '... [' || (length(s) - 500) || ' earlier characters hidden — see pipeline.log for full output] ...'
                 || chr(10) || right(s, 500) END AS display,
       '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ' || level || ': ' || text AS log_line
FROM d""",
    "ticket_normalise": f"""WITH o AS (
  SELECT o_orderkey, 'Order ' || o_orderkey AS summary,
         'Customer ' || o_custkey || ' ordered on ' || strftime(o_orderdate, '%Y-%m-%d') AS description,
         {_pri('o_orderpriority')} AS pri, {_typ('o_orderstatus')} AS typ FROM orders)
SELECT o_orderkey AS ticket_id, pri AS priority_name, typ AS issue_type_name,
       CAST(json_object('fields', json_object(
         'project', json_object('key', 'SDLC'), 'summary', summary,
         'description', json_object('type', 'doc', 'version', 1, 'content', json_array(json_object(
             'type', 'paragraph', 'content', json_array(json_object('type', 'text', 'text', description))))),
         'issuetype', json_object('name', typ), 'priority', json_object('name', pri))) AS VARCHAR) AS payload
FROM o""",
    "status_match": """WITH w AS (
  SELECT o_orderkey AS ticket_key,
         CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'IN PROGRESS' WHEN 'P' THEN 'In Review' END AS status_name
  FROM orders),
tr AS (SELECT l_orderkey AS ticket_key, l_linenumber AS pos, l_orderkey || '-' || l_linenumber AS id,
              CASE WHEN l_returnflag = 'R' THEN 'In Review' WHEN l_returnflag = 'A' THEN 'In Progress'
                   WHEN l_linestatus = 'F' THEN 'Done' ELSE 'To Do' END AS name FROM lineitem),
j AS (SELECT w.ticket_key, w.status_name,
             arg_min(tr.id, tr.pos) FILTER (WHERE lower(tr.name) = lower(w.status_name)) AS tid,
             count(tr.name) FILTER (WHERE lower(tr.name) = lower(w.status_name)) AS nhit,
             list(tr.name ORDER BY tr.pos, tr.name) FILTER (WHERE tr.name IS NOT NULL) AS names
      FROM w LEFT JOIN tr ON tr.ticket_key = w.ticket_key GROUP BY w.ticket_key, w.status_name)
SELECT ticket_key, status_name, nhit > 0 AS success, CASE WHEN nhit > 0 THEN tid END AS transition_id,
       CASE WHEN nhit > 0 THEN 'TRANSITIONED' ELSE 'INVALID_STATUS' END AS reason_code,
       CASE WHEN nhit = 0 THEN 'Status ''' || status_name || ''' not available. Available: ' ||
            CASE WHEN coalesce(len(names), 0) = 0 THEN '[]' ELSE '[''' || array_to_string(names, ''', ''') || ''']' END
       END AS error
FROM j""",
    "test_summary": """WITH r AS (
  SELECT doc_id, doc_id % 2 = 0 AS passed,
         replace(replace(replace(text, ' de ', ' passed '), ' the ', ' failed '), ' la ', ' ERROR ') AS output
  FROM documents),
f AS (SELECT doc_id, passed, list_filter(string_split(output, chr(10)), lambda l: contains(l, 'passed')
             OR contains(l, 'failed') OR contains(lower(l), 'error')) AS ls FROM r)
SELECT doc_id, passed, coalesce(ls[-1], CASE WHEN passed THEN 'All tests passed' ELSE 'Tests failed' END) AS summary,
       CASE WHEN passed THEN 'TESTS_PASSED' ELSE 'TESTS_FAILED' END AS reason_code FROM f""",
    "retry_routing": f"""WITH {_RUN_CTE}
SELECT event_id AS seq, thread_id, CAST(retry_count AS BIGINT) AS retry_count, passed, route FROM rt""",
    "decision_routing": f"""WITH {_RUN_CTE},
x AS (SELECT event_id, {_DECISION} AS decision FROM rt WHERE route = 'escalate')
SELECT event_id AS seq, decision, {_ROUTE_DECISION.format(d='decision')} AS next_route FROM x""",
    "gates": """WITH k AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
SELECT event_id,
       CASE WHEN event_type <> 'view' AND NOT coalesce(k % 3 <> 0, false) THEN 'CHANGES_NOT_APPLIED'
            ELSE 'PROCEED' END AS build_gate,
       CASE WHEN coalesce(CASE WHEN event_type = 'signup' THEN NULL ELSE k % 2 = 0 END, false) THEN 'DEPLOY'
            ELSE 'NO_IMAGE_TO_DEPLOY' END AS deploy_gate
FROM k""",
    "escalations": f"""WITH {_RUN_CTE},
x AS (SELECT event_id, 'U-' || user_id AS ticket, retry_count,
             coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE props END, 'No summary available') AS test_summary
      FROM rt WHERE route = 'escalate')
SELECT event_id AS seq, 'MAX_RETRIES_EXCEEDED' AS reason, ticket, CAST(retry_count AS BIGINT) AS retry_count,
       test_summary, 'Retry loop failed ' || retry_count || ' times for ' || ticket || '. Tests still failing: '
       || test_summary || '. Reply approve, retry or abandon.' AS message FROM x""",
    "latest_state": """SELECT user_id AS thread_id,
  ROUND(arg_max(value, event_id) FILTER (WHERE event_type = 'signup'), 6) + 0.0 AS signup,
  ROUND(arg_max(value, event_id) FILTER (WHERE event_type = 'error'), 6) + 0.0 AS error,
  ROUND(arg_max(value, event_id) FILTER (WHERE event_type = 'click'), 6) + 0.0 AS click,
  ROUND(arg_max(value, event_id) FILTER (WHERE event_type = 'view'), 6) + 0.0 AS view,
  ROUND(arg_max(value, event_id) FILTER (WHERE event_type = 'purchase'), 6) + 0.0 AS purchase
FROM events GROUP BY user_id""",
    "incomplete_runs": f"""WITH ev AS (
  SELECT event_id, user_id, value,
         coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (
           PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clicks_before,
         CASE event_type WHEN 'signup' THEN 'pm' WHEN 'view' THEN 'dev' WHEN 'click' THEN 'test'
              WHEN 'error' THEN 'escalate' WHEN 'purchase' THEN 'deploy' END AS node,
         {_DECISION} AS decision FROM events),
r AS (SELECT *, CASE WHEN node = 'test' THEN (CASE WHEN value > 25 THEN 'build' WHEN clicks_before >= 3 THEN 'escalate'
                                                   ELSE 'retry' END)
                     WHEN node = 'escalate' THEN {_ROUTE_DECISION.format(d='decision')} END AS route FROM ev),
l AS (SELECT * FROM (SELECT user_id AS thread_id, event_id AS last_seq, node, route,
                            row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM r) WHERE rn = 1),
nn AS (SELECT * FROM (VALUES ('pm', NULL, 'dev'), ('dev', NULL, 'test'), ('test', 'build', 'build'),
                             ('test', 'retry', 'increment'), ('test', 'escalate', 'escalate'),
                             ('increment', NULL, 'dev'), ('escalate', 'build', 'build'),
                             ('escalate', 'retry', 'increment'), ('escalate', 'end', NULL),
                             ('build', NULL, 'deploy'), ('deploy', NULL, NULL)) t(node, route, next))
SELECT l.thread_id, l.last_seq, l.node, nn.next AS pending
FROM l JOIN nn ON nn.node = l.node AND (nn.route IS NULL OR nn.route = l.route) WHERE nn.next IS NOT NULL""",
    "audit_comments": """WITH per AS (
  SELECT l_orderkey, count(*) AS n_lines,
         list('line_' || l_linenumber || '.py' ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R') AS md,
         list(printf('  - line_%d.py (f%d): invalid syntax at line %d', l_linenumber, l_linenumber, l_linenumber)
              ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'A') AS rj
  FROM lineitem GROUP BY l_orderkey),
j AS (SELECT o.o_orderkey, o.o_orderstatus, p.n_lines, coalesce(p.md, []) AS md, coalesce(p.rj, []) AS rj,
             'ORD-' || o.o_orderkey AS ticket, CAST(o.o_orderkey % 4 AS INT) AS retry
      FROM orders o LEFT JOIN per p ON p.l_orderkey = o.o_orderkey)
SELECT ticket, 'dev' AS stage,
  'Code edited for ' || ticket || CASE WHEN retry > 0 THEN ', attempt ' || retry || ' after failed tests' ELSE '' END || '.' || chr(10) || chr(10)
  || 'WHO: Dev stage' || chr(10) || 'WHAT: '
  || coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Order status ' || o_orderstatus END, 'Code changes applied')
  || chr(10) || 'WHY: Asked for by ' || ticket || chr(10) || 'WHERE: '
  || CASE WHEN len(md) > 0 THEN array_to_string(md, ', ') ELSE 'No files modified' END
  || chr(10) || 'COMMIT: ' || coalesce(CASE WHEN len(md) > 0 THEN 'https://git.example/commit/' || o_orderkey END, 'N/A')
  || chr(10) || CASE WHEN len(rj) > 0 THEN chr(10) || 'NOT APPLIED, as the file would not parse afterwards:'
                     || chr(10) || array_to_string(rj, chr(10)) || chr(10) ELSE '' END AS comment
FROM j
UNION ALL
SELECT ticket, 'test', 'Tests run for ' || ticket || '.' || chr(10) || chr(10) || 'WHO: Test stage' || chr(10)
  || 'WHAT: Whole suite; new tests added: ' || CASE WHEN o_orderkey % 5 = 0 THEN 'yes' ELSE 'no' END || chr(10)
  || 'WHY: Check the change of ' || ticket || chr(10) || 'RESULT: ' || CASE WHEN o_orderstatus = 'F' THEN 'TESTS_PASSED' ELSE 'TESTS_FAILED' END
  || chr(10) || 'SUMMARY: ' || coalesce(n_lines, 0) || ' passed' || chr(10) || 'QA REASONING: '
  || CASE WHEN o_orderkey % 2 = 0 THEN 'covered' ELSE 'N/A' END || chr(10)
FROM j
UNION ALL
SELECT ticket, 'build', CASE
  WHEN len(md) = 0 AND len(rj) > 0 THEN 'Build not started for ' || ticket || '.' || chr(10) || chr(10) || 'WHO: Build stage' || chr(10)
    || 'WHAT: Every proposed change was turned down, so the code is as it was' || chr(10)
    || 'WHY: An image of unchanged code would pass for the fix' || chr(10)
    || 'ACTION NEEDED: Read the dev comment for the changes turned down, then edit by hand or run again' || chr(10)
  WHEN o_orderkey % 3 <> 0 THEN 'Build done for ' || ticket || '.' || chr(10) || chr(10) || 'WHO: Build stage' || chr(10)
    || 'WHAT: Image app:' || o_orderkey || chr(10) || 'WHY: Package the tested code of ' || ticket || chr(10)
    || 'COMMIT: ' || CASE WHEN len(md) > 0 THEN 'https://git.example/commit/' || o_orderkey ELSE 'N/A' END || chr(10) || 'RESULT: BUILD_SUCCESS' || chr(10)
  ELSE 'Build failed for ' || ticket || '.' || chr(10) || chr(10) || 'WHO: Build stage' || chr(10) || 'WHAT: Tried image app:' || o_orderkey || chr(10)
    || 'WHY: Package the tested code of ' || ticket || chr(10) || 'RESULT: ' || CASE WHEN o_orderkey % 7 > 0 THEN 'BUILD_FAILED' ELSE 'UNKNOWN' END
    || chr(10) || 'OUTPUT (tail): '
    || CASE WHEN o_orderkey % 2 = 0 THEN right('log ' || repeat(CAST(o_orderkey AS VARCHAR), 200), 500) ELSE 'No output captured' END || chr(10) END
FROM j
UNION ALL
SELECT ticket, 'deploy', 'Deployed for ' || ticket || '.' || chr(10) || chr(10) || 'WHO: Deploy stage' || chr(10) || 'WHAT: Image app:' || o_orderkey
  || chr(10) || 'WHY: See the image run before it goes further' || chr(10) || 'POD: pod-' || o_orderkey || chr(10) || 'NODEPORT: '
  || CASE WHEN o_orderkey % 4 > 0 THEN CAST(30000 + o_orderkey % 100 AS VARCHAR) ELSE 'unknown' END || chr(10) || 'TO ACCESS: open app' || chr(10)
  || 'RESULT: DEPLOY_SUCCESS' || chr(10)
FROM j WHERE NOT (len(md) = 0 AND len(rj) > 0) AND o_orderkey % 3 <> 0""",
})


# ------------------------------------------------------------ dependency audit
from corpusweave.operators import deps as _deps  # noqa: E402
from corpusweave.operators import prompts as _P  # noqa: E402


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STD = ", ".join(_lit(n) for n in _deps.stdlib_names())
_ALIAS = ", ".join(f"({_lit(a)}, {_lit(b)})" for a, b in _deps.IMPORT_TO_PACKAGE.items())
_EXCL = ", ".join(_lit(x) for x in _deps.EXCLUDED_DIRS)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_PS}+|{_PS}+$', '', 'g')"


_DEPS_CTE = f"""
im AS (SELECT path, regexp_extract(import_text, '^(?:from|import)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS module
       FROM imports),
loc AS (SELECT DISTINCT CASE WHEN position('/' IN path) = 0 THEN regexp_replace(path, '\\.py$', '')
                             ELSE split_part(path, '/', 1) END AS module
        FROM corpus WHERE split_part(path, '/', 1) NOT IN ({_EXCL}) AND NOT starts_with(split_part(path, '/', 1), '.')),
std AS (SELECT unnest([{_STD}]) AS module),
alias AS (SELECT * FROM (VALUES {_ALIAS}) t(module, package)),
tp AS (SELECT DISTINCT 'corpus' AS repo, coalesce(a.package, im.module) AS package
       FROM im LEFT JOIN alias a ON a.module = im.module
       WHERE im.module NOT IN (SELECT module FROM std) AND im.module NOT IN (SELECT module FROM loc)),
req AS (SELECT p_partkey AS pos,
               CASE p_partkey % 5 WHEN 0 THEN 'pkg' || p_partkey || '==1.0' WHEN 1 THEN 'Pkg' || p_partkey || '>=2'
                    WHEN 2 THEN 'pkg' || p_partkey || '<=3' WHEN 3 THEN '# pkg' || p_partkey ELSE '' END AS line
        FROM part
        UNION ALL SELECT max(p_partkey) + 1, 'svc' FROM part
        UNION ALL SELECT max(p_partkey) + 2, 'Flask' FROM part),
rq AS (SELECT pos, line, ({_strip('line')} <> '' AND NOT starts_with(line, '#')) AS listed,
              lower(split_part(split_part(split_part({_strip('line')}, '==', 1), '>=', 1), '<=', 1)) AS name FROM req),
listed_names AS (SELECT DISTINCT name FROM rq WHERE listed),
miss AS (SELECT package FROM tp WHERE lower(package) NOT IN (SELECT name FROM listed_names))"""

_PATCH_CTE = f"""
src AS (SELECT k, path, {_span(0, 19)} || chr(10) AS text FROM corpus),
pe AS (
  SELECT k AS plan_id, 0 AS file_pos, path, '0' AS change_pos, 'applied' AS edit_status, NULL AS reason,
         'modified' AS file_status, 1 AS applied_count,
         md5(replace(text, 'len(str(self))', '1  # 2024-01-01T00:00:00')) AS content_md5 FROM src WHERE k % 5 = 0
  UNION ALL SELECT k, 0, path, '0', 'skipped_not_found', NULL, 'unchanged', 0, NULL FROM src WHERE k % 5 = 1
  UNION ALL SELECT k, 0, path, '0', 'rejected_invalid', 'invalid syntax at line 16', 'unchanged', 0, NULL
            FROM src WHERE k % 5 = 2
  UNION ALL SELECT k, 0, path, c.p, 'applied', NULL, 'modified', 2,
                   md5(replace(replace(text, '(self)', '(me)'), 'len(str(me))', '1'))
            FROM src, (VALUES ('0'), ('1')) c(p) WHERE k % 5 = 3
  UNION ALL SELECT k, CASE WHEN k % 5 = 4 THEN 0 ELSE 1 END, '../corpus2/svc/s_0.py', '0', 'file_missing', NULL,
                   'missing', 0, NULL FROM corpus WHERE k % 7 = 0
  UNION ALL SELECT k, CASE WHEN k % 5 = 4 THEN 1 ELSE 2 END, 'svc/missing.py', '0', 'file_missing', NULL,
                   'missing', 0, NULL FROM corpus WHERE k % 7 = 0)"""

ORACLE.update({
    "third_party": f"WITH {CORPUS_CTE}, {_DEPS_CTE} SELECT repo, package FROM tp",
    "requirements_diff": f"""WITH {CORPUS_CTE}, {_DEPS_CTE}
SELECT 'corpus' AS repo, 'REQUIREMENTS_UPDATED' AS reason_code, package FROM miss
UNION ALL
SELECT 'corpus', 'REQUIREMENTS_UP_TO_DATE', name FROM listed_names WHERE (SELECT count(*) FROM miss) = 0""",
    "requirements_clean": f"""WITH {CORPUS_CTE}, {_DEPS_CTE},
j AS (SELECT pos, line, NOT coalesce(listed AND name IN (SELECT lower(module) FROM loc), false) AS kept
      FROM rq WHERE {_strip('line')} <> '')
SELECT 'corpus' AS repo, CAST(pos AS BIGINT) AS pos, line, kept,
       CASE WHEN (SELECT count(*) FROM j WHERE NOT kept) > 0 THEN 'REQUIREMENTS_CLEANED'
            ELSE 'REQUIREMENTS_ALREADY_CLEAN' END AS reason_code FROM j""",
    "patch_eval": f"""WITH {CORPUS_CTE}, {_PATCH_CTE}
SELECT CAST(plan_id AS BIGINT) AS plan_id, CAST(file_pos AS BIGINT) AS file_pos, path, change_pos, edit_status,
       reason, file_status, CAST(applied_count AS BIGINT) AS applied_count, content_md5 FROM pe""",
    "change_flags": f"""WITH {CORPUS_CTE}
SELECT CAST(k AS BIGINT) AS plan_id, (k % 5 <> 4 OR k % 7 = 0) AS had_intended_changes,
       (k % 5 IN (0, 3)) AS code_changes_applied, CAST(CASE WHEN k % 5 = 2 THEN 1 ELSE 0 END AS BIGINT) AS n_rejected
FROM corpus""",
})


# ------------------------------------------------------------ prompt assembly
def _bul(arr: str, fb: str) -> str:
    return (f"CASE WHEN coalesce(len({arr}), 0) > 0 THEN array_to_string(list_transform({arr}, "
            f"lambda s: '- ' || s), chr(10)) ELSE {_lit(fb)} END")


ORACLE["prompt_render"] = f"""WITH h AS (
  SELECT conv_id AS query_id, turn + 1 AS rank, 'conv' || conv_id || '.' || role || '_' || turn AS symbol_id,
         'conv/' || conv_id || '.py' AS path, turn * 10 AS start_line, turn * 10 + 9 AS end_line,
         CASE WHEN role = 'user' THEN 'semantic' ELSE 'graph' END AS source,
         CAST(CASE role WHEN 'user' THEN 1.0 WHEN 'assistant' THEN 0.8 ELSE 0.6 END AS DOUBLE) AS score,
         text AS content FROM conversations),
b AS (SELECT query_id, rank, symbol_id, source,
             chr(10) || '---' || chr(10) || 'Symbol: ' || symbol_id || chr(10) || 'File: ' || path || ' (lines '
             || start_line || '-' || end_line || ')' || chr(10) || 'Source: ' || source || ' | Relevance score: '
             || format('{{:.2f}}', score) || chr(10) || '```python' || chr(10) || content || chr(10) || '```'
             || chr(10) AS block FROM h),
agg AS (SELECT query_id, string_agg(block, '' ORDER BY rank) AS chunks_text,
               list(symbol_id ORDER BY rank) FILTER (WHERE source = 'semantic') AS seeds,
               list(symbol_id ORDER BY rank) AS expanded FROM b GROUP BY query_id),
t AS (SELECT conv_id AS query_id, 'CONV-' || conv_id AS ticket_key, 'https://tracker.example/CONV-' || conv_id AS url,
             arg_min(text, turn) AS query, string_agg(text, chr(10) ORDER BY turn) AS full_output,
             conv_id % 3 AS retry_count FROM conversations GROUP BY conv_id)
SELECT t.query_id, t.ticket_key,
  {_lit(_P.PREAMBLE)} || chr(10)
  || CASE WHEN retry_count > 0 THEN chr(10) || '=== THIS IS RETRY ATTEMPT #' || retry_count || ' ===' || chr(10)
          || 'The previous change failed the tests; produce a different fix.' || chr(10) || chr(10)
          || 'TEST FAILURE SUMMARY: attempt ' || retry_count || ' failed' || chr(10) || chr(10)
          || 'TEST FAILURE OUTPUT (most recent portion):' || chr(10) || '```' || chr(10)
          || CASE WHEN length(full_output) > 3000 THEN right(full_output, 3000) ELSE full_output END
          || chr(10) || '```' || chr(10) ELSE '' END
  || chr(10) || {_lit(_P.H_TICKET)} || chr(10) || 'Ticket ID: ' || ticket_key || chr(10) || 'URL: ' || url
  || chr(10) || 'Query: ' || query || chr(10) || chr(10) || {_lit(_P.H_TARGETS)} || chr(10)
  || {_bul('seeds', _P.FALLBACK_TARGETS)} || chr(10) || chr(10) || {_lit(_P.H_RELATED)} || chr(10)
  || {_bul('expanded', _P.FALLBACK_LIST)} || chr(10) || chr(10) || {_lit(_P.H_DEPS)} || chr(10)
  || 'Files this code imports from:' || chr(10) || {_lit(_P.FALLBACK_LIST)} || chr(10) || chr(10)
  || 'Files that import this code:' || chr(10) || {_lit(_P.FALLBACK_LIST)} || chr(10) || chr(10)
  || {_lit(_P.H_CHUNKS)} || chr(10) || coalesce(nullif(chunks_text, ''), {_lit(_P.FALLBACK_CHUNKS)})
  || chr(10) || chr(10) || {_lit(_P.H_FILES)} || chr(10) || {_lit(_P.FALLBACK_FILES)} || chr(10) || chr(10)
  || {_lit(_P.H_INSTR)} || chr(10) || {_lit(_P.INSTRUCTIONS)} || chr(10) AS prompt
FROM t LEFT JOIN agg ON agg.query_id = t.query_id"""


# ------------------------------------------------------------ streaming
ORACLE.update({
    "stream_refresh": f"""WITH {CORPUS_CTE.replace("  FROM supplier),", "  FROM supplier WHERE s_suppkey % 10 <> 4),", 1)},
t AS (SELECT path, k, {_span(0, 19)} || chr(10) AS text FROM corpus),
f AS (SELECT path, CASE WHEN k % 5 = 1 THEN replace(text, 'import os' || chr(10), 'import os' || chr(10)
                                                   || 'import sys' || chr(10)) ELSE text END AS text,
             CASE WHEN k % 5 = 1 THEN 4 ELSE 3 END AS n_imports
      FROM t),
e AS (SELECT path, string_agg(edge, chr(10) ORDER BY edge) AS edges
      FROM (SELECT DISTINCT path, caller || ' > ' || dst || CASE WHEN resolved THEN '' ELSE ' ?' END AS edge FROM resolved) GROUP BY path)
SELECT f.path, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS hash,
       CAST(4 AS BIGINT) AS n_chunks, CAST(n_imports AS BIGINT) AS n_imports, edges FROM f LEFT JOIN e ON e.path = f.path""",
    "stream_decisions": f"""WITH ev AS (
  SELECT event_id AS seq, user_id, event_type = 'signup' AS answer, event_type = 'purchase' AS passed,
         CASE WHEN event_type = 'signup' THEN {_DECISION} END AS decision FROM events),
en AS (SELECT *, CASE WHEN answer THEN decision IS DISTINCT FROM 'retry' ELSE passed END AS ends FROM ev),
ru AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run_no
       FROM en),
rc AS (SELECT *, coalesce(sum((NOT answer)::INT) OVER (PARTITION BY user_id, run_no ORDER BY seq
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS retry_count FROM ru)
SELECT seq, user_id, CAST(run_no AS BIGINT) AS run_no, CAST(retry_count AS BIGINT) AS retry_count, CASE WHEN NOT answer THEN passed END AS passed,
       decision, CASE WHEN answer THEN {_ROUTE_DECISION.format(d='decision')} WHEN passed THEN 'build' WHEN retry_count >= 3 THEN 'escalate'
       ELSE 'retry' END AS route, 'routed' AS status FROM rc""",
    "stream_routing": f"WITH {_RUN_CTE} SELECT event_id AS seq, thread_id, CAST(retry_count AS BIGINT) AS retry_count,"
                      " passed, route FROM rt",
})

ORACLE["requirements_repos"] = f"""WITH sup AS (SELECT s_suppkey AS k, 'repo_' || s_suppkey AS repo FROM supplier),
scanned AS (
  SELECT repo, unnest(['Flask', 'pkg' || k] || CASE WHEN k % 2 = 0 THEN ['requests'] ELSE [] END) AS package FROM sup
  UNION ALL SELECT 'hot', 'pkg' || p_partkey FROM part),
lines AS (
  SELECT repo, unnest(CASE k % 5 WHEN 2 THEN ['FLASK==1', 'Pkg' || k || '>=2', 'requests<=3'] WHEN 3 THEN ['flask', '# pkg' || k, '']
    WHEN 4 THEN ['svc==1', 'Flask', 'pkg' || k, 'requests'] ELSE [] END) AS line FROM sup
  UNION ALL SELECT 'hot', 'pkg' || p_partkey || '==1.0' FROM part WHERE p_partkey % 2 = 0),
names AS (
  SELECT DISTINCT repo, lower(split_part(split_part(split_part({_strip('line')}, '==', 1), '>=', 1), '<=', 1)) AS name
  FROM lines WHERE {_strip('line')} <> '' AND NOT starts_with(line, '#')),
state AS (
  SELECT repo, k % 5 = 0 AS absent FROM sup UNION ALL SELECT 'hot', false),
miss AS (SELECT DISTINCT repo, package FROM scanned s WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.repo = s.repo AND n.name = lower(s.package))),
codes AS (
  SELECT repo, CASE WHEN absent THEN 'REQUIREMENTS_CREATED' WHEN repo IN (SELECT repo FROM miss) THEN 'REQUIREMENTS_UPDATED'
                    ELSE 'REQUIREMENTS_UP_TO_DATE' END AS reason_code FROM state),
added AS (
  SELECT c.repo, reason_code, package AS entry FROM codes c LEFT JOIN miss m ON m.repo = c.repo WHERE reason_code <> 'REQUIREMENTS_UP_TO_DATE'
  UNION ALL SELECT c.repo, reason_code, name FROM codes c LEFT JOIN names n ON n.repo = c.repo WHERE reason_code = 'REQUIREMENTS_UP_TO_DATE'),
gone AS (SELECT DISTINCT repo, line FROM lines WHERE line = 'svc==1'),
cleaned AS (
  SELECT s.repo, CASE WHEN g.line IS NULL THEN 'REQUIREMENTS_ALREADY_CLEAN' ELSE 'REQUIREMENTS_CLEANED' END AS reason_code, g.line AS entry
  FROM state s LEFT JOIN gone g ON g.repo = s.repo WHERE NOT absent
  UNION ALL SELECT repo, reason_code, entry FROM added WHERE reason_code = 'REQUIREMENTS_CREATED'),
u AS (SELECT 'add' AS part, * FROM added UNION ALL SELECT 'clean', * FROM cleaned)
SELECT repo, part, reason_code, CASE WHEN entry IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY repo, part ORDER BY entry) END AS rank,
       coalesce(entry, '') AS entry FROM u"""

ORACLE["coverage_decisions"] = """SELECT event_id AS plan_id, event_id % 8 IN (0, 1, 5) AS needs_new_tests,
  CASE WHEN event_id % 8 IN (0, 1) THEN event_type WHEN event_id % 8 = 5 THEN '' WHEN event_id % 8 IN (6, 7)
       THEN 'No answer from the model after all attempts' ELSE 'The answer is not valid JSON' END AS reasoning,
  CASE WHEN event_id % 8 IN (0, 1) THEN 'def test_' || event_id || '(): pass' ELSE '' END AS new_test_code,
  CASE WHEN event_id % 8 IN (0, 1, 5) THEN 'COVERAGE_ANALYSIS_SUCCESS' WHEN event_id % 8 IN (6, 7) THEN 'COVERAGE_ANALYSIS_API_ERROR'
       ELSE 'COVERAGE_ANALYSIS_PARSE_ERROR' END AS reason_code FROM events"""


# ------------------------------------------------------------ embeddings, summaries, symbol fetch
def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of ``text``, four bits a step."""
    steps = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ 0xEDB88320 if n & 1 else n >> 1
        steps.append(f"{n}::BIGINT")
    def step(v: str) -> str:
        return f"xor(list_extract([{', '.join(steps)}], (({v}) & 15) + 1), ({v}) >> 4)"
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: (strpos('0123456789ABCDEF', h[1]) * 16 + strpos('0123456789ABCDEF', h[2]) - 17)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: {step(step('xor(a, b)'))}), 4294967295::BIGINT)"


ORACLE["embed_texts"] = rf"""
WITH t AS (SELECT 'chunk ' || doc_id AS text_id, text FROM documents UNION ALL SELECT 'query ' || item_id, text FROM benchmark),
k AS (SELECT text_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\x00-\x20\x7FA-Za-z0-9_]')) AS token FROM t),
n AS (SELECT text_id, token, count(*) AS c FROM k GROUP BY ALL),
w AS (SELECT token, regexp_extract_all(regexp_replace(token, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') AS parts
      FROM (SELECT DISTINCT token FROM n)),
f AS (SELECT token, unnest(list_prepend(token, CASE WHEN regexp_matches(token, '^[A-Za-z_]') AND len(parts) > 1 THEN parts ELSE [] END)) AS feature FROM w),
h AS (SELECT feature, {crc32_sql("translate(feature, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS h
      FROM (SELECT DISTINCT feature FROM f)),
b AS (SELECT n.text_id, h.h % 256 AS place, sum(CASE WHEN h.h >= 2147483648 THEN -n.c ELSE n.c END) AS weight
      FROM n JOIN f USING (token) JOIN h USING (feature) GROUP BY ALL),
s AS (SELECT text_id, sqrt(sum(weight * weight)::DOUBLE) AS norm FROM b GROUP BY text_id)
SELECT text_id, place::BIGINT AS place, ROUND(((weight::DOUBLE / norm)::FLOAT)::DOUBLE, 6) + 0.0 AS value
FROM b JOIN s USING (text_id) WHERE weight <> 0
"""

ORACLE["retrieval_summary"] = f"""WITH {SEM_CTE},
{_bfs("SELECT query_id, chunk_id AS symbol FROM sem", VEC_EDGES)},
g AS (SELECT t.query_id, t.symbol AS chunk_id, t.score FROM expanded t
      WHERE NOT EXISTS (SELECT 1 FROM sem s WHERE s.query_id = t.query_id AND s.chunk_id = t.symbol)),
ch AS (SELECT query_id, chunk_id, 1.0::DOUBLE AS score, rank FROM sem
       UNION ALL SELECT query_id, chunk_id, score, 10 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) FROM g),
{CORPUS_CTE},
files AS (SELECT query_id, 'svc/s_' || (chunk_id % (SELECT count(*) FROM supplier)) || '.py' AS path FROM sem WHERE rank = 1),
per AS (SELECT path, 'dependency' AS kind, import_text AS item FROM imports
        UNION SELECT c.path, 'dependent', i.path FROM corpus c JOIN imports i ON contains(i.import_text, c.module)),
lists AS (SELECT query_id, kind, item FROM files JOIN per USING (path) UNION SELECT query_id, 'related', item FROM files JOIN per USING (path))
SELECT query_id, 'seed' AS kind, rank AS pos, CAST(chunk_id AS VARCHAR) AS item, 1.0::DOUBLE AS score FROM sem
UNION ALL SELECT query_id, 'expanded', rank, CAST(symbol AS VARCHAR), ROUND(score, 6) FROM expanded
UNION ALL SELECT query_id, 'chunk', rank, CAST(chunk_id AS VARCHAR), ROUND(score, 6) FROM ch
UNION ALL SELECT query_id, kind, row_number() OVER (PARTITION BY query_id, kind ORDER BY item), item, NULL FROM lists"""

ORACLE["symbol_fetch"] = f"""WITH {CORPUS_CTE}
SELECT chunk_id, content, symbol_id, short_name FROM chunks
WHERE short_name IN (SELECT regexp_extract(raw_call, '[^.]*$') FROM raw_calls)"""
