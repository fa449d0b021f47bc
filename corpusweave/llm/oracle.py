"""DuckDB SQL for the queries of this package that SQL can state."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, between: str) -> str:
    """The words of ``text`` in lower case (A-Z only); ``between`` is the pattern that separates them."""
    return f"[x FOR x IN string_split_regex(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{between}') IF x <> '']"


_OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', r'[\x20\x09-\x0D]+')} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM reached r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

_OP4 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS stored FROM pages),
h AS (SELECT *, sha1(html) AS sha FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(sha, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = stored THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> stored THEN stored END AS refers_to
FROM h
"""

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OP5 = rf"""
WITH d AS (SELECT doc_id, {_words('text', _BETWEEN)} AS w FROM documents),
i AS (SELECT DISTINCT item_id::VARCHAR AS item_id, {_words('text', _BETWEEN)} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS k
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
found AS (SELECT DISTINCT doc_id, p, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.k = iw.k),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS place FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_S = r"[\x20\x09-\x0D]"
_VALUE = rf"""{_S}*={_S}*("[^"]*"|''[^'']*''|[^\x20\x09-\x0D"''>]+)"""


def _rest(url: str) -> str:
    return f"substr({url}, strpos({url}, '://') + 3)"


def _host(url: str) -> str:
    return f"translate(regexp_extract({_rest(url)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"


def _path(url: str) -> str:
    return f"regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1)"


def _node(url: str) -> str:
    host = rf"regexp_replace({_host(url)}, '\.?(:80|:443|:)?$', '')"
    return (f"CASE WHEN strpos({url}, '://') > 0 AND {host} <> '' THEN {host} || CASE WHEN {_path(url)} = '' THEN '/' ELSE {_path(url)} END "
            rf"|| regexp_extract({_rest(url)}, '^[^?#]*(\?[^#]*)', 1) END")


def _attribute(name: str) -> str:
    got = rf"""regexp_extract(tag, '[\x20\x09-\x0D"''/]{name}{_VALUE}', 1, 'i')"""
    value = rf"""CASE WHEN regexp_matches({got}, '^["'']') THEN substr({got}, 2, length({got}) - 2) ELSE {got} END"""
    return rf"replace(trim(regexp_replace({value}, '[\x09-\x0D]', ' ', 'g')), '&amp;', '&')"


# targets are resolved if they are absolute or relative to the site
_OP11 = rf"""
WITH RECURSIVE rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN {_host('url')} ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN {_path('url')} ELSE '' END AS path, {_node('url')} AS node FROM pages),
tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_extract(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'),
    '<(script|style)[\x20\x09-\x0D>].*?</(script|style)', ' ', 'gis'), '^(.*?)(<body[\x20\x09-\x0D>/]|$)', 1, 'is'),
    '<(?:link|meta)[\x20\x09-\x0D/][^>]*>', 0, 'i')) AS tag
  FROM p WHERE url IS NOT NULL AND regexp_matches(html, 'canonical|http-equiv', 'i')),
named AS (
  SELECT url, {_attribute('href')} AS target FROM tags
  WHERE regexp_matches(tag, '^<link', 'i') AND list_contains(string_split_regex(lower({_attribute('rel')}), ' +'), 'canonical')
  UNION ALL
  SELECT url, regexp_extract({_attribute('content')}, '^[0-9.]*{_S}*[;,]{_S}*url{_S}*={_S}*["'']?([^"'']*)', 1, 'i') AS target FROM tags
  WHERE regexp_matches(tag, '^<meta', 'i') AND lower({_attribute('http-equiv')}) = 'refresh'),
targets AS (
  SELECT url, CASE WHEN regexp_matches(target, '^https?://[^/?#]', 'i') THEN target
    WHEN regexp_matches(target, '^/([^/]|$)') AND strpos(url, '://') > 0 THEN regexp_extract(url, '^[^:/?#]*://[^/?#]*') || target END AS target
  FROM named WHERE target <> ''),
links AS (SELECT DISTINCT url, target, {_node('url')} AS a, {_node('target')} AS b FROM targets WHERE target IS NOT NULL),
nodes AS (
  SELECT host, path, node FROM p WHERE node IS NOT NULL
  UNION SELECT {_host('target')}, {_path('target')}, b FROM links WHERE b IS NOT NULL),
fit AS (
  SELECT DISTINCT n.host, n.path, r.host || r.path AS rule, r.verdict
  FROM (SELECT DISTINCT host, path FROM nodes) n JOIN rules r
    ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)),
judged AS (
  SELECT host, path, rule, verdict FROM fit
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, verdict <> 'allow', rule) = 1),
blocked(node) AS (
  SELECT node FROM nodes JOIN judged USING (host, path) WHERE verdict = 'block'
  UNION
  SELECT l.other FROM blocked k JOIN (SELECT a AS node, b AS other FROM links UNION SELECT b, a FROM links) l ON l.node = k.node)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN p.node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN judged j ON p.host = j.host AND p.path = j.path
"""

_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
tf AS (
  SELECT row, lang, source, term, count(*) AS n
  FROM (SELECT row, lang, source, unnest({_words('text', r'[\x00-\x40\x5B-\x60\x7B-\x7F]+')}) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM tf GROUP BY lang, term HAVING count(*) >= 10),
counts AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM tf SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (
  SELECT g.lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.lang_n), 0)::HUGEINT AS lang_total
  FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k ON k.lang = g.lang GROUP BY g.lang),
totals AS (
  SELECT g.lang, g.source, v, lang_total, coalesce(t.total, 0)::HUGEINT AS total
  FROM groups g JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t USING (lang, source)),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (t.total + 2 * v) AS p,
    1 + (1000000000 * (lang_n + 2)) // (lang_total + 2 * v) AS q
  FROM totals t JOIN kept k ON k.lang = t.lang LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _crc32(octets: str) -> str:
    """Unsigned CRC-32 of a list of octets (BIGINT), in two steps of four bits each."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ 0xEDB88320 if n & 1 else n >> 1
        table.append(f"{n}::BIGINT")

    def four(v: str) -> str:
        return f"xor(list_extract([{', '.join(table)}], (({v}) & 15) + 1), ({v}) >> 4)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, o: {four(four('xor(c, o)'))}), 4294967295::BIGINT)"


_HEX = "'0123456789ABCDEF'"
_OP7 = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, source, (octet_length(encode(text)) + 8)::BIGINT AS size,
  list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: (strpos({_HEX}, h[1]) * 16 + strpos({_HEX}, h[2]) - 17)::BIGINT) AS octets FROM t),
d AS (SELECT doc_id, source, size, {_crc32('octets')} AS text_crc32 FROM b),
k AS (SELECT *, md5('7|' || coalesce(doc_id::VARCHAR, '-') || '|' || text_crc32) AS key, coalesce('=' || source, 'null') AS stratum FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), stratum, r) - 1 AS pos, count(*) OVER () AS rows FROM r),
s AS (SELECT *, (pos * 24) // rows AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (pos - (shard * rows + 23) // 24)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard FROM s
"""

ORACLE: dict[str, str] = {"op3_jaccard_join": _OP3, "op4_warc": _OP4, "op5_decontamination": _OP5, "op7_sharding": _OP7,
                          "op11_url_filters": _OP11, "op12_source_divergence": _OP12}
