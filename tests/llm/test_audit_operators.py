"""URL filters, source divergence and token alignment against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusweave.llm import alignment, divergence, queries, urls
from corpusweave.llm.oracle import ORACLE

from . import fixtures as X

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")

# --- URL filters ----------------------------------------------------------------------------------


def head(tags, rest=""):
    return f"<!DOCTYPE html><HTML><head><title>t</title>{tags}</head><BODY class=x>{rest}</body></html>"


PAGES = [
    (1, "https://A.example.org/x?q=1", head('<link rel="canonical" href="https://b.spam.net/page">')),  # its target is blocked, though never crawled
    (2, "http://c.example.org:80/y#top", head("<LINK HREF='/z' REL='Canonical'>")),                    # relative; 2 - z - 3 - 4
    (3, "https://c.example.org/z", head('<meta http-equiv="Refresh" content="0; URL=\'https://example.com/de/1\'">')),
    (4, "https://example.com/de/1", None),                                                              # blocked by a rule
    (5, "https://c.example.org/fr/1", head('<link href="https://example.com/de/1" rel="canonical">')),  # explicit allow, blocked alias
    (6, "https://d.example.org/1", head("<!-- <link rel=canonical href=https://x.net/> -->")),           # in a comment
    (7, "https://d.example.org/2", head("", '<link rel="canonical" href="https://x.net/">')),            # in the body
    (8, "https://d.example.org/3", head('<script>"<link rel=canonical href=https://x.net/>"</script>')),  # in a script
    (9, "https://d.example.org/4", head('<link rel="stylesheet" href="https://x.net/">')),
    (10, "https://d.example.org/5", head('<link rel=canonical href="javascript:void(0)"><link rel=canonical href="">')),
    (11, "https://www.example.net/en/1?a=1&b=2", ""),                                                   # allowed by the longer rule
    (12, "https://www.example.net/fr/1", ""), (13, "https://mynet/x", ""), (14, "https://x.net", ""), (15, None, head('<link rel=canonical href=https://x.net/>')),
    (16, "no scheme", head("")), (17, "", ""), (None, "https://c.example.org/y", ""), (2, "http://c.example.org:80/y#top", head("")),
    (18, "https://e.example.org/deep/1?x=1&y=2", head('<link rel="alternate canonical" href="/deep/1?x=1&amp;y=3">')),
    (19, "https://e.example.org/deep/1?x=1&y=3", head('<meta content="5;url=https://spam.net/" http-equiv=refresh>')),
    (20, "ftp://f.example.org/a/b", head('<link rel=canonical href="//g.example.org/c">')), (21, "https://g.example.org/c", head("<link rel=canonical href=https://spam.net/>")),
]


def plain_verdicts(pages, links):
    rules = [(r[0], r[1], r[2]) for r in queries.URL_RULES]

    def parts(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group().translate(X.LOWER)
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        bare = re.sub(r"\.?(:80|:443|:)?$", "", host)
        return host, path, bare + (rest[len(host):].split("#")[0] if path else "/" + rest[len(host):].split("#")[0]) if bare else None

    def rule(host, path):
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)
    near = defaultdict(set)
    for a, b in links:
        x, y = parts(a)[2], parts(b)[2]
        near[x].add(y)
        near[y].add(x)
    every = [u for _, u, _ in pages] + [u for link in links for u in link]
    todo = [parts(u)[2] for u in every if rule(*parts(u)[:2])[1] == "block"]
    blocked = set(todo)
    while todo:
        for n in near[todo.pop()] - blocked:
            blocked.add(n)
            todo.append(n)
    out = []
    for i, u, _ in pages:
        host, path, node = parts(u)
        r, v = rule(host, path)
        out.append((i, host, path, r, v or ("block" if node in blocked else "allow")))
    return Counter(out)


LINKS = [(PAGES[0][1], "https://b.spam.net/page"), (PAGES[1][1], "http://c.example.org:80/z"), (PAGES[2][1], "https://example.com/de/1"),
         (PAGES[4][1], "https://example.com/de/1"), ("https://e.example.org/deep/1?x=1&y=2", "https://e.example.org/deep/1?x=1&y=3"),
         ("https://e.example.org/deep/1?x=1&y=3", "https://spam.net/"), ("ftp://f.example.org/a/b", "ftp://g.example.org/c"),
         ("https://g.example.org/c", "https://spam.net/")]


def pages_df(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_url_verdicts_equal_plain_version(spark):
    got = urls.url_verdicts(pages_df(spark), urls.rules(spark, queries.URL_RULES), keep=["page_id"])
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    rows = Counter(tuple(r) for r in got.collect())
    assert rows == plain_verdicts(PAGES, LINKS)
    verdict = {r[0]: r[4] for r in rows}
    assert [verdict[i] for i in (1, 2, 3, 4, 18, 19, 20)] == ["block"] * 7
    assert [verdict[i] for i in (5, 6, 7, 8, 9, 10, 11, 15, 16)] == ["allow"] * 9


def test_url_links_are_resolved(spark):
    assert {tuple(r) for r in urls.page_links(pages_df(spark)).collect()} == set(LINKS)
    relative = [("p", "https://h.org/a/p"), ("./p", "https://h.org/a/p"), ("?k=1", "https://h.org/a/b?k=1"), ("#f", "https://h.org/a/b"),
                ("//o.org", "https://o.org"), ("/r", "https://h.org/r"), ("mailto:x", None), ("//", None), ("HTTP://o.org/x", "HTTP://o.org/x")]
    df = spark.createDataFrame([("https://h.org/a/b?c#d", t) for t, _ in relative], "source string, target string")
    assert {r.target for r in urls.resolved(df).collect()} == {t for _, t in relative if t}


def test_url_sql_equals_query(spark, tmp_path):
    pages_df(spark).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(tuple(r) for r in queries.op11_url_filters(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    # the SQL resolves absolute and site-relative targets only
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet') WHERE coalesce(page_id, 0) NOT IN (20, 21)")
    assert Counter({r: n for r, n in got.items() if r[0] not in (20, 21)}) == Counter(con.execute(ORACLE["op11_url_filters"]).fetchall())


def test_url_redirect_table_chains_and_ties(spark):
    n = 60  # a chain of redirects and a hub that half of all pages name
    rows = [(i, f"https://p{i}.org/1", None, "own") for i in range(n)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, node string")
    steps = [(f"https://p{i}.org/1", f"https://p{i + 1}.org/1") for i in range(30)] + [(f"https://p{i}.org/1", "https://hub.org/") for i in range(31, n)]
    steps += [("https://p30.org/1", "https://spam.net/"), (None, "https://spam.net/"), ("https://p31.org/1", None), ("x", "y")]
    got = urls.url_verdicts(pages, urls.rules(spark, queries.URL_RULES), spark.createDataFrame(steps, "source string, target string"))
    assert got.columns == ["page_id", "url", "node", "host", "path", "rule", "verdict"]
    assert Counter((r.page_id, r.node, r.verdict) for r in got.collect()) == Counter({(i, "own", "block" if i <= 30 else "allow"): 2 for i in range(n)})
    # equally long rules: allow first
    tie = urls.rules(spark, [("b.org", "/", "block"), ("org", "/1bc", "allow"), ("b.org", "/1", "block"), ("org", "/1bcd", "block")])
    one = spark.createDataFrame([(1, "https://b.org/1bc")], "page_id long, url string")
    assert [tuple(r) for r in urls.url_verdicts(one, tie, html=None, keep=[]).collect()] == [("b.org", "/1bc", "org/1bc", "allow")]


def test_url_empty_and_clashing(spark):
    rules = urls.rules(spark, queries.URL_RULES)
    assert urls.url_verdicts(pages_df(spark).limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        urls.url_verdicts(pages_df(spark).withColumn("Host", F.lit(1)), rules)
    assert urls.url_verdicts(pages_df(spark), rules.limit(0), keep=["page_id"]).where("rule IS NOT NULL OR verdict != 'allow'").count() == 0


# --- source divergence ----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, least=10):
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(X.LOWER))
        groups[lang, source].update(found)
        df[lang].update(set(found))
    out = Counter()
    for lang in df:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        own = {s: {t: groups[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}

        def shares(counts):
            n = sum(counts.values())
            return {t: 1 + 1_000_000_000 * (c + 2) // (n + 2 * len(kept)) for t, c in counts.items()}
        p = {s: shares(own[s]) for s in sources}
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 10)):
                for rank, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top], 1):
                    out[lang, s, part, item, v, rank] += 1
    return out


def divergence_rows():
    import random
    rng = random.Random(12)
    words = ["the", "Élan", "über", "a", "data", "zoo", "日本", "it", "x", "rare", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = []
    for i in range(160):
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", None, ""])
        text = " ".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(["", ".", "1", "'s", "\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "EN", "de", None]), source, text))
    rows += [("en", "only-nulls", None), ("xx", "a", "no term is kept"), ("xx", "b", ""), ("yy", "single", "x " * 20), ("en", "s0", "It " * 30_000), rows[3], rows[3]]
    rows += [("tie", s, "one two three") for s in ("a", "b", "c") for _ in range(5)]
    return rows


@pytest.mark.parametrize("shard_rows", [200_000, 7])
def test_divergence_equals_plain_version(spark, shard_rows):
    rows = divergence_rows()
    # columns named like results and internals are not read
    docs = spark.createDataFrame([(i, *r, 1, "v") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n long, value string")
    got = Counter(tuple(r) for r in divergence.divergence(docs.repartition(5), shard_rows=shard_rows).collect())
    assert got == plain_divergence(rows)


def test_divergence_small_cells_and_partials(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(divergence, "CELLS", 8)
    counts = pa.table({"source": ["a", "b", "a", "c", "b"], "term": ["x", "x", "y", "z", "w"], "n": [5, 1, 3, 2, 9], "lang_n": [6, 6, 3, 2, 9]})
    groups = pa.table({"source": ["a", "b", "c", "d"], "total": [8, 10, 2, 0], "lang_total": [20] * 4, "terms": [6] * 4})
    small = [c.to_pylist() for c in divergence._shard(counts, groups)]
    monkeypatch.undo()
    assert small == [c.to_pylist() for c in divergence._shard(counts, groups)]
    # the number of terms that either source has
    assert {(s, i): n for s, p, i, _, n in zip(*small) if p == "pair"}["a", "b"] == 3
    text = pa.array(["B b a", "", "a", "É é"])
    t = divergence._merged([divergence._partial(pa.array(["l"] * 4), pa.array(["s", "s", "s", "u"]), text)] * 2).to_pylist()
    assert {(r["source"], r["term"]): (r["n"], r["df"]) for r in t} == {
        ("s", "b"): (4, 2), ("s", "a"): (4, 4), ("u", "É"): (2, 2), ("u", "é"): (2, 2), ("s", ""): (0, 0), ("u", ""): (0, 0)}


def test_divergence_shares_are_exact():
    import random
    rng = random.Random(1)
    for _ in range(300):
        n, v = rng.randint(0, 10 ** rng.randint(1, 15)), rng.randint(1, 10 ** 6)
        c = rng.randint(0, n)
        assert int(divergence.shares([c], n, v)[0]) == 1 + 1_000_000_000 * (c + 2) // (n + 2 * v)


def test_divergence_empty(spark):
    assert divergence.divergence(X.documents(spark).limit(0)).count() == 0


# --- token alignment ------------------------------------------------------------------------------

risen = st.lists(st.integers(1, 60), unique=True, max_size=30).map(sorted)


@given(risen, risen)
@settings(max_examples=300, deadline=None)
def test_common_ends_equal_plain_version(a, b):
    assert sorted(alignment.common_ends(a, b)) == [(a.index(x), b.index(x)) for x in a if x in b]


@given(st.integers(1, 50), st.data())
@settings(max_examples=300, deadline=None)
def test_groups_and_links_equal_plain_version(n, data):
    a, b = ([*data.draw(st.lists(st.integers(1, n), unique=True).map(sorted))] for _ in "ab")
    a, b = (sorted({*x, n}) for x in (a, b))
    groups, links = alignment.align(list(range(len(a))), list(range(len(b))), a, b)
    spans = lambda e: list(zip([0, *e], e))
    assert links == [(i, j) for i, (s, t) in enumerate(spans(a)) for j, (u, v) in enumerate(spans(b)) if max(s, u) < min(t, v)]
    shared = sorted(set(a) & set(b))
    assert groups == [([i for i, x in enumerate(a) if lo < x <= hi], [j for j, x in enumerate(b) if lo < x <= hi]) for lo, hi in zip([0, *shared], shared)]


AWKWARD = ["a  b ", " a\tb\n", "  ", "\n", "a▁b", "x ▁y", "<s> </s> <|endoftext|> <0x0A>", "ﬁn\xa0é　z", "\U0001f600\U0001f468‍\U0001f469 naïve", "don't I'll 's",
           "a\r\n b", "x" * 3000, "1 2  3   4", "a ᠎ b", "tab\t end \t", "日本語 テキスト", "\x00\x01 \x7f", "é \x85 y", "word " * 500]


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    rows = []
    for text in texts:
        row = {"a": [], "b": [], "groups": [], "links": []}
        rows.append(row)
        if not text:
            continue
        a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
        xa = [bytes(chars[c] for c in ta.id_to_token(i)) for i in a]
        xb = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
            continue
        row.update(a=a, b=b)
        i = j = p = q = u = v = 0  # two pointers over the bytes
        while i < len(a):
            row["links"].append((a[i], b[j]))
            ea, eb = u + len(xa[i]), v + len(xb[j])
            if ea <= eb:
                i, u = i + 1, ea
            if eb <= ea:
                j, v = j + 1, eb
            if ea == eb:
                row["groups"].append(f"{','.join(map(str, a[p:i]))}|{','.join(map(str, b[q:j]))}")
                p, q = i, j
    count = Counter(x for r in rows for x in set(r["links"]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(len(r["a"]), len(r["b"]), len(r["groups"]), len(r["links"]), ";".join(r["groups"]),
             sum(count[x] == best[x[0]] for x in r["links"]), sum(count[x] for x in r["links"])) for r in rows]


@pytest.mark.parametrize("broadcast_rows", [alignment.BROADCAST_ROWS, 0])
def test_alignment_equals_plain_version(spark, broadcast_rows):
    texts = [*X.texts(), *AWKWARD, *AWKWARD[:4]]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pair string").repartition(4)
    rows = alignment.aligned(docs, A, B, keep=["doc_id", "text", "pair"]).checkpoint()
    got = alignment.link_scores(rows, alignment.width(B), broadcast_rows)
    wanted = Counter((i if i % 9 else None, t, "x", *w) for i, (t, w) in enumerate(zip(texts, plain_alignment(texts))))
    assert Counter(tuple(r) for r in got.collect()) == wanted
    assert any(not w[3] for w in wanted if w[1] == "a▁b") and all(w[3] for w in wanted if w[1] == "a  b ")


def test_alignment_query_and_empty(spark, tmp_path):
    texts = X.texts()
    X.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", *alignment.COUNTS, "groups_sha256", "n_best", "count_sum"]
    every = [*texts, texts[5], texts[4]]
    wanted = Counter((i, *w[:4], hashlib.sha256(w[4].encode()).hexdigest() if w[4] else "", *w[5:])
                     for i, w in zip([*range(len(texts)), None, 4], plain_alignment(every)))
    assert Counter(tuple(r) for r in got.collect()) == wanted
    nothing = alignment.aligned(X.documents(spark).limit(0), A, B, keep=["doc_id"]).checkpoint()
    for limit in (0, 10):
        assert alignment.link_scores(nothing, 32000, limit).count() == 0
    with pytest.raises(ValueError):
        alignment.aligned(X.documents(spark).withColumn("Pairs", F.lit(1)), A, B)


@given(st.text(alphabet=st.sampled_from(" \t\n\xa0᠎​  　\x85\x1cabé▁'s1.,<>日"), max_size=25))
@settings(max_examples=200, deadline=None)
def test_words_apart_equal_whole_texts(text):
    pair = alignment.Pair.of(A, B)
    got = pair.look_up([text])[0]
    wanted = plain_alignment([text])[0]
    if not text:
        return
    assert (";".join(g[1] for g in got) if None not in got else "") == wanted[4]
