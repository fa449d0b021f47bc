"""Exact top-k against numpy brute force; hybrid ranking rules."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.operators import retrieve as R
from corpusweave.operators import vectors as V


def brute_topk(q, c, k):
    out = {}
    for qi, qv in q.items():
        ds = []
        for ci, cv in c.items():
            qd, cd = qv.astype(np.float64), cv.astype(np.float64)
            nq, nc = np.linalg.norm(qd), np.linalg.norm(cd)
            d = None if nq == 0 or nc == 0 else 1.0 - float(np.dot(qd, cd)) / (nq * nc)
            ds.append((d is None, d if d is not None else 0.0, ci))
        ds.sort()
        out[qi] = [(ci, None if isnull else d) for isnull, d, ci in ds[:k]]
    return out


def test_semantic_topk_blocks_ties_and_zero_vectors(spark):
    rng = np.random.default_rng(5)
    c = {i: rng.normal(size=8).astype(np.float32) for i in range(60)}
    c[7] = c[3].copy()            # exact tie: broken by chunk id
    c[11] = np.zeros(8, np.float32)  # zero vector: null distance, sorted last
    q = {100 + i: rng.normal(size=8).astype(np.float32) for i in range(9)}
    q[200] = np.zeros(8, np.float32)
    qdf = spark.createDataFrame([(k, v.tolist()) for k, v in q.items()], "query_id long, embedding array<float>")
    cdf = spark.createDataFrame([(k, v.tolist()) for k, v in c.items()], "chunk_id long, embedding array<float>")
    want = brute_topk(q, c, 5)
    for q_rows, c_rows, clusters in [(2048, 65536, None), (3, 16, 1), (4, 5, 7)]:
        got = {}
        for r in V.semantic_topk(qdf, cdf, k=5, q_rows=q_rows, c_rows=c_rows, clusters=clusters).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["distance"]))
        for qi in q:
            have = [(cid, d) for _, cid, d in sorted(got[qi])]
            assert [h[0] for h in have] == [w[0] for w in want[qi]]
            for (_, hd), (_, wd) in zip(have, want[qi]):
                assert (hd is None and wd is None) or abs(hd - wd) < 1e-9


def test_embedder_is_deterministic_and_normalised(spark):
    df = spark.createDataFrame([(1, "def parse_file(path): return open(path)"), (2, ""), (3, None)],
                               "id long, text string")
    rows = {r["id"]: r["embedding"] for r in V.embed_texts(df, "text").collect()}
    assert abs(np.linalg.norm(rows[1]) - 1.0) < 1e-5
    assert np.linalg.norm(rows[2]) == 0.0 and len(rows[3]) == 256
    again = {r["id"]: r["embedding"] for r in V.embed_texts(df, "text").collect()}
    assert rows[1] == again[1]


def test_hybrid_retrieve_rules(spark):
    # 4 chunks; query closest to c1; graph c1 - c2 - c3, c4 isolated
    vecs = {"c1": [1.0, 0.0], "c2": [0.0, 1.0], "c3": [-1.0, 0.1], "c4": [0.7, 0.7]}
    v = spark.createDataFrame([(k, x) for k, x in vecs.items()], "chunk_id string, embedding array<float>")
    meta = spark.createDataFrame([(k, "s" + k[1:]) for k in vecs], "chunk_id string, symbol_id string")
    syms = spark.createDataFrame([("s" + k[1:], k) for k in vecs], "symbol_id string, chunk_id string")
    edges = spark.createDataFrame([("s1", "s2"), ("s2", "s3")], "src string, dst string")
    q = spark.createDataFrame([(1, [1.0, 0.05])], "query_id long, embedding array<float>")
    hits = R.hybrid_retrieve(q, v, meta, syms, edges, k=2).orderBy("rank").collect()
    assert [(h["chunk_id"], h["source"]) for h in hits] == [("c1", "semantic"), ("c4", "semantic"),
                                                            ("c2", "graph"), ("c3", "graph")]
    assert [round(h["score"], 6) for h in hits] == [1.0, 1.0, 0.8, 0.6]
    # Q9: an index without chunk ids in the symbol table returns no graph chunks
    none = syms.withColumn("chunk_id", F.lit(None).cast("string"))
    hits2 = R.hybrid_retrieve(q, v, meta, none, edges, k=2).collect()
    assert {h["source"] for h in hits2} == {"semantic"}


def _frames(spark, q, c):
    kind = "long, embedding array<float>"
    return (spark.createDataFrame([(k, None if v is None else v.tolist()) for k, v in q.items()], f"query_id {kind}"),
            spark.createDataFrame([(k, None if v is None else v.tolist()) for k, v in c.items()], f"chunk_id {kind}"))


def test_topk_skips_clusters_exactly(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(6, 16)) * 4
    c = {i: (middle[i % 6 if i % 3 else 0] + rng.normal(size=16) * 0.3).astype(np.float32) for i in range(900)}  # a third and more in one cluster
    c |= {1000 + i: c[0].copy() for i in range(40)}  # copies: ties by id over slices
    q = {i: (middle[i % 6] + rng.normal(size=16) * 0.3).astype(np.float32) for i in range(40)} | {99: c[0].copy()}
    want = brute_topk(q, c, 7)
    got = {}
    qdf, cdf = _frames(spark, q, c)
    for r in V.semantic_topk(qdf, cdf, k=7, q_rows=16, c_rows=50, clusters=12).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: [x for x, _ in v] for k, v in want.items()}
    # by the bounds most clusters are skipped whole
    centres = V._unit(np.array([c[i] for i in range(0, 36, 3)] + [c[i] for i in range(1, 30)], np.float64))
    ids = cdf.withColumnRenamed("chunk_id", "id").withColumnRenamed("embedding", "vec")
    dealt = V._assign(ids, centres).toPandas().groupby("cluster").agg(n=("id", "count"), widest=("angle", "max"))
    sizes, widest = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    sizes[dealt.index], widest[dealt.index] = dealt.n, dealt.widest
    bound = spark.createDataFrame([(k, v.tolist(), float(1 - want[k][-1][1])) for k, v in q.items()], "id long, vec array<float>, bound double")
    visits = V._visits(bound, centres, widest, sizes, 7, True).count()
    assert visits < 0.6 * len(q) * len(centres)


def test_topk_few_null_and_empty_vectors(spark):
    one = np.ones(4, np.float32)
    for q, c in (({1: one, 2: None}, {5: None, 6: one, 7: np.zeros(4, np.float32)}), ({1: one}, {}), ({}, {1: one}), ({1: None}, {2: None})):
        qdf, cdf = _frames(spark, q, c)
        got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["distance"]) for r in V.semantic_topk(qdf, cdf, k=3).collect())
        zero = lambda v: v is None or not np.any(v)
        want = []
        for i, v in q.items():
            order = sorted((zero(v) or zero(w), j) for j, w in c.items())[:3]
            want += [(i, n, j, None if null else 0.0) for n, (null, j) in enumerate(order, 1)]
        assert [(a, b, x, d if d is None else round(abs(d), 9)) for a, b, x, d in got] == sorted(want)


def plain_features(text, dim):
    """Weights by bucket, token by token."""
    import re
    import zlib
    out = {}
    for token in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\x00-\x20\x7FA-Za-z0-9_]", text or ""):
        parts = []
        if re.match("[A-Za-z_]", token):
            parts = [p for piece in re.split("_+", token) for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", piece)]
        for f in [token] + (parts if len(parts) > 1 else []):
            h = zlib.crc32("".join(c.lower() if c < "\x80" else c for c in f).encode())
            out[h % dim] = out.get(h % dim, 0) + (-1 if h >> 31 else 1)
    return out


def test_native_embedder_equals_plain_features(spark):
    texts = {1: "def parseHTTPFile(self_path, x2Y): return os.getpid() + 17", 2: "", 3: None, 4: " \n\t\x00\x7f ",
             5: "É 漢字 😀 naïve x", 6: "a_b ABc ABCDe AAaBBb __init__ _ " * 3, 7: "word_%d " * 20_000, 8: "same", 9: "same",
             10: " ".join(f"name{i}" for i in range(5000))}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("token", F.lit(1)).withColumn("bucket", F.lit(2))
    for dim in (16, 256):
        got = {r["id"]: np.array(r["embedding"]) for r in V.embed_native(df, "id", "text", dim).collect()}
        assert set(got) == set(texts)
        for i, t in texts.items():
            want = np.zeros(dim)
            for b, w in plain_features(t, dim).items():
                want[b] = w
            norm = np.linalg.norm(want)
            assert np.allclose(got[i], want / norm if norm else want, atol=1e-6), (dim, i)
    assert not got[2].any() and not got[3].any() and not got[4].any() and (got[8] == got[9]).all()
    empty = V.embed_native(df.where("id < 0"), "id", "text")
    assert empty.collect() == [] and empty.schema["embedding"].dataType.simpleString() == "array<float>"


def test_native_embedder_stays_on_the_jvm(spark):
    plan = V.embed_native(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_positions_equal_a_plain_ranking_and_spread_a_hot_key(spark):
    from corpusweave.operators.segments import positions
    rows = [(None if i % 7 == 0 else ("hot" if i % 3 else f"k{i % 50}"), f"item{(i * 7919) % 4001:05d}") for i in range(4001)]
    df = spark.createDataFrame(rows, "key string, item string").withColumn("pos", F.lit("old"))
    want = {}
    for k, x in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.setdefault(k, []).append(x)
    for ranges in (None, 1, 8, 50):
        got = {}
        for r in positions(df, ["key"], ["item"], ranges=ranges).collect():
            assert r["n_rows"] == len(want[r["key"]])
            got.setdefault(r["key"], {})[r["pos"]] = r["item"]
        assert {k: [v[i] for i in range(1, len(v) + 1)] for k, v in got.items()} == want
    spread = df.repartitionByRange(8, "key", "item").where("key = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert spread > 2
    assert positions(df.where("item = ''"), ["key"], ["item"]).collect() == []
    twice = positions(spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None)], "key string, item string"), ["key"], ["item"]).collect()
    assert sorted((r["pos"], r["item"] or "") for r in twice) == [(1, ""), (2, "x"), (3, "x")]


def test_summary_items_hold_every_list(spark):
    hits = spark.createDataFrame([(1, 1, "c1", "s1", 1.0, "semantic"), (1, 2, "c2", None, 1.0, "semantic"), (1, 3, "c3", "s3", 0.8, "graph")],
                                 "query_id long, rank int, chunk_id string, symbol_id string, score double, source string")
    expanded = spark.createDataFrame([(1, 1, "s1", 1.0), (1, 2, "s3", 0.8)], "query_id long, rank int, symbol string, score double")
    related = spark.createDataFrame([(1, "dependency", "import b"), (1, "dependency", "import a"), (1, "dependency", "import a"),
                                     (2, "related", "x.py")], "query_id long, kind string, item string")
    got = sorted((r["query_id"], r["kind"], r["pos"], r["item"], r["score"]) for r in R.summary_items(hits, expanded, related).collect())
    assert got == [(1, "chunk", 1, "c1", 1.0), (1, "chunk", 2, "c2", 1.0), (1, "chunk", 3, "c3", 0.8),
                   (1, "dependency", 1, "import a", None), (1, "dependency", 2, "import b", None),
                   (1, "expanded", 1, "s1", 1.0), (1, "expanded", 2, "s3", 0.8),
                   (1, "seed", 1, "s1", 1.0), (1, "seed", 2, None, 1.0), (2, "related", 1, "x.py", None)]


def test_equal_similarities_are_compared_in_bounded_pieces(spark, monkeypatch):
    """Thousands of equal and of different but equally near vectors: a task holds few pairs at once, the smallest ids win."""
    import pyarrow as pa
    largest = []
    einsum = np.einsum
    monkeypatch.setattr(V, "BLOCK", 4096)
    monkeypatch.setattr(V.np, "einsum", lambda s, a, b: largest.append(a.size) or einsum(s, a, b))
    block = V._Block(3)
    block.add_queries(pa.record_batch({"id": pa.array(range(50)), "vec": pa.array([[1.0, 0.0, 0.0]] * 50),
                                       "bound": pa.array([None] * 49 + [0.9])}))
    angle = np.linspace(0, 6, 2000)
    for lo in (0, 1000):
        block.add_corpus(pa.record_batch({"id": pa.array([f"c{i:05d}" for i in range(lo, lo + 1000)]), "vec": pa.array(
            [[1.0, np.cos(a), np.sin(a)] for a in angle[lo:lo + 1000]])}))
        assert block.pending < 4096 + 4096
    kinds = pa.schema([("q", pa.int64()), ("c", pa.string()), ("sim", pa.float64())])
    got = block.result(kinds).to_pydict()
    assert max(largest) <= 4096 and sorted(set(got["query_id"])) == list(range(49))  # the last one's bound is out of reach
    assert len(got["sim"]) == 3 * 49 and np.allclose(got["sim"], 0.5 ** 0.5)

    batch = pa.record_batch({"id": pa.array([9, 4, None, 7, 1, 2]), "vec": pa.array([[1.0, 0.0]] * 5 + [[0.0, 1.0]])})
    assert V._few_copies(batch, 2)[0].column("id").to_pylist() == [None, 1, 2]


def test_semantic_topk_over_a_large_group_of_copies(spark):
    """Copies fill most of the table; every query still gets the k nearest, by id among equals, null ids first."""
    rng = np.random.default_rng(11)
    c = {i: rng.normal(size=4).astype(np.float32) for i in range(300)}
    c |= {i: c[5].copy() for i in range(1000, 1000 + 1500)}
    q = {i: (c[5] if i % 2 else rng.normal(size=4).astype(np.float32)) for i in range(40)}
    to_df = lambda m, key: spark.createDataFrame([(k, v.tolist()) for k, v in m.items()], f"{key} long, embedding array<float>")
    want = brute_topk(q, c, 6)
    for clusters in (1, 5):
        rows = V.semantic_topk(to_df(q, "query_id"), to_df(c, "chunk_id"), k=6, clusters=clusters).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == {i: [x for x, _ in w] for i, w in want.items()}


def test_queries_go_once_to_each_bin(spark, monkeypatch):
    """Where bounds skip nothing, a query is dealt to at most BINS groups however many clusters there are; the rows stay the same."""
    rng = np.random.default_rng(3)
    c = {i: rng.normal(size=24).astype(np.float32) for i in range(600)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in c.items()], "id long, embedding array<float>")
    sent, visitors = [], V._visitors
    monkeypatch.setattr(V, "BINS", 4)
    monkeypatch.setattr(V, "_visitors", lambda v: sent.append(visitors(v)) or sent[-1])
    rows = V.semantic_topk(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id"), k=5, clusters=40).collect()
    assert sum(sent[1].values()) > 4 * 600 >= sum(sent[-1].values()) and len(sent) == 3
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {i: [x for x, _ in w] for i, w in brute_topk(c, c, 5).items()}


def test_only_names_of_several_parts_are_cut(spark):
    """One word in one case (most of a text) costs one search; joined names, numbers and other characters keep their features."""
    from corpusweave.operators import vectors
    words = ["word", "Word", "WORD", "a", "A", "_", "__", "x9", "_9", "9", "123", "aB", "ABc", "HTTPServer", "snake_case", "_a", "É", "é", "ß", "İ", "-",
             "\u0080", "\u4e2d", "Aa1Bb", "AbcD"]
    df = spark.createDataFrame([(w, w) for w in words], "id string, text string")
    import re
    import zlib
    got = {(r["key"], r["bucket"]): r["weight"] for r in vectors.hash_features(df, "id", "text").collect()}
    want = {}
    for w in words:
        parts = re.findall("[A-Z]?[a-z]+|[A-Z]+|[0-9]+", re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", w)) if re.match("[A-Za-z_]", w) else []
        for f in [w, *(parts if len(parts) > 1 else [])]:
            f = f.lower() if f.isascii() else f
            h = zlib.crc32(f.encode())
            want[w, h % 256] = want.get((w, h % 256), 0) + (-1 if h >> 31 else 1)
        assert bool(re.search(vectors._SEVERAL, w)) >= (len(parts) > 1)
        assert not re.search(vectors._SEVERAL, w) or not re.fullmatch("[A-Z]?[a-z]+|[A-Z]+|[0-9]+", w)
    assert got == want


def test_visits_are_sent_on_in_bounded_pieces(spark, monkeypatch):
    """A batch of queries that visits every cluster leaves the worker in pieces of at most BLOCK numbers."""
    import pyarrow as pa
    monkeypatch.setattr(V, "BLOCK", 40)
    made = []

    class Queries:
        schema = T.StructType([])
        select = lambda self, *c: self
        mapInArrow = lambda self, run, schema: made.append(run)
    centres = V._unit(np.random.default_rng(1).normal(size=(7, 4)))
    V._visits(Queries(), centres, np.full(7, 3.2), np.full(7, 100), 5, True)
    batch = pa.record_batch({"id": pa.array(range(9)), "vec": pa.array([[1.0, 2.0, 3.0, i] for i in range(9)]), "bound": pa.array([None] * 9, pa.float64())})
    out = list(made[0]([batch]))
    assert max(b.num_rows for b in out) == 10 and sum(b.num_rows for b in out) == 9 * 6  # all but the first cluster of each


def test_source_text_and_ids_are_not_broadcast(spark, tmp_path):
    """Spark took their size from compressed files: 360,000 source files from 1.6 MB were a broadcast of 157 MB that the driver built."""
    from corpusweave.operators import graph as G
    from corpusweave.operators import prompts as P
    from corpusweave.operators import retrieve as R

    def kept(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))
    chunks = kept([(f"c{i}", f"a{i}.py", i, i, "x") for i in range(4)], "chunk_id string, path string, start_line int, end_line int, content string", "chunks")
    imports = kept([(f"a{i}.py", 0, f"import a{i + 1}") for i in range(4)], "path string, pos int, import_text string", "imports")
    edges = kept([(f"n{i}", f"n{i + 1}") for i in range(4)], "src string, dst string", "edges")
    hits = kept([(1, 1, "c0", "n0", 1.0, "semantic", 0.1, None)],
                "query_id long, rank int, chunk_id string, symbol_id string, score double, source string, distance double, hop int", "hits")
    sources = kept([(f"a{i}.py", b"x") for i in range(4)], "path string, content binary", "sources")
    asked = kept([(1, "a1.py")], "query_id long, path string", "asked")
    expanded = G.graph_expand(hits.select("query_id", F.col("symbol_id").alias("symbol")), edges)
    related = G.dependencies_of(imports, asked.select("path").distinct())
    files = P.gather_full_files(asked, sources)
    listed = R.retrieval_summary(hits, spark.createDataFrame([], expanded.schema), G.related_files(imports, asked).limit(0), chunks).select("query_id", "chunks")
    for df in (expanded, related, files, listed):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan, plan
    assert sorted(r.symbol for r in expanded.collect()) == ["n0", "n1", "n2"]
    assert [r.import_text for r in related.collect()] == ["import a2"] and [r.path for r in files.collect()] == ["a1.py"]
