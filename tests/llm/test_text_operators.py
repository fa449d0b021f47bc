"""Decontamination, BPE, token files, language model and their numpy parts against plain versions."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusweave.llm import bpe, gru, language_model, packing
from corpusweave.llm.decontam import Search, decontaminate, words as plain_words

from . import fixtures as X


def vocab():
    return bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_equals_tiktoken_and_round_trips(spark):
    import tiktoken
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    docs = X.documents(spark).withColumn("ids", F.lit("clash"))
    rows = bpe.decode(bpe.encode(docs, vocab()), vocab()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == plain.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(docs.limit(0), vocab()).count() == 0


def test_perfect_hash_is_minimal_and_rejects_others():
    v = vocab()
    assert sorted(v.hash.index(t) for t in v.tokens) == list(range(len(v.tokens)))
    assert v.hash.index(b"no such entry at all") == -1
    # merging a whole vocabulary entry gives that entry wherever its merges reach it
    for t in v.tokens[300:4000:97]:
        assert b"".join(v.bytes_of[i] for i in v.merge(t)) == t


def test_token_files_equal_library_over_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    marks = ["a <|endoftext|> b", "a<|EndOfText|>b.", "<|startoftext|><|endoftext|>", "x <|start word, <|", "A " * 500 + "<|endoftext|>" + " É." * 500]
    docs = X.documents(spark, extra=[(2000 + i, t, "en", "s", 0, "own") for i, t in enumerate(marks)])
    assert tok.encode(marks[0], add_special_tokens=False).ids == [320, 49407, 321]
    rows = packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2, 49408)
    got = packing.with_starts(rows.withColumn("n_tokens", F.expr("octet_length(ids) div 4"))).collect()
    want = Counter((d.doc_id, np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d in docs.collect())
    assert Counter((r.id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)


def test_sequences_are_read_in_place(tmp_path):
    ids = np.arange(25, dtype=np.uint16)
    path = str(tmp_path / "f.arrow")
    with open(path, "wb") as f:
        f.write(packing.stream_file([[7, 25]], ids, 10, (0, 0)) + b"\n")
    got, mask = packing.sequence(path, 2)
    assert got.tolist() == [20, 21, 22, 23, 24, 0, 0, 0, 0, 0] and mask.tolist() == [1] * 5 + [0] * 5
    # views of the mapped file, not copies
    assert not got.flags.owndata and not mask.flags.owndata and not got.flags.writeable and not mask.flags.writeable
    with pytest.raises(IndexError):
        packing.sequence(path, 3)


def brute_hits(text, items):
    w, hit, found = plain_words(text.encode() if text else None), set(), set()
    for i, t in items:
        iw = plain_words(t.encode() if t else None)
        m = min(13, len(iw))
        for a in range(len(iw) - m + 1 if m else 0):
            for b in range(len(w) - m + 1):
                if w[b:b + m] == iw[a:a + m]:
                    hit |= set(range(b, b + m))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination_equals_brute_force_and_blocks_agree(spark, monkeypatch):
    ts = X.texts()
    items = [(1, " ".join(ts[4].split()[5:30])), (2, "loop the"), (3, None), (4, ""), (5, ts[8]), (6, "of odd spaces"), (6, ts[5])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = X.documents(spark).where("length(text) < 4000 OR text IS NULL").withColumn("items", F.lit("clash"))
    got = decontaminate(docs, bench)
    want = Counter((d.doc_id, *brute_hits(d.text, items)[:2], tuple(brute_hits(d.text, items)[2])) for d in docs.collect())
    key = lambda df: Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect())
    assert key(got) == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got.collect())
    import corpusweave.llm.decontam as D
    monkeypatch.setattr(D.item_blocks, "__defaults__", (64,))
    assert key(decontaminate(docs, bench)) == want
    assert key(decontaminate(docs, bench.limit(0))) == Counter((d.doc_id, len(plain_words((d.text or "").encode())), 0, ()) for d in docs.collect())
    assert Search([("1", b"a b c")]).find([b"a", b"b", b"c"], bytearray(3)) == {"1"}


@pytest.mark.parametrize("items", [[], [(1, None)], [(1, ""), (None, None)], [(1, " !? ")]])
def test_decontamination_counts_words_without_test_strings(spark, items):
    docs = X.documents(spark).where("length(text) < 4000 OR text IS NULL")
    got = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got.collect()) == Counter(
        (d.doc_id, len(plain_words((d.text or "").encode())), 0, False) for d in docs.collect())


def test_gru_gradient_and_normalisation():
    p = {k: v.astype(np.float64) for k, v in gru.start(64).items()}
    rng = np.random.Generator(np.random.PCG64(1))
    h = rng.standard_normal((7, gru.HIDDEN))
    # all words and the tail: probabilities sum to one
    total = sum(np.exp(gru.log_probs(p, h, np.full(7, y))) for y in range(65))
    assert np.allclose(total, 1)
    y = rng.integers(0, 65, 7)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    dh = gru._output_gradient(p, h, y, grad)
    loss = lambda: -gru.log_probs(p, h, y).mean()
    for name, at in (("c", (2, 1)), ("w", (int(min(y)), 3)), ("cb", (0,))):
        old, eps = p[name][at], 1e-5
        p[name][at] = old + eps
        up = loss()
        p[name][at] = old - eps
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-6
    h[3, 4] += 1e-5
    up = loss()
    h[3, 4] -= 2e-5
    assert abs((up - loss()) / 2e-5 - dh[3, 4]) < 1e-6


def test_gru_learns_and_carries_state():
    texts = [np.array([1, 2, 3, 0] * 40) for _ in range(64)]
    p = gru.start(32)
    before = gru.score(p, texts[:1])[0]
    state = gru.fresh_state(p)
    for _ in range(30):
        gru.train(p, state, texts)
    assert gru.score(p, texts[:1])[0] > before / 3
    # a batch with texts of other lengths gives each the same score as alone
    mixed = [np.array([5]), texts[0], np.array([], np.int64), np.array([1, 2])]
    assert np.allclose(gru.score(p, mixed), [gru.score(p, [t])[0] if len(t) else 0 for t in mixed], rtol=1e-4)


def test_lm_base_score_by_brute_force(spark):
    docs = X.documents(spark)
    rows = docs.collect()
    tokens = lambda t: [*X.words(t), "\n"]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for r in rows if not out(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = Counter((r.doc_id, out(r.doc_id), len(tokens(r.text)), sum(c[w] > 0 for w in tokens(r.text)), n,
                    round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r.text)), 6)) for r in rows)
    got = language_model.lm_scores(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_digests(spark):
    r = spark.createDataFrame([([1, 22],)], "ids array<int>").withColumn("decoded", F.lit(b"ab")).select(
        *[c.alias(k) for k, c in bpe.digests(None).items()]).first()
    assert (r.n_tokens, r.ids_sha256) == (2, hashlib.sha256(b"1,22").hexdigest())
    assert re.fullmatch("[0-9a-f]{64}", r.decoded_sha256) and base64


def test_frequent_words_are_cut_between_counts(spark):
    counts = spark.createDataFrame([(b"a", 5), (b"c", 3), (b"b", 3), (b"d", 1), (b"e", 1)], "word binary, c long")
    assert language_model.frequent_words(counts, 5) == [(b"a", 5), (b"b", 3), (b"c", 3), (b"d", 1), (b"e", 1)]
    assert language_model.frequent_words(counts, 4) == [(b"a", 5), (b"b", 3), (b"c", 3)]
    assert language_model.frequent_words(counts, 2) == [(b"a", 5)]
    assert language_model.frequent_words(counts.where("c < 5"), 1) == []
    assert language_model.frequent_words(counts.limit(0)) == []


def test_bpe_round_trip_in_one_pass(spark):
    """The same columns as encoding and decoding one after the other, with one Python node instead of two."""
    docs = spark.createDataFrame([(1, "Grüße an  alle\n\nhi", "x"), (2, "", None), (3, None, "y"), (None, "def f(x): return x", "z"), (1, "twice", "x")],
                                 "doc_id long, text string, more string")
    want = bpe.decode(bpe.encode(docs, vocab()).drop("text"), vocab())
    got = bpe.round_trip(docs, vocab())
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    import corpus_pipeline
    plan = corpus_pipeline.token_ids(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
