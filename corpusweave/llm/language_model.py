"""Language-model scoring of whole documents with a gated recurrent network.

1. Word counts over all training documents, on Spark (map-side combined).
2. Training: the network starts from weights fitted on ``START_DOCS`` documents;
   then every task (at most ``TRAINERS``) trains on all training documents of its
   partitions by truncated backpropagation, and the tasks' weights are averaged.
   In training the state starts anew every ``gru.SEGMENT`` tokens of a document
   (so one long document runs side by side with itself); in scoring it never does.
3. Scoring: whole documents, the state carried across windows; one row each.
4. Counts of rare words: words outside the at most ``FREQUENT`` most frequent
   ones (whose counts are broadcast, a table of bounded size) join the count
   table by a shuffle. No rare word can be a hot key: more than ``FREQUENT``
   words occur at least as often.

The model's probabilities sum to one over the training vocabulary and one
unknown word: words outside the network share the tail's probability in
proportion to count + 1. ``base_score`` is the add-one unigram score.

Defined results: a null or empty text is just its end token; null ids are in
fold 0; repeated rows count as often as they occur and get equal scores; an
empty table gives no rows; without training documents all words are unknown.
"""

from __future__ import annotations

import math
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import gru
from .common import as_bytes, fold, shared_table

FOLDS, HELD_OUT = 7, 2
#: Words of the network, words with broadcast counts, documents that give the first weights.
NETWORK, FREQUENT, START_DOCS = 1024, 50_000, 1500
#: Documents that a task holds at once, at most (and bytes of text).
HELD_DOCS, HELD_BYTES = 8192, 48 << 20
#: Models that are trained side by side, at most, and tasks that add their weights up before the driver does (a row each).
TRAINERS, SUMS = 16_384, 8
END = b"\n"  # no word holds white space


def words(text: bytes | None) -> list[bytes]:
    """The words and the end token."""
    out = (text or b"").lower().split()
    out.append(END)
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over a table with one text column."""
    def run(batches):
        from collections import Counter

        import pyarrow as pa
        seen: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                seen.update(words(text))
                if len(seen) > 400_000:
                    yield flush()
                    seen = Counter()
        if seen:
            yield flush()
    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """At most ``most`` words with their counts, the most frequent first: all that
    occur so often that no more than ``most`` words do. The limit comes from a
    table with one row per distinct count (about the root of the tokens), so
    no task sends its own best words to the driver."""
    sizes = counts.groupBy("c").agg(F.count("*").alias("words"))
    so_far = sizes.select("c", F.sum("words").over(W.orderBy(F.desc("c"))).alias("n"))
    least = so_far.where(F.col("n") <= most).agg(F.min("c")).first()[0]
    if least is None:
        return []
    return sorted(((bytes(r.word), r.c) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """The frequent words with their counts; the first ``k`` belong to the network."""

    def __init__(self, frequent: list[tuple[bytes, int]], n: int, v: int):
        import numpy as np
        self.number = {w: i for i, (w, _) in enumerate(frequent)}
        self.k = -(-min(NETWORK, max(1, len(frequent))) // gru.WIDTH) * gru.WIDTH
        self.log_count = np.log10(np.array([c for _, c in frequent] or [0], np.float64) + 1)
        inside = sum(c for _, c in frequent[:self.k])
        self.n, self.v = n, v
        self.log_base = math.log10(n + v + 1)
        self.log_tail = math.log10(n - inside + v - min(self.k, len(frequent)) + 1)

    def numbers(self, ws: list[bytes]):
        """The words' numbers; FREQUENT for a rare word."""
        import numpy as np
        return np.fromiter(map(self.number.get, ws, repeat(FREQUENT)), np.int32, len(ws))


def _held(batches, columns: int):
    """Lists of the first ``columns`` columns, of at most HELD_DOCS rows and about HELD_BYTES of text (the last column)."""
    rows, size = [[] for _ in range(columns)], 0
    for batch in batches:
        values = [batch.column(i).to_pylist() for i in range(columns - 1)] + [as_bytes(batch.column(columns - 1))]
        for row in zip(*values):
            for held, x in zip(rows, row):
                held.append(x)
            size += len(row[-1] or b"")
            if len(rows[0]) >= HELD_DOCS or size >= HELD_BYTES:
                yield rows
                rows, size = [[] for _ in range(columns)], 0
    if rows[0]:
        yield rows


def train(texts: DataFrame, first: list[bytes | None], vocab) -> dict:
    """Weights after one pass over ``texts`` (one column); ``first`` gives the weights that all tasks start from."""
    import numpy as np
    v = vocab.value
    p = gru.start(v.k)
    state = gru.fresh_state(p)
    gru.train(p, state, [v.numbers(words(t)) for t in first], batch=128)
    shared = texts.sparkSession.sparkContext.broadcast((gru.pack(p), gru.pack(state)))

    def run(batches):
        import pyarrow as pa
        v = vocab.value
        like = gru.start(v.k)
        p, state = (gru.unpack(x, like) for x in shared.value)
        n = 0
        for (rows,) in _held(batches, 1):
            for at in range(0, len(rows), 2048):
                some = [v.numbers(words(t)) for t in rows[at:at + 2048]]
                gru.train(p, state, some)
                n += sum(map(len, some))
        if n:
            # weighted by the tokens trained on, which stand last
            flat = np.append(gru.pack(p).astype(np.float64) * n, n)
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["weights"])

    def add(batches):
        import pyarrow as pa
        total = None
        for batch in batches:
            for flat in batch.column(0).to_pylist():
                total = np.frombuffer(flat) if total is None else total + np.frombuffer(flat)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["weights"])
    trained = texts.coalesce(TRAINERS).mapInArrow(run, "weights binary")
    sums = [np.frombuffer(r.weights) for r in trained.repartition(SUMS).mapInArrow(add, "weights binary").collect()]
    if not sums:
        return p
    flat = np.sum(sums, axis=0)
    return gru.unpack(flat[:-1] / flat[-1], p)


def _score(docs: DataFrame, vocab, weights) -> DataFrame:
    """One row per document: counts and scores without the rare words, and the rare words."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        v = vocab.value
        schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_tail", pa.int64()),
                            ("log_all", pa.float64()), ("log_tail", pa.float64()), ("network", pa.float64()), ("rare", pa.list_(pa.binary()))])
        for ids, held_out, texts in _held(batches, 3):
            numbers, rare = [], []
            for t in texts:
                ws = words(t)
                x = v.numbers(ws)
                numbers.append(x)
                rare.append([ws[i] for i in np.flatnonzero(x == FREQUENT).tolist()])
            size = np.array([len(x) for x in numbers])
            owner, flat = np.repeat(np.arange(len(size)), size), np.concatenate(numbers)
            known = flat < FREQUENT
            logs = np.where(known, v.log_count[np.minimum(flat, len(v.log_count) - 1)], 0.0)
            per = lambda x: np.bincount(owner, x, minlength=len(size))
            tail = flat >= v.k
            columns = [ids, held_out, size, per(known).astype(np.int64), per(tail).astype(np.int64), per(logs), per(logs * tail),
                       gru.score(weights.value, numbers) / math.log(10), rare]
            for at in range(0, len(size), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 1000], f.type) for c, f in zip(columns, schema)], schema=schema)
    return docs.mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, n_tail long, log_all double, log_tail double, "
                                "network double, rare array<binary>")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``; ids are whole numbers."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    training = docs.where("NOT held_out")
    counts = shared_table(count_words(training.select("text")), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    vocab = spark.sparkContext.broadcast(Vocabulary(frequent_words(counts), n, v))

    # a share of the hashes that about twice START_DOCS rows have; equal rows count once and are combined map-side
    pool = training.where("id IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("id", "text").alias("order"), "text")
    share = 2 * START_DOCS / max(1, training.where("id IS NOT NULL").count())
    begin = pool.where(F.pmod("order", F.lit(1 << 31)) < int(min(1.0, share) * (1 << 31))).groupBy("order").agg(F.first("text").alias("text"))
    first = [r.text.encode() for r in begin.orderBy("order").limit(START_DOCS).collect()]
    weights = spark.sparkContext.broadcast(train(training.select("text"), first, vocab))

    scored = shared_table(_score(docs, vocab, weights).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts, "word").groupBy("row").agg(
        F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare").join(rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_all") + more - F.col("n_tokens") * vocab.value.log_base).alias("base_score"),
        (F.col("network") + F.col("log_tail") + more - F.col("n_tail") * vocab.value.log_tail).alias("score"))
