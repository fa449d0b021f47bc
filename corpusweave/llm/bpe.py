"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves a pre-token
that is itself a vocabulary entry (the entry's bytes are compared, so a
foreign pre-token is never taken for a member). Second tier: other pre-tokens
are merged from single bytes in a doubly linked list, the next pair taken from
a heap ordered by (rank, position).

The vocabulary is a fixed file of ranks (its size, not the corpus's, bounds
what is broadcast). Texts are encoded where they are read: no shuffle. A
worker remembers up to ``MEMO`` pre-tokens and then starts afresh, so its
memory does not grow with the corpus.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows, null ids and very long texts are encoded like any other; extra
columns pass through unless they are named like the result column.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words, and pre-tokens, that a worker remembers at most.
MEMO_WORDS, MEMO = 150_000, 800_000
#: Keys per bucket of the perfect hash, on average.
_LOAD = 3


class PerfectHash:
    """Minimal perfect hash (hash and displace): n keys take n slots.

    Keys fall into buckets; buckets, largest first, get the smallest
    displacement that sends all their keys to free slots. A bucket of one key
    stores its slot directly, as -1 - slot."""

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.n_buckets = max(1, self.n // _LOAD)
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        hashed = [self._hash(k) for k in keys]
        for i, (b, _, _) in enumerate(hashed):
            buckets[b].append(i)
        self.shift = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * self.n
        self.values = [-1] * self.n
        taken = bytearray(self.n)
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:
                free = iter([s for s in range(self.n) if not taken[s]]) if free is None else free
                d, slots = None, [next(free)]
                self.shift[b] = -1 - slots[0]
            else:
                d = 0
                while True:
                    slots = [self._slot(hashed[i][1], hashed[i][2], d) for i in own]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            for i, s in zip(own, slots):
                taken[s], self.keys[s], self.values[s] = 1, keys[i], i

    def _hash(self, key: bytes) -> tuple[int, int, int]:
        import xxhash
        h = xxhash.xxh3_128_intdigest(key)
        return (h >> 96) % self.n_buckets, h & 0xFFFFFFFFFFFF, h >> 48 & 0xFFFFFFFFFFFF | 1

    def _slot(self, h: int, factor: int, d: int) -> int:
        return ((h + d * 0x9E3779B97F4A7C15) * factor >> 32 & 0xFFFFFFFF) % self.n

    def index(self, key: bytes) -> int:
        """The key's place in the list it was made from; -1 for any other key."""
        b, h, factor = self._hash(key)
        d = self.shift[b]
        slot = -1 - d if d < 0 else self._slot(h, factor, d)
        return self.values[slot] if self.keys[slot] == key else -1


class Vocabulary:
    """Ranks, the perfect hash over them, and the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = [ranks[t] for t in self.tokens]
        self.hash = PerfectHash(self.tokens)
        self.bytes_of = dict(zip(self.ids, self.tokens))
        self.id_of_byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.span = max(self.ids, default=0) + 1
        self.merged = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.merged[a * self.span + b] = rank
        self._words = None

    def __getstate__(self):
        return {**self.__dict__, "_words": None}

    def pre_token(self, token: bytes) -> tuple[int, ...]:
        i = self.hash.index(token)
        return (self.ids[i],) if i >= 0 else self.merge(token)

    def merge(self, token: bytes) -> tuple[int, ...]:
        """Merge the lowest rank first, the leftmost of equal ranks.

        Heap entries are rank * n + position; ``rank[i]`` is that of the pair
        that now starts at i, so an outdated entry is known by its rank."""
        ids = list(map(self.id_of_byte.__getitem__, token))
        if min(ids) < 0:
            raise ValueError("the vocabulary lacks a single byte")
        n, span, pair, pop, push = len(ids), self.span, self.merged.get, heapq.heappop, heapq.heappush
        rank = [pair(a * span + b, -1) for a, b in zip(ids, ids[1:])]
        heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
        rank.append(-1)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            new = pop(heap)
            i = new % n
            new //= n
            if rank[i] != new:
                continue
            j = after[i]
            k = after[j]
            ids[i], ids[j], rank[j], after[i] = new, -1, -1, k
            if k < n:
                before[k] = i
                rank[i] = r = pair(new * span + ids[k], -1)
                if r >= 0:
                    push(heap, r * n + i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                rank[h] = r = pair(ids[h] * span + new, -1)
                if r >= 0:
                    push(heap, r * n + h)
        return tuple([x for x in ids if x >= 0])

    def words(self) -> _Words:
        if self._words is None:
            self._words = _Words(self)
        return self._words


class _Words(dict):
    """Word -> ids as packed 32-bit numbers, made on demand. ``lead`` stands before every word."""

    def __init__(self, vocabulary: Vocabulary, lead: str = ""):
        import re

        import regex
        super().__init__()
        self.vocabulary, self.lead, self.split = vocabulary, lead, regex.compile(vocabulary.pattern).findall
        self.pre_tokens: dict[str, bytes] = {}
        if not lead:
            self.spaced = _Words(vocabulary, " ")
            self.spaced.pre_tokens = self.pre_tokens
            # white space next to a space: there a cut at every space could cut inside a match of the pattern
            self.risky = re.compile(r"\s | \s").search

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        out, known = b"", self.pre_tokens
        for p in self.split(self.lead + word):
            got = known.get(p)
            if got is None:
                got = array("i", self.vocabulary.pre_token(p.encode())).tobytes()
                if len(known) >= MEMO:
                    known.clear()
                if len(p) <= 64:
                    known[p] = got
            out += got
        if len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed. Words are cut before single spaces, where the pattern always starts a new match."""
        if not text:
            return b""
        if self.risky(text):
            return b"".join(map(self.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return (self[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file (made once per process)."""
    return Vocabulary(load_ranks(path), pattern)


def _add_columns(df: DataFrame, kinds: dict[str, T.DataType], run, without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns that ``run`` computes from Arrow batches, in one pass, less the columns ``without``."""
    new = {n.lower() for n in (*kinds, *without)}
    own = [c for c in df.columns if c.lower() not in new]
    schema = T.StructType([*(f for f in df.schema if f.name in own), *(T.StructField(n, k) for n, k in kinds.items())])

    def step(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *run(batch)], names=[*own, *kinds])
    return df.mapInArrow(step, schema)


IDS = T.ArrayType(T.IntegerType())


def _ids(texts, words: _Words):
    import numpy as np
    import pyarrow as pa
    ids = [words.encode(t) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _bytes(column, bytes_of: dict[int, bytes]):
    import numpy as np
    import pyarrow as pa
    token = bytes_of.__getitem__
    flat, ends = column.flatten().to_numpy(), np.cumsum(np.append(0, column.value_lengths().fill_null(0).to_numpy()))
    return pa.array([b"".join(map(token, flat[a:b].tolist())) for a, b in zip(ends, ends[1:])], pa.binary())


def encode(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the column ``out``: the ids of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    return _add_columns(docs, {out: IDS}, lambda batch: [_ids(batch.column(text_col), shared.value.words())])


def decode(df: DataFrame, vocab: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the column ``out``: the bytes that the ids stand for (null ids: no bytes)."""
    shared = df.sparkSession.sparkContext.broadcast(vocab.bytes_of)
    return _add_columns(df, {out: T.BinaryType()}, lambda batch: [_bytes(batch.column(ids_col), shared.value)])


def round_trip(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", out: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` without the text, in one pass: one after the other, each would hold a Python worker a task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batch):
        ids = _ids(batch.column(text_col), shared.value.words())
        return [ids, _bytes(ids, shared.value.bytes_of)]
    return _add_columns(docs, {out: IDS, decoded: T.BinaryType()}, run, (text_col,))


def digests(df: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> dict:
    """Columns n_tokens, ids_sha256 and decoded_sha256."""
    return {"n_tokens": F.size(ids_col).cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ","), 256),
            "decoded_sha256": F.sha2(F.col(decoded_col), 256)}
