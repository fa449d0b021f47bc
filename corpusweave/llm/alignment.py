"""Cross-tokenizer alignment by galloping intersection of token ends.

Two tokenizers cut the same bytes (a space and the text) into tokens. The
places where both end a token cut the text into groups; inside a group every
pair of tokens whose byte ranges overlap is a link.

``common_ends`` intersects the two sorted lists of ends: the shorter list
drives, an exponential search from the last match and a binary search inside
the found range locate each of its ends in the longer one. The common indices
slice both lists into groups, and the ranks of an end among the other side's
ends give each token's range of overlapping partners.

Neither tokenizer has a token that runs from a character that is no white
space over a following space (byte-level pre-tokens cannot; ``Pair`` checks
the piece vocabulary), so texts are cut there into words, both
encoders see each distinct word once, and a worker remembers what it aligned.
The memory is bounded: of two generations the older one goes; long words are not remembered.

How many rows hold an id pair linked is counted from one row per (task, pair).
A pair table of at most ``BROADCAST_ROWS`` rows goes to the tasks as sorted
arrays; a larger one (vocabularies bound it only by their product) is joined by
a shuffle. Both give the same rows.

Defined results: null and empty texts, and those whose tokens of either side
do not join to space + text again (a piece's U+2581 cannot be told from a
space), have no tokens: counts 0 and groups ''. Repeated rows and rows with
a null id count as rows of their own. Very long texts and words are aligned
whole. Empty tables give empty results. Extra columns pass through ``keep``;
one that is named like a result column is refused.
"""

from __future__ import annotations

import re
from array import array
from collections import ChainMap
from itertools import accumulate, chain
from struct import Struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

#: Words of one generation of a worker's memory (it keeps two), and the longest of them in characters.
MEMO, MEMO_CHARS = 200_000, 64
#: Pairs a task counts before it hands them on.
PAIRS = 1 << 21
#: A table of at most so many pairs is broadcast (17 bytes each).
BROADCAST_ROWS = 2_000_000
SPACE_MARK = "▁"
#: A space between two characters that are no white space (U+180E was white space in older Unicode).
_CUT = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")
_COUNTS = Struct("<qqq")
_WORKER: dict = {}

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def gallop(values: list, wanted: int, start: int) -> int:
    """First index from ``start`` whose value is at least ``wanted``: exponential, then binary search."""
    n, step = len(values), 1
    low = high = start
    while high < n and values[high] < wanted:
        low, high = high + 1, high + step
        step *= 2
    high = min(high, n)
    while low < high:
        middle = (low + high) // 2
        if values[middle] < wanted:
            low = middle + 1
        else:
            high = middle
    return low


def common_ends(a: list, b: list) -> list[tuple[int, int]]:
    """Indices (i, j) with a[i] == b[j], for strictly rising lists."""
    if len(a) > len(b):
        return [(i, j) for j, i in common_ends(b, a)]
    found, j, n = [], 0, len(b)
    for i, end in enumerate(a):
        if j < n and b[j] < end:
            j = gallop(b, end, j + 1)
        if j == n:
            break
        if b[j] == end:
            found.append((i, j))
    return found


def partners(a: list, b: list, begin: int = 0) -> list[tuple[int, int]]:
    """For every token of ``a`` the half-open range of ``b`` tokens that overlap it (both cut the same bytes, from ``begin``)."""
    out, first = [], 0
    for end in a:
        # tokens of b that end after this one's begin, up to the one that reaches its end
        first = gallop(b, begin + 1, first)
        out.append((first, gallop(b, end, first) + 1))
        begin = end
    return out


def align(a_ids: list, b_ids: list, a_ends: list, b_ends: list) -> tuple[list, list]:
    """Groups, as (ids of a, ids of b), and links, as (id of a, id of b)."""
    groups, links, p, q, begin = [], [], 0, 0, 0
    for i, j in common_ends(a_ends, b_ends):
        x, y = a_ids[p:i + 1], b_ids[q:j + 1]
        groups.append((x, y))
        if i == p or j == q:  # one token on a side meets all of the other's
            links += [(a, b) for a in x for b in y]
        else:
            ranges = partners(a_ends[p:i + 1], b_ends[q:j + 1], begin)
            links += [(a, b) for a, (lo, hi) in zip(x, ranges) for b in y[lo:hi]]
        p, q, begin = i + 1, j + 1, a_ends[i]
    return groups, links


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level tokenizers write bytes: visible ones stand for themselves, others follow from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Pair:
    """Both tokenizers and the bytes of their tokens, with the remembered words of a worker."""

    def __init__(self, a_path: str, b_path: str):
        import os

        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        self.a_bytes = {}
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            if all(c in alphabet for c in token):
                self.a_bytes[i] = bytes(map(alphabet.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        #: an id pair as one number: a * width + b
        self.width = len(pieces)
        self.a_lengths, self.b_lengths = {i: len(x) for i, x in self.a_bytes.items()}, list(map(len, self.b_bytes))
        self.names = list(map(str, range(max(self.width, max(self.a_bytes) + 1))))
        # words may be encoded apart if no piece runs over the start of the next word
        self.cut = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        # two generations: what is asked for again outlives the other words
        self.memo: dict = {}
        self.older: dict = {}

    def words(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cut else [text]

    def _aligned(self, word: str, a_ids: list, b_ids: list):
        """Packed links, groups as text and the packed counts of tokens and groups of a word; None if the tokens are not its bytes."""
        whole = b" " + word.encode()
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != whole or b"".join(map(self.b_bytes.__getitem__, b_ids)) != whole:
            return None
        groups, links = align(a_ids, b_ids, list(accumulate(map(self.a_lengths.__getitem__, a_ids))),
                              list(accumulate(map(self.b_lengths.__getitem__, b_ids))))
        name, width = self.names.__getitem__, self.width
        text = ";".join([f"{','.join(map(name, x))}|{','.join(map(name, y))}" for x, y in groups])
        return array("q", [i * width + j for i, j in links]).tobytes(), text, _COUNTS.pack(len(a_ids), len(b_ids), len(groups))

    def look_up(self, texts: list[str]) -> list[list]:
        """For each text what its words gave."""
        split = [self.words(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = set(chain.from_iterable(split)).difference(memo)
        memo.update({w: older[w] for w in new.intersection(older)})
        new, long = list(new.difference(memo)), {}
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            encoded = self.a.encode_batch_fast([" " + w for w in some], add_special_tokens=False)
            for w, e, b_ids in zip(some, encoded, self.b.encode(some, num_threads=1)):
                (memo if len(w) <= MEMO_CHARS else long)[w] = self._aligned(w, e.ids, b_ids)
        find = ChainMap(memo, long).__getitem__ if long else memo.__getitem__
        return [list(map(find, words)) for words in split]

    @staticmethod
    def of(a_path: str, b_path: str) -> Pair:
        if (a_path, b_path) not in _WORKER:
            _WORKER[a_path, b_path] = Pair(a_path, b_path)
        return _WORKER[a_path, b_path]


def _slices(batch, column: int, size: int = 4 << 20):
    """The batch in pieces of about ``size`` text bytes (one row at least)."""
    import pyarrow.compute as pc
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, k in enumerate(n):
        if held and held + k > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += k + 64
    if batch.num_rows:
        yield batch.slice(start)


def aligned(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with

    * n_a, n_b, n_groups, n_links: tokens of either side, groups and links,
    * groups: the groups as text, ids of one group ``a1,a2|b1``, groups joined by ``;``,
    * pairs, times: the row's distinct id pairs (as packed 64-bit numbers ``a * width + b``) and how often each is linked.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    keep = docs.columns if keep is None else keep
    result = [*COUNTS, "groups", "pairs", "times"]
    clash = [c for c in keep if c.lower() in result]
    if clash:
        raise ValueError(f"columns {clash} are named like results")
    rows = docs.select(*keep, F.col(text_col).alias("_aligned_text"))
    kinds = docs.select(*keep).withColumns({**{c: F.lit(0).cast("long") for c in COUNTS}, "groups": F.lit(""), "pairs": F.lit(b""),
                                            "times": F.lit(b"")}).schema
    schema = to_arrow_schema(kinds)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        pair = Pair.of(a_path, b_path)
        empty = (0, 0, 0, 0, "", b"", b"")
        for batch in batches:
            for some in _slices(batch, batch.num_columns - 1):
                texts = [t or "" for t in some.column(some.num_columns - 1).to_pylist()]
                out = []
                for text, got in zip(texts, pair.look_up(texts)):
                    if not text or None in got:
                        out.append(empty)
                        continue
                    links = np.frombuffer(b"".join([g[0] for g in got]), np.int64)
                    counts = np.frombuffer(b"".join([g[2] for g in got]), np.int64).reshape(-1, 3).sum(0).tolist()
                    codes, times = np.unique(links, return_counts=True)
                    out.append((*counts, len(links), ";".join([g[1] for g in got]), codes.tobytes(), times.astype(np.int32).tobytes()))
                new = [pa.array(x, f.type) for x, f in zip(zip(*out), list(schema)[len(keep):])]
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(some.columns[:-1], schema)], *new], schema=schema)
    return rows.mapInArrow(run, kinds)


def width(b_path: str) -> int:
    """The number by which ``pairs`` tell the two ids of a pair apart."""
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, documents, best) for every id pair: the rows of ``aligned`` that hold it linked, and whether that is its A id's highest."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        held, n = [], 0

        def flush():
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], names=["pair", "documents"])
        for batch in batches:
            for x in batch.column(0):
                codes = np.frombuffer(x.as_buffer(), np.int64)
                held.append(codes)
                n += len(codes)
                if n >= PAIRS:
                    yield flush()
                    held, n = [], 0
            held = [np.concatenate(held)] if held else []  # no views of earlier batches
        if held:
            yield flush()
    counts = rows.select("pairs").mapInArrow(run, "pair long, documents long").groupBy("pair").agg(F.sum("documents").alias("documents"))
    counts = shared_table(counts, "pair-counts")
    a = F.expr(f"pair div {width}")
    highest = counts.groupBy(a.alias("a")).agg(F.max("documents").alias("highest"))
    return counts.join(highest, a == F.col("a")).select("pair", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def _with_broadcast(rows: DataFrame, counts: DataFrame) -> DataFrame:
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_schema
    table = counts.orderBy("pair").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "documents", "best")))
    own = [c for c in rows.columns if c not in ("pairs", "times")]
    kinds = rows.select(*own).withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}).schema
    schema = to_arrow_schema(kinds)

    def run(batches):
        import pyarrow as pa
        pair, documents, best = sent.value
        for batch in batches:
            got = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(batch.num_columns - 2)]
            sizes = np.array([len(x) for x in got])
            row = np.repeat(np.arange(len(got)), sizes)
            at = np.searchsorted(pair, np.concatenate(got)) if len(got) else row
            times = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(batch.num_columns - 1)] or [row]).astype(np.int64)
            total, top = np.zeros(len(got), np.int64), np.zeros(len(got), np.int64)
            if len(at):
                np.add.at(total, row, documents[at] * times)
                np.add.at(top, row, best[at] * times)
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(batch.columns[:-2], schema)], pa.array(top), pa.array(total)], schema=schema)
    return rows.select(*own, "pairs", "times").mapInArrow(run, kinds)


def _with_join(rows: DataFrame, counts: DataFrame) -> DataFrame:
    numbered = shared_table(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned-rows")

    def unpack(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for row, pairs, times in zip(*batch.columns):
                codes = np.frombuffer(pairs.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), row.as_py())), pa.array(codes),
                                                  pa.array(np.frombuffer(times.as_buffer(), np.int32).astype(np.int64))], names=["_row", "pair", "k"])
    links = numbered.select("_row", "pairs", "times").mapInArrow(unpack, "_row long, pair long, k long")
    sums = links.join(counts, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("documents") * F.col("k")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return numbered.drop("pairs", "times").join(sums, "_row", "left").drop("_row").withColumns(
        {"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})


def link_scores(rows: DataFrame, width: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds to the rows of ``aligned`` (written, as they are read twice) n_best, the links whose pair is its A id's most
    frequent one, and count_sum, the sum of the links' pair counts; ``pairs`` and ``times`` go."""
    counts = shared_table(pair_counts(rows, width), "pairs")
    few = counts.limit(broadcast_rows + 1).count() <= broadcast_rows
    return (_with_broadcast if few else _with_join)(rows, counts)
