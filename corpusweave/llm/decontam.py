"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item gives one test string for each run of ``window`` consecutive
words (an item of fewer words, but not none, is one shorter test string). Test
strings of one length m share a shift table: for a block of two adjacent
document words it holds how far the search may jump before any test string can
end; a block in no test string allows a jump of m - 1 words. Where the shift
is 0, the block pair at both ends of the window picks a bucket of test
strings, and only a direct comparison of all words makes a hit.

Documents are streamed through the search in place: no shuffle. The items are
split into blocks of about ``BLOCK_BYTES`` of text; one block at a time is
collected, broadcast and searched against all documents, so what is broadcast
stays bounded however large the benchmark is.

Defined results: null, empty or wordless texts have no words and no hits; null
or wordless items match nothing; repeated items and ids count once; a null
item id is written as "null". Extra columns pass through unless named like a
result column. Empty tables give no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes

WINDOW = 13
#: Text of the items that one pass searches for.
BLOCK_BYTES = 2 << 20
#: A document is contaminated if so many of its words (1 in 20) are hit.
SHARE = 20
RESULT = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
#: Bytes that belong to words (0-9, a-z, all beyond ASCII) stay, A-Z become lower case, all others separate words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


class Search:
    """Test strings of all lengths, with their shift and bucket tables (made on first use)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.items, self.window, self._tables = items, window, None

    def __getstate__(self):
        return {"items": self.items, "window": self.window, "_tables": None}

    def tables(self) -> list[tuple]:
        if self._tables is None:
            made: dict[int, tuple[dict, dict]] = {}
            for item, text in self.items:
                ws = words(text)
                m = min(self.window, len(ws))
                if not m:
                    continue
                shift, buckets = made.setdefault(m, ({}, defaultdict(list)))
                b = min(2, m)
                for start in range(len(ws) - m + 1):
                    for end in range(b, m + 1):
                        block = tuple(ws[start + end - b:start + end])
                        if shift.get(block, m) > m - end:
                            shift[block] = m - end
                    buckets[(*ws[start:start + b], *ws[start + m - b:start + m])].append((ws, start, item))
            self._tables = [(m, *made[m]) for m in sorted(made)]
        return self._tables

    def find(self, ws: list[bytes], hit: bytearray) -> set[str]:
        """Mark the hit words in ``hit``; return the ids of the items found."""
        found: set[str] = set()
        n = len(ws)
        for m, shift, buckets in self.tables():
            b = min(2, m)
            end, jump = m, m - b + 1
            while end <= n:
                step = shift.get(tuple(ws[end - b:end]), jump)
                if step:
                    end += step
                    continue
                first = end - m
                for item_words, start, item in buckets.get((*ws[first:first + b], *ws[end - b:end]), ()):
                    if item_words[start:start + m] == ws[first:end]:
                        found.add(item)
                        hit[first:end] = b"\x01" * m
                end += 1
        return found


def _spans(hit: bytearray) -> list[dict]:
    out, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out.append({"start": at, "end": end})
        at = hit.find(1, end)
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``block_bytes`` of text, dealt by a hash of id and text."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t.encode()) for r in block.distinct().collect()]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _search_block(df: DataFrame, search, text_col: str) -> DataFrame:
    """One pass: adds the block's items to ``items`` and its hits to ``spans``."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            n_words, items, spans = [], [], []
            for text, had, old in zip(as_bytes(batch.column(text_col)), batch.column("items").to_pylist(), batch.column("spans").to_pylist()):
                ws = words(text)
                hit = bytearray(len(ws))
                found = search.value.find(ws, hit)
                if found and old:
                    for s in old:
                        hit[s["start"]:s["end"]] = b"\x01" * (s["end"] - s["start"])
                n_words.append(len(ws))
                items.append(sorted(found.union(had)) if found else had)
                spans.append(_spans(hit) if found else old)
            new = {"n_words": n_words, "items": items, "spans": spans}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema], schema=batch.schema)
    return df.mapInArrow(run, df.schema)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (ids as sorted strings), spans (of hit words) and contaminated."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in RESULT]
    df = docs.select(*own, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"),
                     F.array().cast(_SPANS).alias("spans"))
    df = spark.createDataFrame([], df.schema).union(df)  # the schema's nullability, as Arrow returns it
    searched = False
    for block in item_blocks(items, item_id, item_text) if not items.isEmpty() else ():
        df, searched = _search_block(df, spark.sparkContext.broadcast(Search(block, window)), text_col), True
    if not searched:  # nothing to search for: the words are still counted
        df = _search_block(df, spark.sparkContext.broadcast(Search([], window)), text_col)
    return df.withColumns({
        "n_hit": F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]),
        "n_items": F.size("items").cast("long"),
    }).withColumn("contaminated", F.expr(f"n_hit > 0 AND {SHARE} * n_hit >= n_words")).select(*own, *RESULT)
