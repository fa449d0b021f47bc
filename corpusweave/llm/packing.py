"""Token ids as Arrow stream files of equal-length sequences and masks.

Every file is one Arrow IPC stream: record batches with ``ids`` and ``mask``,
both fixed-size lists of ``LENGTH`` values without nulls, so sequence i lies at
a fixed place and is read without copying (``sequence``). The file's two masks
are stored once, as a dictionary. The documents of a
file follow each other without gaps; the file's last sequence is padded (mask
0). The schema's metadata names the file's place in the order and the id
and token count of each of its documents.

Documents are range-partitioned and sorted by id; a task writes its range as
files of about ``FILE_TOKENS`` tokens (a document is never cut). Spark's own
writer commits them, so a lost executor leaves no half-written or double
files, on any file system. Starts of documents come from running sums over
files and ranges, never from a global sort of documents.

Defined results: null texts are empty documents (just the end id); null ids
come first; documents of equal id follow each other in either order; empty
tables give no documents. Only id and text are stored: extra columns stay behind.
"""

from __future__ import annotations

import json
from array import array
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, shared_path

LENGTH = 2048
FILE_TOKENS = 1 << 20
#: Words a worker remembers at most.
MEMO = 800_000
_WORKER: dict = {}


class WordEncoder:
    """Encodes texts word by word (words end at ASCII white space) with the tokenizers library, in its default form:
    a special token's string in a text becomes that token.

    Right for tokenizers that lower-case, drop white space and keep letters
    apart from marks (``tests`` compare it with the library over whole texts)."""

    MARKS = (b".", b",")

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        # texts that may hold a special token's string are encoded whole, as the library alone knows how it cuts them
        self.whole = [t.content.encode()[:2].lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[bytes, bytes] = {}  # ids as packed numbers of this code

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text, packed."""
        code = self.code
        lowered = [(t or b"").lower() for t in texts]
        whole = {i for i, t in enumerate(lowered) if any(mark in t for mark in self.whole)}
        split = [[] if i in whole else t.split() for i, t in enumerate(lowered)]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = set(chain.from_iterable(split)).difference(memo)
        # a mark after an ASCII letter is a piece of its own: "word," is "word" and ","
        marked = {w for w in new if w[-1:] in self.MARKS and w[-2:-1].isalpha()}
        plain = list(new.difference(marked).union(w[:-1] for w in marked).union(w[-1:] for w in marked).difference(memo))
        for at in range(0, len(plain), 50_000):
            some = plain[at:at + 50_000]
            memo.update(zip(some, [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]))
        for w in marked:
            memo[w] = memo[w[:-1]] + memo[w[-1:]]
        return [array(code, self.tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids).tobytes() if i in whole
                else b"".join(map(memo.__getitem__, ws)) for i, ws in enumerate(split)]

    @staticmethod
    def of(path: str) -> WordEncoder:
        if path not in _WORKER:
            _WORKER[path] = WordEncoder(path)
        return _WORKER[path]


def stream_file(docs: list, ids, length: int, order: tuple[int, int]) -> bytes:
    """One file: ``docs`` are (id, tokens) pairs, ``ids`` all their tokens."""
    import numpy as np
    import pyarrow as pa
    n = len(ids)
    rows = -(-n // length)
    padded = np.zeros(rows * length, ids.dtype)
    padded[:n] = ids
    # only two masks occur in a file, that of full sequences and the last one's: stored once each, a byte a value (bits could
    # not be read without copying)
    masks = pa.array(np.concatenate([np.ones(length, np.uint8), (np.arange((rows - 1) * length, rows * length) < n).astype(np.uint8)]))
    which = np.zeros(rows, np.int32)
    which[-1:] = 1
    arrays = [pa.FixedSizeListArray.from_arrays(pa.array(padded), length),
              pa.DictionaryArray.from_arrays(pa.array(which), pa.FixedSizeListArray.from_arrays(masks, length))]
    fields = [pa.field(k, a.type, nullable=False) for k, a in zip(("ids", "mask"), arrays)]
    schema = pa.schema(fields, metadata={"order": json.dumps(order), "documents": json.dumps(docs)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema))
    return sink.getvalue().to_pybytes()


def sequence(source, i: int):
    """Ids and mask (1 for a token, 0 for padding) of sequence ``i``, without copying either. ``source``: a path (memory-mapped) or bytes."""
    import pyarrow as pa
    stream = pa.ipc.open_stream(pa.memory_map(source) if isinstance(source, str) else pa.BufferReader(source))
    for batch in stream:
        if i < batch.num_rows:
            ids, mask = batch.column(0), batch.column(1)
            length = ids.type.list_size
            part = lambda x, at: x.flatten().slice(at * length, length).to_numpy(zero_copy_only=True)
            return part(ids, i), part(mask.dictionary, mask.indices[i].as_py())
        i -= batch.num_rows
    raise IndexError(i)


def write_packed(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocab_size: int, id_col: str = "doc_id",
                 text_col: str = "text", length: int = LENGTH, file_tokens: int = FILE_TOKENS) -> None:
    """Encode ``docs`` and write the files below ``path`` in ascending id order."""
    kind = "uint16" if vocab_size <= 1 << 16 else "uint32"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        part, chunk, held, waiting, n = TaskContext.get().partitionId(), 0, [], [], 0
        encoder = WordEncoder.of(tokenizer_path)
        packed = np.dtype(encoder.code)
        end = np.array([end_id], packed).tobytes()

        def flush():
            ids = np.frombuffer(b"".join(waiting), packed).astype(kind, copy=False)
            return pa.RecordBatch.from_pylist([{"file": stream_file(held, ids, length, (part, chunk))}])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                for doc, ids in zip(some.column(0).to_pylist(), encoder.encode(as_bytes(some.column(1)))):
                    tokens = len(ids) // packed.itemsize + 1
                    held.append([doc, tokens])
                    waiting += (ids, end)
                    n += tokens
                    if n >= file_tokens:
                        yield flush()
                        chunk, held, waiting, n = chunk + 1, [], [], 0
        if held:
            yield flush()

    ordered = docs.select(id_col, text_col).repartitionByRange(F.asc_nulls_first(id_col)).sortWithinPartitions(F.asc_nulls_first(id_col))
    # bytes pass through the text writer unchanged; one row is one file, and a stream ends before the writer's final newline
    (ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).text(path))


def read_packed(spark, path: str, id_type: str = "long") -> DataFrame:
    """One row per stored document: id, file order (part, chunk), place, first token in the file, and tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = spark.createDataFrame([], f"id {id_type}, part int, chunk int, place int, first long, ids binary").schema
    schema = to_arrow_schema(kinds)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for content in batch.column(0):
                if not len(content.as_buffer()):
                    continue
                stream = pa.ipc.open_stream(pa.BufferReader(content.as_buffer()))
                part, chunk = json.loads(stream.schema.metadata[b"order"])
                docs = json.loads(stream.schema.metadata[b"documents"])
                got = list(stream)
                flat = np.concatenate([b.column(0).flatten().to_numpy() for b in got])
                used = 0
                for b in got:
                    sums = b.column(1).dictionary.flatten().to_numpy().reshape(-1, b.column(0).type.list_size).sum(1, dtype=np.int64)
                    used += int(sums[b.column(1).indices.to_numpy()].sum())
                ends = np.cumsum([n for _, n in docs])
                if int(ends[-1]) != used:
                    raise ValueError(f"file {part}, {chunk}: the mask and the documents disagree")
                ids = np.split(flat[:ends[-1]].astype("<u4"), ends[:-1])
                columns = {"id": [d for d, _ in docs], "part": [part] * len(docs), "chunk": [chunk] * len(docs), "place": range(len(docs)),
                           "first": [int(e) - n for e, (_, n) in zip(ends, docs)], "ids": [x.tobytes() for x in ids]}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, kinds)


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: tokens of all documents before this one. ``rows`` have part, chunk, first and n_tokens."""
    files = rows.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("_n"))
    parts = files.groupBy("part").agg(F.sum("_n").alias("_part_n"))
    so_far = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_part_n").over(so_far), F.lit(0)).alias("_part_start"))
    in_part = W.partitionBy("part").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("part", "chunk", F.coalesce(F.sum("_n").over(in_part), F.lit(0)).alias("_file_start")).join(parts, "part")
    return rows.join(files, ["part", "chunk"]).withColumn("start", F.col("_part_start") + F.col("_file_start") + F.col("first"))


def packed_documents(docs: DataFrame, tokenizer_path: str, end_id: int, vocab_size: int, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Write, read back, and return (id, start, n_tokens, ids) for each document; ids as little-endian 32-bit bytes."""
    spark = docs.sparkSession
    path = shared_path(spark, "packed")
    write_packed(docs, path, tokenizer_path, end_id, vocab_size, id_col, text_col)
    return read_packed(spark, path, docs.schema[id_col].dataType.simpleString())
