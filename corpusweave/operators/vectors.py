"""V1-V3: embedding and exact cosine top-k.

V3 plan (exact, no all-pairs rows):
  * the corpus is dealt to clusters: a bounded sample of its vectors are the
    centres, every vector goes to its nearest one, and each cluster keeps the
    widest angle between its centre and a member;
  * every query first visits its nearest clusters, until they hold k vectors;
    its k-th best similarity there is a bound that no result can fall below;
  * by the triangle inequality of angles no member of a cluster is nearer to the
    query than angle(query, centre) - widest angle; clusters whose best possible
    similarity lies below the bound are skipped whole, the others are visited;
  * where the bounds skip little, so that queries visit more than ``BINS`` clusters
    on average, clusters are put together into that many bins, and a query goes
    once to each bin that it visits: copies grow with the input, not its square;
  * a visit meets blocks of queries with slices of a cluster. A query block
    (``q_rows``, by default as many as ``BLOCK`` numbers hold) stays in memory, a
    slice (``c_rows``) is streamed past it with a running best k, so queries are
    copied once for each slice and vectors once for each query block that visits
    their cluster; the bound goes along, and what lies below it is not sent on;
  * of equal vectors that meet in a batch only the k smallest ids are dealt;
  * only k rows per query leave a task; a ``row_number`` keeps the best k.
Memory per task is one query block, one batch and a bounded piece of their
product, however many similarities are equal. A cluster with a third of all
vectors is many slices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.config import TOP_K
from corpusweave.functions.vector import hash_embed
from corpusweave.session import materialize

#: Clusters at most, and vectors a cluster holds on average below that number; bins, and vectors that are worth a cluster of their own.
CLUSTERS, CLUSTER_ROWS, BINS, FEW_ROWS = 256, 4096, 16, 256
#: Similarities within this of a bound count as reaching it (rounding of the bounds).
SLACK = 1e-6
#: The same for two products of unit vectors in double precision.
ROUNDING = 1e-12
#: Numbers that a query block, a piece of a product, or the vectors of compared pairs hold at most; groups a visit is cut
#: into before its query blocks grow beyond ``LEAST_ROWS``; copied rows a task sorts.
BLOCK, GROUPS, LEAST_ROWS, TASK_ROWS = 1 << 22, 64, 2048, 200_000


def embedder_udf(embed: Callable[[list[str]], np.ndarray] = hash_embed):
    """V1/V2: wrap any batch embedder as an iterator pandas UDF.

    The model (or hashing table) is set up once per Python worker; Arrow
    batches (``spark.sql.execution.arrow.maxRecordsPerBatch``) are the batches.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            mat = embed(texts.fillna("").tolist())
            yield pd.Series(list(np.asarray(mat, dtype=np.float32)))

    return _embed


def embed_texts(df: DataFrame, text_col: str, out_col: str = "embedding",
                embed: Callable[[list[str]], np.ndarray] = hash_embed) -> DataFrame:
    """V1 (chunks) / V2 (queries): add an ``ARRAY<FLOAT>`` embedding column."""
    return df.withColumn(out_col, embedder_udf(embed)(F.col(text_col)))


#: Names, numbers, and every other visible character.
_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\x00-\x20\x7FA-Za-z0-9_]"
#: The parts of a name, once a blank stands where a run of capitals meets a capitalised word.
_JOINT, _PART = "([A-Z])([A-Z][a-z])", "[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
#: What a name of several parts contains; no number or other character does. Most names are one word and are not cut.
_SEVERAL = "_|[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]"


def hash_features(df: DataFrame, key: str, text_col: str, dim: int = 256) -> DataFrame:
    """(key, bucket, weight): signed feature hashing of each key's text, by DataFrame functions only.

    Features are the tokens of a text (A-Z lower-cased) and, for names of several snake or camel parts, those parts too. The
    CRC-32 of a feature names its bucket (modulo ``dim``) and its sign (the top bit: minus). Tasks add up before the shuffle,
    so a text of any length sends at most ``dim`` rows from a task. Null and empty texts, and texts without a token, keep
    one row with a null bucket and weight 0; rows of an equal key count as one text; buckets of weight 0 stay in."""
    tokens = df.select(F.col(key).alias("key"), F.explode_outer(F.regexp_extract_all(text_col, F.lit(_TOKEN), F.lit(0))).alias("token"))
    parts = F.when(F.col("token").rlike(_SEVERAL), F.regexp_extract_all(F.regexp_replace("token", _JOINT, "$1 $2"), F.lit(_PART), F.lit(0)))
    # a feature is ASCII as a whole or one other character, which stays as it is
    small = F.when(F.col("feature") < "\u0080", F.lower("feature")).otherwise(F.col("feature"))
    features = (tokens.withColumn("parts", parts)
                .select("key", F.explode(F.when(F.size("parts") > 1, F.concat(F.array("token"), "parts")).otherwise(F.array("token"))).alias("feature"))
                .select("key", F.crc32(small.cast("binary")).alias("h")))
    sign = F.when(F.col("h") >= 1 << 31, -1).when(F.col("h").isNotNull(), 1).otherwise(0)
    return features.groupBy("key", (F.col("h") % dim).cast("int").alias("bucket")).agg(F.sum(sign).alias("weight"))


def embed_native(df: DataFrame, key: str, text_col: str, dim: int = 256, out_col: str = "embedding") -> DataFrame:
    """V1 / V2 without Python: (key, embedding), one row per distinct key, the features of ``hash_features`` as a dense unit
    vector of floats. A text without weight has the zero vector. A key's group holds at most ``dim`` entries (and the null one)."""
    entry = F.when(F.col("weight") != 0, F.struct("bucket", "weight"))
    per = hash_features(df, key, text_col, dim).groupBy("key").agg(
        F.sort_array(F.collect_list(entry)).alias("entries"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    buckets = F.col("entries.bucket")
    earlier = F.concat(F.array(F.lit(-1)), buckets)  # one longer than the entries: the last starts the closing run of zeros
    zero = F.lit(0.0).cast("float")
    filled = F.zip_with("entries", F.slice(earlier, 1, F.size("entries")), lambda e, p: F.concat(
        F.array_repeat(zero, e["bucket"] - p - 1), F.array((e["weight"] / F.col("norm")).cast("float"))))
    closing = F.array_repeat(zero, F.lit(dim - 1) - F.element_at(earlier, -1))
    return per.select(F.col("key").alias(key), F.concat(F.flatten(filled), closing).alias(out_col))


def _matrix(column) -> np.ndarray:
    """An Arrow list column as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _is_zero() -> F.Column:
    """Null vectors and those without length have no direction."""
    return F.coalesce(~F.exists("vec", lambda x: x != 0), F.lit(True))


def _few_copies(batch, k: int):
    """The batch without rows that k rows of an equal vector and smaller ids (null first) precede: no result needs them."""
    import pyarrow as pa
    m = _matrix(batch.column("vec"))
    if len(m) <= k:
        return batch, m
    _, kind, copies = np.unique(m.view(np.dtype((np.void, m.shape[1] * m.itemsize))).ravel(), return_inverse=True, return_counts=True)
    if copies.max() <= k:
        return batch, m
    ids = batch.column("id").to_pylist()
    by_id = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])))
    order = by_id[np.argsort(kind[by_id], kind="stable")]
    nth = np.arange(len(order)) - np.repeat(np.cumsum(copies) - copies, copies)
    stay = np.sort(order[nth < k])
    return batch.take(pa.array(stay)), m[stay]


def _assign(df: DataFrame, centres: np.ndarray, k: int | None = None) -> DataFrame:
    """(id, vec) with the nearest centre and the angle to it; with ``k``, of many equal vectors only some (``_few_copies``)."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            b, m = _few_copies(b, k) if k else (b, _matrix(b.column("vec")))
            sim = _unit(m) @ centres.T
            best = sim.argmax(1)
            angle = np.arccos(np.clip(sim[np.arange(len(best)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(best.astype(np.int32)), pa.array(angle)],
                                             names=["id", "vec", "cluster", "angle"])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("angle", T.DoubleType())]))


def _visits(queries: DataFrame, centres: np.ndarray, widest: np.ndarray, sizes: np.ndarray, k: int, bounded: bool,
            bins: np.ndarray | None = None) -> DataFrame:
    """(id, vec, bound, cluster) for every cluster a query visits: its nearest ones until they hold k vectors or, with the
    column ``bound`` of what those gave (null: fewer than k), all others that may hold something as near. With ``bins``, the bin of every cluster, the
    bins of all clusters that may, the nearest ones too."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            sim = _unit(_matrix(b.column("vec"))) @ centres.T
            order = np.argsort(-sim, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            first = np.zeros(sim.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            if bounded:
                best = np.cos(np.maximum(np.arccos(np.clip(sim, -1, 1)) - widest, 0))
                bound = np.array([-2.0 if x is None else x for x in b.column("bound").to_pylist()])
                first = (best + SLACK >= bound[:, None]) & (~first if bins is None else True)
            first &= sizes > 0
            if bins is not None:
                first = np.stack([first[:, bins == i].any(1) for i in range(bins.max() + 1)], 1)
            row, cluster = np.nonzero(first)
            # in pieces: a query may visit every cluster
            piece = max(1, BLOCK // centres.shape[1])
            for lo in range(0, len(row), piece):
                at = pa.array(row[lo:lo + piece])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("id", "vec", "bound")),
                                                  pa.array(cluster[lo:lo + len(at)].astype(np.int32))], names=["id", "vec", "bound", "cluster"])
    return queries.select("id", "vec", "bound").mapInArrow(run, T.StructType([
        *queries.select("id", "vec", "bound").schema.fields, T.StructField("cluster", T.IntegerType())]))


class _Block:
    """One block of queries and its best k so far. Vectors come in the order of their ids, so a vector's number stands for it."""

    def __init__(self, k: int):
        self.k, self.ids, self.parts, self.bounds, self.unit = k, [], [], [], None
        self.names, self.pending = [], 0
        self.row, self.at, self.sim = [], [], []
        self.bound = self.least = None

    def add_queries(self, batch):
        self.ids += batch.column("id").to_pylist()
        self.parts.append(_unit(_matrix(batch.column("vec"))))
        self.bounds += [-2.0 if x is None else x for x in batch.column("bound").to_pylist()]

    def add_corpus(self, batch):
        if self.unit is None:
            self.unit, self.bound, self.parts = np.concatenate(self.parts), np.array(self.bounds), []
            self.least = self.bound
        unit, first = _unit(_matrix(batch.column("vec"))), len(self.names)
        self.names += batch.column("id").to_pylist()
        step = max(1, BLOCK // len(self.ids))
        for lo in range(0, len(unit), step):
            self._compare(unit[lo:lo + step], first + lo)

    def _compare(self, unit, first):
        sim = self.unit @ unit.T
        # what may be among the best k: as good as the k-th so far or, before there is one, as the piece's k-th
        least = self.least.copy()
        new = np.flatnonzero(least < -1) if len(unit) > self.k else []
        if len(new):
            least[new] = np.partition(sim[new], -self.k, axis=1)[:, -self.k]
        row, col = np.nonzero(sim >= (least - ROUNDING)[:, None])
        del sim
        pairs = max(1, BLOCK // unit.shape[1])
        for lo in range(0, len(row), pairs):
            r, c = row[lo:lo + pairs], col[lo:lo + pairs]
            # one product for each pair: the same value whatever the block
            self.row.append(r)
            self.at.append(c + first)
            self.sim.append(np.einsum("ij,ij->i", self.unit[r], unit[c]))
            self.pending += len(r)
            if self.pending >= max(len(self.ids), BLOCK // 16):
                self._trim()

    def _trim(self):
        row, sim, at = np.concatenate(self.row), np.concatenate(self.sim), np.concatenate(self.at)
        order = np.lexsort((at, -sim, row))
        rows = row[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        keep = order[np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)])) < self.k]
        self.row, self.sim, self.at, self.pending = [row[keep]], [sim[keep]], [at[keep]], 0
        full = np.bincount(self.row[0], minlength=len(self.ids)) >= self.k
        worst = np.full(len(self.ids), 2.0)
        np.minimum.at(worst, self.row[0], self.sim[0])
        self.least = np.where(full, np.maximum(worst, self.bound), self.bound)

    def result(self, schema):
        import pyarrow as pa
        if self.row:
            self._trim()
        row, sim, at = (x[0].tolist() if x else [] for x in (self.row, self.sim, self.at))
        return pa.RecordBatch.from_arrays([pa.array([self.ids[r] for r in row], schema[0].type), pa.array([self.names[i] for i in at], schema[1].type),
                                           pa.array(sim, schema[2].type)], names=["query_id", "chunk_id", "sim"])


def _visitors(visits: DataFrame) -> dict[int, int]:
    """How many queries visit each cluster."""
    return {r.cluster: r.n for r in visits.groupBy("cluster").agg(F.count("*").alias("n")).collect()}


def _meet(visits: DataFrame, visitors: dict[int, int], corpus: DataFrame, sizes: np.ndarray, k: int, dim: int, q_rows: int | None,
          c_rows: int, kinds: T.StructType) -> DataFrame:
    """(query_id, chunk_id, sim): the best k of every visit's slices."""
    spark = corpus.sparkSession
    slices = np.maximum(1, -(-sizes // c_rows))
    n_slices = F.element_at(F.lit(slices.tolist()), F.col("cluster") + 1)
    # blocks of queries for each cluster, by how many visit it
    if q_rows is None:
        pairs = sum(n * int(slices[i]) for i, n in visitors.items())
        q_rows = max(1, min(BLOCK // dim, max(LEAST_ROWS, pairs // GROUPS)))
    blocks = {i: -(-visitors.get(i, 0) // q_rows) for i in range(len(slices))}
    n_blocks = F.element_at(F.lit([blocks[i] for i in range(len(slices))]), F.col("cluster") + 1)
    side_q = visits.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int")).select(
        "cluster", F.explode(F.sequence(F.lit(0), n_slices - 1)).alias("slice"), "block", F.lit(0).alias("side"),
        F.col("id").alias("q"), F.lit(None).cast(kinds["chunk_id"].dataType).alias("c"), "vec", "bound")
    side_c = corpus.where(n_blocks > 0).select(
        "cluster", F.pmod(F.xxhash64("id"), n_slices).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"),
        F.lit(1).alias("side"), F.lit(None).cast(kinds["query_id"].dataType).alias("q"), F.col("id").alias("c"), "vec",
        F.lit(None).cast("double").alias("bound"))
    key = ["cluster", "slice", "block"]
    groups = max(1, int(sum(blocks[i] * int(n) for i, n in enumerate(slices))))
    copies = sum(n * int(slices[i]) + blocks[i] * int(sizes[i]) for i, n in visitors.items())
    parts = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), copies // TASK_ROWS, 1))
    dealt = side_q.unionByName(side_c).repartition(parts, *key).sortWithinPartitions(*key, "side", "c")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(kinds)
        now, block = None, None
        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in (*key, "side")], 1)
            cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)]) if len(at) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
                group, part = tuple(at[lo, :3].tolist()), b.slice(lo, hi - lo)
                if group != now:
                    if block is not None:
                        yield block.result(schema)
                    now, block = group, _Block(k)
                if at[lo, 3] == 0:
                    block.add_queries(pa.RecordBatch.from_arrays([part.column(c) for c in ("q", "vec", "bound")], names=["id", "vec", "bound"]))
                elif block.ids:
                    block.add_corpus(pa.RecordBatch.from_arrays([part.column("c"), part.column("vec")], names=["id", "vec"]))
        if block is not None:
            yield block.result(schema)
    return dealt.mapInArrow(run, kinds)


def semantic_topk(queries: DataFrame, corpus: DataFrame, k: int = TOP_K,
                  q_id: str = "query_id", c_id: str = "chunk_id",
                  q_vec: str = "embedding", c_vec: str = "embedding",
                  q_rows: int | None = None, c_rows: int = 1 << 16, clusters: int | None = None) -> DataFrame:
    """V3: exact cosine-distance top-k per query.

    Returns ``(query_id, rank, chunk_id, distance)`` with rank 1..k ordered by
    (distance asc, chunk_id asc); distance is ``1 - cos`` in double precision,
    null for zero or null vectors (sorted last). Query ids are distinct.
    """
    q = materialize(queries.select(F.col(q_id).alias("id"), F.col(q_vec).alias("vec")))
    c = corpus.select(F.col(c_id).alias("id"), F.col(c_vec).alias("vec"))
    c = materialize(c.withColumn("_zero", _is_zero()))
    full, zero = c.where("NOT _zero").drop("_zero"), c.where("_zero").select("id")
    kinds = T.StructType([T.StructField("query_id", queries.schema[q_id].dataType), T.StructField("chunk_id", corpus.schema[c_id].dataType),
                          T.StructField("sim", T.DoubleType())])
    n = full.count()
    # results without a distance: only where too few vectors have a direction, the smallest ids
    ids = c.select(F.col("id").alias("chunk_id")).orderBy("chunk_id").limit(k)
    lost = q.where(_is_zero()).select(F.col("id").alias("query_id"))
    found = [_with_all(lost, ids)]
    if n < k:
        some = zero.select(F.col("id").alias("chunk_id")).orderBy("chunk_id").limit(k)
        found.append(_with_all(q.where(~_is_zero()).select(F.col("id").alias("query_id")), some))
    asked = q.where(~_is_zero())
    if n:
        wanted = clusters or max(1, min(CLUSTERS, math.ceil(n / CLUSTER_ROWS)), min(BINS, n // FEW_ROWS))
        centres = _unit(np.array([r.vec for r in full.orderBy(F.xxhash64("id")).limit(wanted).select("vec").collect()], np.float64))
        dealt = materialize(_assign(full, centres, k))
        stats = {r.cluster: r for r in dealt.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).collect()}
        sizes = np.array([stats[i].n if i in stats else 0 for i in range(len(centres))], np.int64)
        widest = np.array([stats[i].widest + SLACK if i in stats else 0.0 for i in range(len(centres))])
        dim = centres.shape[1]
        first = _visits(asked.withColumn("bound", F.lit(None).cast("double")), centres, widest, sizes, k, False)
        near = materialize(_meet(first, _visitors(first), dealt, sizes, k, dim, q_rows, c_rows, kinds))
        if len(centres) > 1:
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim")))
            bound = near.withColumn("_n", rank).where(F.col("_n") == k).select(F.col("query_id").alias("id"), F.col("sim").alias("bound"))
            # one row a query is kept; its visits, many times as large, are made anew for counting and for dealing
            bounded = materialize(asked.join(bound, "id", "left"))
            others = _visits(bounded, centres, widest, sizes, k, True)
            visitors = _visitors(others)
            if sum(visitors.values()) > BINS * bounded.count():
                bins = np.arange(len(centres)) * BINS // len(centres)
                others, visitors = _visits(bounded, centres, widest, sizes, k, True, bins), None
                sizes = np.bincount(bins, sizes, BINS).astype(np.int64)
                # these meet their nearest clusters again
                near, dealt = None, dealt.withColumn("cluster", F.element_at(F.lit(bins.tolist()), F.col("cluster") + 1))
            found.append(_meet(others, visitors or _visitors(others), dealt, sizes, k, dim, q_rows, c_rows, kinds))
        if near is not None:
            found.append(near)
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc_nulls_last(), F.col("chunk_id").asc())
    return (rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select("query_id", "rank", "chunk_id", (1.0 - F.col("sim")).alias("distance")))


def _with_all(queries: DataFrame, ids: DataFrame) -> DataFrame:
    """Every query with each of the k ids at most that ``ids`` holds; no similarity."""
    kind = ids.schema["chunk_id"].dataType
    each = F.array(*[F.lit(r.chunk_id).cast(kind) for r in ids.collect()]).cast(T.ArrayType(kind))
    return queries.select("query_id", F.explode(each).alias("chunk_id"), F.lit(None).cast("double").alias("sim"))
