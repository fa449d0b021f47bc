"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of distinct word shingles; two link if 100 * intersection
>= percent * union. Equal sets are one class and stand for all their copies.

1. Shingle counts. Every text is hashed once; each task adds its shingles into
   ``BUCKETS`` counters, which are summed over all tasks. The counters (4 MB,
   whatever the corpus) give one global order, rarest first. Any order is
   right; this one keeps shared passages and frequent phrases at the end.
2. Prefixes. A linked pair of sets shares at least l shingles among the first
   n - ceil(percent * n / 100) + l of each, for every l. Each set offers its
   prefix for l = ``LONGEST`` once, marked with the l that takes each shingle
   in; those that no other set offers are dropped.
3. Lengthening. For each set the cost of l = 1, 2, ... is estimated from the
   frequencies of its offered shingles: lists read, plus candidates (those
   lists divided by l matches) times the cost of a comparison. The cheapest l
   holds; a pair becomes a candidate if it shares the smaller l of the two
   among the shingles that both offer up to it.
4. Candidates. Shingles offered by at most ``COLD`` sets are joined with
   themselves (each row meets at most ``COLD`` others) and pairs with enough
   matches are compared. Sets that share a more frequent shingle form a hot
   group; its sets are dealt to blocks of ``BLOCK`` and each pair of blocks is
   compared inside a task, which returns only a spanning forest of its links,
   so large families of near copies never turn into rows of pairs.
5. Components of the links, by alternating stars.

Tables of earlier steps and their shuffle files go as soon as nothing reads
them: what is left at the end is one row for each document and each class.

Exact: no link is lost. Defined results: null, empty or wordless texts have
the empty set, and link with nothing; repeated rows are copies; rows with a
null id belong to their class but never name a component (which is null if
all its ids are null); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, drop_tables, passing_table, shuffles_freed
from .components import components
from .shingles import mix, shingle_sets

BUCKETS = 1 << 20
_SEGMENT = 1 << 13
LONGEST = 4
COLD = 64
BLOCK = 512
#: A list of at most so many keys is broadcast (24 bytes each); a longer one is joined by a shuffle. A bitmap has at most so many words.
BROADCAST_ROWS = 500_000
#: Names of sets that a task remembers, so copies that it meets offer no prefix.
REMEMBERED = 1 << 18


def _bucket(x):
    import numpy as np
    return (x >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def _name(s) -> bytes:
    """128 bits that stand for a set."""
    import xxhash
    return xxhash.xxh3_128_digest(s.tobytes())


def _digest(docs: DataFrame, size: int) -> DataFrame:
    """Rows (id, n, set) for documents, and (segment, counts) for the shingle counters."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        counts = np.zeros(BUCKETS, np.uint32)
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), ("segment", pa.int32()), ("part", pa.int32()),
                            ("counts", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = shingle_sets(as_bytes(some.column(1)), size)
                counts += np.bincount(_bucket(np.concatenate(sets)), minlength=BUCKETS).astype(np.uint32)
                k = len(sets)
                yield pa.RecordBatch.from_arrays([
                    some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) if len(s) else None for s in sets], pa.binary()),
                    pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        part = TaskContext.get().partitionId()
        for i in range(0, BUCKETS, _SEGMENT):
            if counts[i:i + _SEGMENT].any():
                yield pa.RecordBatch.from_pylist([{"segment": i // _SEGMENT, "part": part, "counts": counts[i:i + _SEGMENT].tobytes()}], schema=schema)
    return docs.mapInArrow(run, "id long, n long, set binary, segment int, part int, counts binary")


def _sum_counts(rows: DataFrame):
    """All counters as one array, summed in two levels so no group grows with the number of tasks beyond its square root."""
    import numpy as np

    def add(key, table):
        import pyarrow as pa
        total = np.zeros(_SEGMENT, np.uint64)
        for x in table.column("counts"):
            got = np.frombuffer(x.as_buffer(), np.uint32 if len(x.as_buffer()) == 4 * _SEGMENT else np.uint64)
            total += got
        return pa.table({"segment": pa.array([table.column("segment")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    def last(key, table):
        import pyarrow as pa
        got = add(key, table)
        total = np.frombuffer(got.column("counts")[0].as_py(), np.uint64)
        return got.set_column(1, "counts", pa.array([np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32).tobytes()], pa.binary()))
    kind = "segment int, counts binary"
    once = rows.groupBy("segment", (F.col("part") % 64).alias("some")).applyInArrow(add, kind)
    out = np.zeros(BUCKETS, np.uint32)
    with shuffles_freed(rows.sparkSession):
        sums = once.groupBy("segment").applyInArrow(last, kind).collect()
    for r in sums:
        out[r.segment * _SEGMENT:(r.segment + 1) * _SEGMENT] = np.frombuffer(r.counts, np.uint32)
    return out


def _prefixes(docs: DataFrame, counts, size: int, percent: int) -> DataFrame:
    """(token, set, n, level) for the longest prefix of each text's set; a set may come more than once."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        order = counts.value
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                tokens, names, sizes, levels = [], [], [], []
                for s in shingle_sets(as_bytes(batch.slice(at, 500).column(0)), size):
                    n = len(s)
                    if not n or (name := _name(s)) in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(name)
                    least = -(-percent * n // 100)
                    base, longest = n - least + 1, min(LONGEST, least)
                    k = min(n, base + longest - 1)
                    key = (order[_bucket(s)].astype(np.uint64) << np.uint64(32)) | (mix(s) >> np.uint64(32))
                    first = np.argpartition(key, k - 1)[:k] if k < n else np.arange(n)
                    first = first[np.lexsort((s[first], key[first]))]
                    tokens.append(s[first])
                    names += [name] * k
                    sizes.append(np.full(k, n, np.int64))
                    levels.append(np.maximum(1, np.arange(1, k + 1) - base + 1).astype(np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(tokens).view(np.int64)), pa.array(names, pa.binary()), pa.array(np.concatenate(sizes)),
                        pa.array(np.concatenate(levels))], names=["token", "set", "n", "level"])
    return docs.mapInArrow(run, "token long, set binary, n long, level int")


def _shared_postings(prefixes: DataFrame, percent: int) -> DataFrame:
    """Postings of shingles that two different sets offer at least, cut to each set's cheapest l; with the number of sets that offer the shingle
    and the smallest of them."""
    w = W.partitionBy("token")
    # copies go before sets are counted, all in the tasks that a token's rows were dealt to
    shared = (prefixes.withColumns({"low": F.min("set").over(w), "high": F.max("set").over(w)})
              .where("low != high").drop("high").dropDuplicates(["token", "set"]).withColumn("df", F.count("*").over(w)))
    shared = passing_table(shared, "postings")
    reads = [F.sum(F.when(F.col("level") <= k, F.col("df") - 1).otherwise(0)).alias(f"_{k}") for k in range(1, LONGEST + 1)]
    # a set's l is at most the shingles that it must share (others are null, which least() skips)
    cost = [F.when(100 * (k - 1) < percent * F.col("n"), F.struct((F.col(f"_{k}") * (1 + F.col("n") / (16.0 * k))).alias("cost"), F.lit(k).alias("l")))
            for k in range(1, LONGEST + 1)]
    chosen = shared.groupBy("set", "n").agg(*reads).select("set", F.least(*cost)["l"].alias("l"))
    postings = passing_table(shared.join(chosen, "set").where("level <= l"), "postings")
    drop_tables(shared)
    return postings


def _cold_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) by shingles that few sets offer."""
    p = postings.where(F.col("df") <= COLD).select("token", "set", "n", "level", "l")
    a, b = (p.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("set", "n", "level", "l")]) for x in "ab")
    least = F.least("l_a", "l_b")
    return (a.join(b, "token").where("set_a < set_b")
            .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            .where((F.col("level_a") <= least) & (F.col("level_b") <= least))
            .groupBy(F.col("set_a").alias("a"), F.col("set_b").alias("b")).agg(F.count("*").alias("matches"), F.min(least).alias("need"))
            .where("matches >= need").select("a", "b"))


def _is_few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _is_few(df) else df


def _listed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is one of ``ids``, and few others: a broadcast bitmap of the ids' hashes drops most texts where they are read."""
    h = F.xxhash64("id")
    slot = F.pmod(F.shiftright(h, 6), F.lit(BROADCAST_ROWS)).alias("slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias("bit")
    words = ids.select(slot, bit).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    return docs.select("*", slot, bit).join(F.broadcast(words), "slot").where("(bits & bit) != 0").select(*docs.columns)


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set, items) with the shingles of the wanted sets, from one document of each class."""
    ids = passing_table(classes.join(wanted, "set", "left_semi").select("id", "set"), "wanted")
    few = _is_few(ids)

    def run(batches):
        import pyarrow as pa
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                rows = []
                for s, name in zip(shingle_sets(as_bytes(some.column(0)), size), some.column(1).to_pylist()):
                    if _name(s) == name and name not in seen:
                        seen.add(name)
                        rows.append({"set": name, "items": s.tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("set", pa.binary()), ("items", pa.binary())]))
    # many ids: the texts are shuffled, but not those that nobody wants
    some = docs if few else _listed(docs, ids)
    texts = some.join(F.broadcast(ids) if few else ids, some["id"].eqNullSafe(ids["id"])).select("text", "set")
    # a repeated id may yield a set twice, from two tasks
    sets = passing_table(texts.mapInArrow(run, "set binary, items binary").dropDuplicates(["set"]), "sets")
    drop_tables(ids)
    return sets


def _linked(items_a, items_b, percent: int):
    """Whether each pair of packed sets links."""
    import numpy as np
    out = []
    for x, y in zip(items_a, items_b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.sort(np.concatenate([x, y]))
        common = int((both[1:] == both[:-1]).sum())
        out.append(100 * common >= percent * (len(x) + len(y) - common))
    return out


def _cold_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("set").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("set").alias("b"), F.col("items").alias("items_b"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                keep = _linked(some.column("items_a").to_pylist(), some.column("items_b").to_pylist(), percent)
                yield some.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return pairs.join(right, "b").join(left, "a").mapInArrow(run, "a binary, b binary")


def _block_forest(names: list, groups: list, sets: list, percent: int) -> list[tuple]:
    """A spanning forest of the links between sets of group 0 and 1 (or within group 0 if there is no other)."""
    import numpy as np
    order = np.argsort([len(s) for s in sets], kind="stable")
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), [len(sets[i]) for i in order])
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    token = np.cumsum(new) - 1
    many = np.bincount(token)[token] > 1
    token, owner = token[many], owner[many]
    token = np.unique(token, return_inverse=True)[1]
    m = len(order)
    common = np.zeros((m, m), np.float32)
    start = np.searchsorted(token, np.arange(0, (token[-1] + 1 if len(token) else 0) + 2048, 2048))
    for lo, hi, base in zip(start, start[1:], range(0, 1 << 62, 2048)):
        part = np.zeros((m, 2048), np.float32)
        part[owner[lo:hi], token[lo:hi] - base] = 1
        common += part @ part.T
    # counts below 2^24 are exact in single precision, their products with 100 are not
    common = common.astype(np.int64)
    n = np.array([len(sets[i]) for i in order], np.int64)
    side = np.array([groups[i] for i in order])
    ok = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    if side.any():
        ok &= side[:, None] != side[None, :]
    root = list(range(m))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    forest = []
    for a, b in np.argwhere(np.triu(ok, 1)).tolist():
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            forest.append((names[order[a]], names[order[b]]))
    return forest


def _hot_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within hot groups: every pair of a group's blocks is compared in one task. ``groups``: (set, hot)."""
    sizes = groups.groupBy("hot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = groups.join(sizes, "hot").withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "set", "hot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    def run(key, table):
        import numpy as np
        import pyarrow as pa
        got = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
        forest = _block_forest(table.column("set").to_pylist(), table.column("side").to_pylist(), got, percent)
        return pa.table({"a": pa.array([a for a, _ in forest], pa.binary()), "b": pa.array([b for _, b in forest], pa.binary())})
    items = sets.join(_few(groups.select("set")), "set", "left_semi")
    return dealt.join(items, "set").groupBy("hot", "i", "j").applyInArrow(run, "a binary, b binary")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; ids are whole numbers."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    digest = passing_table(_digest(docs, size), "digest")
    rows = digest.where("segment IS NULL").select("id", "n", "set")
    classes = passing_table(rows.where("n > 0").groupBy("set").agg(F.min("id").alias("id")), "classes")
    counts = spark.sparkContext.broadcast(_sum_counts(digest.where("segment IS NOT NULL").select("segment", "part", "counts")))
    postings = _shared_postings(_prefixes(docs.select("text"), counts, size, percent), percent)

    hot = components(postings.where(F.col("df") > COLD).select(F.col("set").alias("a"), F.col("low").alias("b")))
    hot = passing_table(hot.select(F.col("node").alias("set"), F.col("root").alias("hot")), "hot")
    of = lambda x: hot.select(F.col("set").alias(x), F.col("hot").alias(f"hot_{x}"))
    pairs = _cold_pairs(postings, percent).join(of("a"), "a", "left").join(of("b"), "b", "left").where(
        "hot_a IS NULL OR hot_b IS NULL OR hot_a != hot_b").select("a", "b")
    pairs = passing_table(pairs, "pairs")
    drop_tables(postings)
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).union(hot.select("set")).distinct()
    sets = _sets_of(docs, classes, wanted, size)
    # one after the other, so the shuffled sets of the first are gone when the second begins
    links = [passing_table(x, "links") for x in (_cold_links(pairs, sets, percent), _hot_links(hot, sets, percent))]
    drop_tables(pairs, sets, hot)

    found = components(links[0].union(links[1])).select(F.col("node").alias("set"), "root")
    found = passing_table(classes.join(found, "set", "left"), "found")
    drop_tables(classes, *links)
    named = found.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"))
    of_set = passing_table(found.join(named, "root", "left").select(
        "set", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")), "named")
    drop_tables(found)
    return rows.join(of_set, "set", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
