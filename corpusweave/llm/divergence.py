"""Source divergence audit: how far each source's words are from the other sources of its language.

1. ``term_counts``: a pipeline of Arrow kernels inside ``mapInArrow`` turns
   texts into counts: ``ascii_lower``, ``split_pattern_regex``,
   ``dictionary_encode``, then hash ``group_by`` to (row, term) and to
   (lang, source, term). A task merges its partial counts as it goes and
   hands them on when they reach ``PARTIAL_ROWS``.
2. Merge: partial counts are summed by term, and terms in too few documents of
   their language go. A frequent term is one row per task, whatever the texts.
3. Shards: the kept counts of a language are dealt by term into shards of
   about ``SHARD_ROWS`` rows. A shard is a matrix of its terms by the
   language's sources; it returns one partial sum for each pair of sources and
   its best ten terms for each source. Terms that neither source of a pair has
   add one constant each, so they are counted, not visited.
4. The partial sums are added and ranked.

Whole numbers throughout: p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), and the
divergence of two is floor((p - q)^2 / (p + q)).

Defined results: null text, lang and source read as ''; repeated rows count
again; a group without terms, or a language without kept terms, still has its
pairs (value 0 if no term is kept); ties are ranked by item; empty tables give
empty results. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_table

#: What lies between terms: all ASCII that is no letter.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCUMENTS, SCALE, SMOOTH, TOP = 10, 1_000_000_000, 2, 10
#: Text bytes that the kernels take at once, and rows a task holds before it hands them on.
SLICE_BYTES, PARTIAL_ROWS = 4 << 20, 1 << 19
SHARD_ROWS = 200_000
#: A table of at most so many languages is broadcast.
BROADCAST_LANGS = 100_000
#: Cells of a shard's matrix that are computed at once.
CELLS = 1 << 21


def _partial(lang, source, text):
    """(lang, source, term, n, df) of some rows, by Arrow kernels. The term '' marks a group, so groups without terms are known too."""
    import pyarrow as pa
    import pyarrow.compute as pc
    terms = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    rows, flat = pc.list_parent_indices(terms), pc.list_flatten(terms)
    full = pc.not_equal(flat, "")
    rows, coded = rows.filter(full), flat.filter(full).dictionary_encode()
    once = pa.table({"row": rows, "term": coded.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    group = pa.table({"lang": lang.dictionary_encode().indices, "source": source.dictionary_encode().indices})
    of_row = group.take(once["row"])
    summed = pa.table({"lang": of_row["lang"], "source": of_row["source"], "term": once["term"], "n": once["count_all"]}).group_by(
        ["lang", "source", "term"]).aggregate([("n", "sum"), ("n", "count")])
    named = {"lang": lang.dictionary_encode().dictionary.take(summed["lang"].combine_chunks()),
             "source": source.dictionary_encode().dictionary.take(summed["source"].combine_chunks()),
             "term": coded.dictionary.take(summed["term"].combine_chunks()), "n": summed["n_sum"], "df": summed["n_count"]}
    marks = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"]).aggregate([])
    none = pa.array([0] * marks.num_rows, pa.int64())
    marks = pa.table({"lang": marks["lang"], "source": marks["source"], "term": pa.array([""] * marks.num_rows), "n": none, "df": none})
    return pa.concat_tables([pa.table(named), marks.select(list(named))])


def _merged(tables):
    import pyarrow as pa
    t = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("df", "sum")])
    return t.select(["lang", "source", "term", "n_sum", "df_sum"]).rename_columns(["lang", "source", "term", "n", "df"])


def _slices(batch):
    """The batch in pieces of about ``SLICE_BYTES`` of text, one row at least."""
    import pyarrow.compute as pc
    start = held = 0
    for i, k in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if held and held + k > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += k
    if batch.num_rows:
        yield batch.slice(start)


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial counts (lang, source, term, n, df): occurrences, and documents that hold the term."""
    def run(batches):
        waiting, held = [], None
        for batch in batches:
            for some in _slices(batch):
                waiting.append(_partial(some.column("lang"), some.column("source"), some.column("text")))
                if sum(t.num_rows for t in waiting) >= PARTIAL_ROWS // 4:
                    held, waiting = _merged([held, *waiting] if held else waiting), []
                    if held.num_rows >= PARTIAL_ROWS:
                        yield from held.to_batches(max_chunksize=10_000)
                        held = None
        rest = [*([held] if held else []), *waiting]
        if rest:
            yield from _merged(rest).to_batches(max_chunksize=10_000)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return read.mapInArrow(run, "lang string, source string, term string, n long, df long")


def kept_counts(partial: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, lang_n, first): the kept terms' counts in a group and in its language, one row of each term
    being ``first``; and a row with term '' for every group."""
    # one shuffle by language and term serves the sums and the window
    merged = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    w = W.partitionBy("lang", "term")
    kept = merged.select("lang", "source", "term", "n", F.sum("n").over(w).alias("lang_n"), F.sum("df").over(w).alias("lang_df"),
                         (F.min("source").over(w) == F.col("source")).alias("first"))
    return kept.where((F.col("lang_df") >= min_documents) | (F.col("term") == "")).drop("lang_df")


def totals(kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms) for every group."""
    word = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)).alias("total"))
    langs = kept.groupBy("lang").agg(F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)).alias("lang_total"),
                                     F.count(F.when(word & F.col("first"), 1)).alias("terms"))
    return groups.join(langs, "lang").select("lang", "source", "total", "lang_total", "terms")


def shares(count, total: int, terms: int):
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)) as 64-bit numbers, by long division in base 1000: no
    product leaves 64 bits while totals stay below 9 * 10^15."""
    import numpy as np
    below = np.int64(total + SMOOTH * terms)
    rest = np.asarray(count, np.int64) + SMOOTH
    out, rest = rest // below, rest % below
    scale = SCALE
    while scale > 1:
        rest = rest * 1000
        out, rest = out * 1000 + rest // below, rest % below
        scale //= 1000
    return out + 1


def distance(p, q):
    return (p - q) * (p - q) // (p + q)


def _shard(counts, groups):
    """Partial results of one shard: (source, part, item, value, n) for pairs (n: terms that either source has) and best terms."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    names = sorted(groups["source"].to_pylist(), key=str.encode)
    place = {s: i for i, s in enumerate(names)}
    total = dict(zip(groups["source"].to_pylist(), groups["total"].to_pylist()))
    lang_total, n_terms = groups["lang_total"][0].as_py(), groups["terms"][0].as_py()
    coded = counts["term"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)  # bytes rising, so stable sorts keep ties by item
    vocabulary = coded.dictionary.take(order)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    term = rank[coded.indices.to_numpy()]
    row = np.array([place[s] for s in counts["source"].to_pylist()], np.int64)
    n, lang_n = counts["n"].to_numpy(), counts["lang_n"].to_numpy()
    s, step = len(names), max(1, CELLS // len(names))
    value, either = np.zeros((s, s), np.int64), np.zeros((s, s), np.int64)
    best = [[] for _ in names]
    by_term = np.argsort(term, kind="stable")
    for at in range(0, len(vocabulary), step):
        some = by_term[slice(*np.searchsorted(term[by_term], [at, at + step]))]
        t = min(step, len(vocabulary) - at)
        c, all_n = np.zeros((s, t), np.int64), np.zeros(t, np.int64)
        c[row[some], term[some] - at] = n[some]
        all_n[term[some] - at] = lang_n[some]
        has = c > 0
        p = np.stack([shares(c[i], total[x], n_terms) for i, x in enumerate(names)])
        q = shares(all_n, lang_total, n_terms)
        own = has.astype(np.int64)
        sizes = own.sum(1)
        either += sizes[:, None] + sizes[None, :] - own @ own.T
        for i in range(s):
            got = np.flatnonzero(has[i])
            if not len(got):
                continue
            f = distance(p[i, got][None, :], p[:, got])
            value[i] += f.sum(1)
            # terms of the other source that this one lacks
            value[:, i] += np.where(has[:, got], 0, f).sum(1)
            over = got[p[i, got] > q[got]]
            g = distance(p[i, over], q[over])
            for k in np.argsort(-g, kind="stable")[:TOP]:
                best[i].append((-int(g[k]), at + int(over[k])))
    # value[i, j] holds the terms of i, and those of j that i lacks: every term that either has, once
    out = [(names[i], "pair", names[j], int(value[i, j]), int(either[i, j])) for i in range(s) for j in range(s) if i != j]
    for i, found in enumerate(best):
        out += [(names[i], "term", vocabulary[k].as_py(), -f, 0) for f, k in sorted(found)[:TOP]]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return [pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 5, kinds)]


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module."""
    kept = shared_table(kept_counts(term_counts(docs), min_documents), "kept-terms")
    groups = shared_table(totals(kept), "group-totals")
    words = kept.where("term != ''")
    shards = words.groupBy("lang").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    shards = shared_table(shards, "shards")
    # one row a language: sent whole while it is small
    shards = F.broadcast(shards) if shards.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS else shards
    dealt = words.join(shards, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")).select(
        "lang", "shard", "source", "term", "n", "lang_n")
    # only shards that hold rows
    of_shard = groups.join(dealt.select("lang", "shard").distinct(), "lang").select(
        F.col("lang").alias("own_lang"), F.col("shard").alias("own_shard"), "source", "total", "lang_total", "terms")
    kinds = "lang string, source string, part string, item string, value long, n long"

    def run(key, counts, own):
        import pyarrow as pa
        columns = _shard(counts, own)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(columns[0]), pa.string()), *columns],
                                    names=["lang", "source", "part", "item", "value", "n"])
    parts = shared_table(dealt.groupBy("lang", "shard").cogroup(of_shard.groupBy("own_lang", "own_shard")).applyInArrow(run, kinds), "divergence-parts")

    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    of = lambda x: groups.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "total", "terms")])
    # total + 2 * terms is at least 2 here, and SCALE * SMOOTH is far below 2^63: whole division
    absent = lambda x: F.expr(f"1 + {SCALE * SMOOTH} div (total_{x} + {SMOOTH} * terms_{x})")
    pairs = of("a").join(of("b"), "lang").where("source_a != source_b").select(
        "lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.col("terms_a").alias("terms"),
        F.when(F.col("terms_a") > 0, absent("a")).alias("p"), F.when(F.col("terms_a") > 0, absent("b")).alias("q"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        F.expr("CASE WHEN terms = 0 THEN 0 ELSE coalesce(value, 0) + (terms - coalesce(n, 0)) * (((p - q) * (p - q)) div (p + q)) END").alias("value"))
    best = parts.where("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return (pairs.withColumn("rank", rank).union(best.withColumn("rank", rank).where(F.col("rank") <= TOP)))
