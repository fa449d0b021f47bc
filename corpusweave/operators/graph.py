"""Symbol table, name index, call resolution, graph lookups, BFS
expansion with a context budget, related files.

Everything is joins, windows and aggregates on the JVM.  Plans that would
pair up rows inside one hot group are rewritten to stay linear:
  * G3 resolves ambiguous names through an equi-join on character prefixes
    of candidate ids (not candidates x callers);
  * G8 matches substrings through an equi-join on each module's rarest
    trigram (1- and 2-char modules through an equi-join on short grams);
  * G10 caps each node's neighbour list at the budget, which is exact (see
    ``graph_expand``), so a hub never fans out to all of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.config import BFS_DEPTH, HOP_DECAY, MAX_SYMBOLS
from corpusweave.functions.ids import module_of
from corpusweave.session import materialize, spread


# ---------------------------------------------------------------- G1, G2
def symbol_table(chunks: DataFrame) -> DataFrame:
    """G1: one row per symbol id, the last definition in the file wins."""
    w = Window.partitionBy("symbol_id").orderBy(F.col("start_line").desc(), F.col("end_line").desc())
    return (chunks.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
                  .select("symbol_id", "short_name", "path", "chunk_id",
                          F.col("chunk_type").alias("type"), "start_line", "end_line"))


def name_index(symbols: DataFrame) -> DataFrame:
    """G2 in long form: distinct (short_name, symbol_id), plus per-name count
    and smallest id.  Kept long so a hot name never becomes one huge array."""
    pairs = symbols.select("short_name", "symbol_id").distinct()
    return pairs.groupBy("short_name").agg(
        F.count("*").alias("n_candidates"), F.min("symbol_id").alias("first_id"))


def find_symbol(symbols: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """Symbol rows for a table of short names."""
    return names.join(symbols, names[name_col] == symbols["short_name"], "inner").drop(names[name_col])


# ---------------------------------------------------------------- G3, G4
def resolve_calls(raw_calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """raw_calls(path, caller, pos, raw_call) -> + (dst, resolved).

    short = text after the last '.'; exactly one candidate -> it; else the
    smallest candidate id that starts with the caller's module (no dot
    boundary, Q10/Q11); else the raw text.
    """
    names = name_index(symbols)
    rc = (raw_calls.withColumn("short", F.substring_index("raw_call", ".", -1))
                   .withColumn("module", module_of(F.col("path"))))
    j = rc.join(names, rc["short"] == names["short_name"], "left").drop("short_name")

    # ambiguous names: distinct (short, module) against every character
    # prefix of each candidate id -- an equi-join, linear in the candidates
    amb = j.where(F.col("n_candidates") > 1).select("short", "module").distinct()
    amb_names = amb.select(F.col("short").alias("short_name")).distinct()
    cand = (symbols.select("short_name", "symbol_id").distinct()
                   .join(amb_names, "short_name", "left_semi")
                   .withColumn("prefix", F.explode(F.expr(
                       "transform(sequence(1, length(symbol_id)), i -> substring(symbol_id, 1, i))")))
                   # one row per prefix before the join (map-side combined): no hot prefix meets it
                   .groupBy("short_name", "prefix").agg(F.min("symbol_id").alias("picked")))
    picked = (amb.join(cand, (amb["short"] == cand["short_name"]) & (amb["module"] == cand["prefix"]))
                 .select("short", "module", "picked"))
    out = j.join(picked, ["short", "module"], "left")
    dst = (F.when(F.col("n_candidates") == 1, F.col("first_id"))
            .when(F.col("picked").isNotNull(), F.col("picked"))
            .otherwise(F.col("raw_call")))
    resolved = (F.col("n_candidates") == 1) | F.col("picked").isNotNull()
    return out.select("path", "caller", "pos", "raw_call", dst.alias("dst"),
                      F.coalesce(resolved, F.lit(False)).alias("resolved"))


def call_edges(resolved_calls: DataFrame) -> DataFrame:
    """Distinct (src, dst, resolved); self-loops allowed."""
    return resolved_calls.select(F.col("caller").alias("src"), "dst", "resolved").distinct()


def graph_nodes(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Every symbol is a node, plus every edge end (unresolved text included)."""
    return (symbols.select(F.col("symbol_id").alias("node"))
            .union(edges.select(F.col("src").alias("node")))
            .union(edges.select(F.col("dst").alias("node"))).distinct())


# ---------------------------------------------------------------- G5-G7
def callers_of(edges: DataFrame, ids: DataFrame, id_col: str = "symbol_id") -> DataFrame:
    """(id, caller) for a table of ids; unknown ids give no rows."""
    e = edges.select(F.col("src").alias("caller"), F.col("dst").alias(id_col))
    return ids.select(id_col).join(e, id_col).select(id_col, "caller")


def callees_of(edges: DataFrame, ids: DataFrame, id_col: str = "symbol_id") -> DataFrame:
    """(id, callee) for a table of ids."""
    e = edges.select(F.col("src").alias(id_col), F.col("dst").alias("callee"))
    return ids.select(id_col).join(e, id_col).select(id_col, "callee")


def dependencies_of(imports: DataFrame, files: DataFrame, path_col: str = "path") -> DataFrame:
    """Import statements of each file in ``files``."""
    imp = imports.select(F.col("path").alias("file"), "pos", "import_text")
    return files.select(F.col(path_col).alias("file")).join(spread(imp), "file")


# ---------------------------------------------------------------- G8
def substring_matches(needles: DataFrame, hay: DataFrame, needle_col: str = "module",
                      hay_col: str = "text") -> DataFrame:
    """Exact ``contains(text, module)`` join by equi-joins on whole modules.

    A module's class is the greatest power of two that its length reaches. A
    text's windows of each class length meet the modules' first windows; only
    where one fits, the text is cut to each length that such modules have, and
    the cut must equal the module. So a pair meets by the whole module, once for
    each place where it occurs: candidates are hits, however many modules share
    their beginning or how often a short run of characters occurs. Returns
    distinct (module, text).
    """
    m = needles.select(F.col(needle_col).alias("module")).where(F.length("module") > 0).distinct()
    t = hay.select(F.col(hay_col).alias("text")).where(F.length("text") > 0).distinct()
    # 1, 2, 4, ...: whole numbers only, no rounding of logarithms
    m = m.withColumn("class", F.expr("shiftleft(1, length(bin(length(module))) - 1)"))
    firsts = m.select("class", F.expr("substring(module, 1, class)").alias("window"), F.length("module").alias("n")).distinct()
    classes = sorted(r[0] for r in m.select("class").distinct().collect())  # at most 31 powers of two
    if not classes:
        return t.limit(0).select(F.col("text").alias("module"), "text")
    sizes = F.array(*[F.lit(c) for c in classes])
    places = t.select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"), F.length("text").alias("all"))
    windows = places.select("text", "at", "all", F.explode(sizes).alias("class")).where("at + class - 1 <= all").withColumn(
        "window", F.expr("substring(text, at, class)"))
    cut = windows.join(spread(firsts), ["class", "window"]).where("at + n - 1 <= all").select("text", F.expr("substring(text, at, n)").alias("module"))
    return cut.distinct().join(spread(m.select("module")), "module", "left_semi").select("module", "text")


def imported_module_prefixes(imports: DataFrame) -> DataFrame:
    """(path, prefix): every dot-boundary prefix of every dotted name an import
    statement brings in (``from a.b import c`` -> a, a.b, a.b.c)."""
    t = F.regexp_replace(F.col("import_text"), r"[()\\\n]", " ")
    base = F.regexp_extract(t, r"^\s*from\s+([\w.]+)\s+import\s", 1)
    names = F.regexp_extract(t, r"^\s*(?:from\s+[\w.]+\s+)?import\s+(.*)$", 1)
    items = F.transform(F.split(names, ","), lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+\w+$", ""))
    full = F.when(base != "", F.array_union(F.array(base), F.transform(items, lambda x: F.concat_ws(".", base, x)))
                  ).otherwise(items)
    dotted = imports.select("path", F.explode(full).alias("name")).where(F.col("name").rlike(r"^[\w.]+$"))
    return dotted.select("path", F.explode(F.expr(
        "transform(sequence(1, size(split(name, '[.]'))), i -> array_join(slice(split(name, '[.]'), 1, i), '.'))"
    )).alias("prefix")).distinct()


def dependents_of(imports: DataFrame, files: DataFrame, path_col: str = "path",
                  mode: str = "contains") -> DataFrame:
    """Files whose import text contains the target file's dotted module
    (mode ``contains``, Q12), or whose imported module equals it or starts
    with it plus '.' (mode ``module``).  Returns distinct (file, dependent)."""
    targets = files.select(F.col(path_col).alias("file")).distinct().withColumn("module", module_of(F.col("file")))
    if mode == "module":
        pref = imported_module_prefixes(imports)
        return (targets.join(pref, targets["module"] == pref["prefix"])
                       .select("file", F.col("path").alias("dependent")).distinct())
    hits = substring_matches(targets, imports.select(F.col("import_text").alias("text")))
    return (targets.join(spread(hits), "module")
                   .join(spread(imports), F.col("text") == imports["import_text"])
                   .select("file", F.col("path").alias("dependent")).distinct())


# ---------------------------------------------------------------- G10, G11
def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where(
        F.col("src") != F.col("dst")).distinct()


def graph_expand(seeds: DataFrame, edges: DataFrame, depth: int = BFS_DEPTH,
                 budget: int = MAX_SYMBOLS, materialize_steps: bool | None = None) -> DataFrame:
    """G10 + G11: BFS over callers and callees from each query's seeds.

    seeds(query_id, symbol) -> (query_id, rank, symbol, hop, score), the top
    ``budget`` nodes by (score desc, symbol asc); score 1.0 for seeds and
    ``max(0, 1 - 0.2 * hop)`` for a node first reached at ``hop``.

    Exact pruning.  While hop scores strictly fall (hop <= 5), a query whose
    visited set already holds ``budget`` nodes can gain nothing from later
    hops, so it stops.  For a query still below the budget, with ``v`` nodes
    visited, the new nodes it keeps are its ``budget - v`` smallest; a node x
    among them reached from frontier node f has fewer than ``v + budget - v``
    = ``budget`` neighbours of f before it, so each node's ``budget`` smallest
    neighbours suffice.  Per query and hop the work is then at most
    ``budget`` frontier nodes x ``budget`` neighbours, whatever the degree of
    a hub.  Deeper walks (ties at score 0) run unpruned.

    The (pruned) neighbour lists are computed once and kept, so the edges are
    read once whatever the depth; with ``materialize_steps`` (default beyond one
    hop) the visited set, read three times per hop, is kept after each hop too (at
    most queries x budget rows while pruning), so neither the plan nor the work
    grows per hop.
    """
    prune = depth <= 5
    if materialize_steps is None:
        materialize_steps = depth > 1
    und = undirected(edges)
    if prune:
        wn = Window.partitionBy("src").orderBy(F.col("dst").asc())
        und = und.withColumn("_rn", F.row_number().over(wn)).where(F.col("_rn") <= budget).drop("_rn")
    und = materialize(und)
    visited = seeds.select("query_id", "symbol").distinct().withColumn("hop", F.lit(0))
    if materialize_steps:
        visited = materialize(visited)
    for h in range(depth):
        frontier = visited.where(F.col("hop") == h)
        if prune:
            active = (visited.groupBy("query_id").agg(F.count("*").alias("_n"))
                             .where(F.col("_n") < budget).select("query_id"))
            frontier = frontier.join(spread(active), "query_id", "left_semi")
        step = (frontier.join(spread(und), frontier["symbol"] == und["src"])
                        .select("query_id", F.col("dst").alias("symbol")).distinct())
        new = step.join(spread(visited), ["query_id", "symbol"], "left_anti").withColumn("hop", F.lit(h + 1))
        visited = visited.unionByName(new)
        if materialize_steps and h < depth - 1:
            # long walks also cut the lineage with a reliable checkpoint
            visited = materialize(visited)
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(HOP_DECAY) * F.col("hop"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("symbol").asc())
    return (visited.withColumn("score", F.when(F.col("hop") == 0, F.lit(1.0)).otherwise(score))
                   .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= budget)
                   .select("query_id", "rank", "symbol", "hop", "score"))


# ---------------------------------------------------------------- G12
def related_files(imports: DataFrame, hit_files: DataFrame, mode: str = "contains") -> DataFrame:
    """Per query, dependencies (import text) and dependents (paths) of its
    hit files, and their union as ``related`` (mixed domain, as in the
    reference).  hit_files(query_id, path) -> (query_id, kind, item)."""
    files = hit_files.select("path").distinct()
    deps = dependencies_of(imports, files).select("file", F.col("import_text").alias("item"))
    dnts = dependents_of(imports, files, mode=mode).select("file", F.col("dependent").alias("item"))
    hf = hit_files.select("query_id", F.col("path").alias("file")).distinct()
    d = hf.join(spread(deps), "file").select("query_id", F.lit("dependency").alias("kind"), "item")
    t = hf.join(spread(dnts), "file").select("query_id", F.lit("dependent").alias("kind"), "item")
    both = d.union(t)
    rel = both.select("query_id", F.lit("related").alias("kind"), "item")
    return both.union(rel).distinct()
