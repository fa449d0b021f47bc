"""Quality rules by weak supervision (DataFrame functions only).

Every document gets a vote (good 1, bad -1, abstain 0) from each rule. The
rules' class-wise accuracies and the share of good documents are estimated by
expectation-maximisation over the vote patterns; the posterior probability of
"good" then replaces the rule that every check must pass.

Cost: one pass computes the features of a document inside its own row (no
text is shuffled); they are kept as a narrow shared table. Documents are
pre-aggregated to vote patterns, of which there are at most 3 ** 9 = 19683
(in fact 768, as eight of the nine rules vote one way only)
whatever the corpus size; EM runs over those in a single row, and the
posteriors return by a broadcast join of that bounded table.

Defined results: a null or empty text has no words, counts of 0 and
``base_failed``; null ids and repeated rows are scored like any other row;
extra columns pass through ``quality_rules`` unless they carry the name of a
result column, which then replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, let, shared_table

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks")
#: rule -> (votes bad if, votes good if); it abstains on anything else. All in whole numbers.
RULES = {
    "length": ("n_words < 50", None),
    "symbols": ("10 * n_symbols > n_words", None),
    "case": ("2 * n_upper > n_lower", None),
    "marks": ("5 * n_marks > n_words", None),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words AND n_words > 0"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", None),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 12 * n_words", None),
    "clean_marks": (None, "100 * n_symbols <= n_words AND 50 * n_marks <= n_words AND n_words > 0"),
    "mixed_case": (None, "5 * n_upper <= n_lower AND n_lower > 0"),
}
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
ITERATIONS = 12
#: EM starts: share of good documents; chances of a contradicting, no, and an agreeing vote.
START_PRIOR, START = 0.8, (0.05, 0.35, 0.6)
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")


def _kept_chars(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more.

    Windows are compared by 64-bit hash. Texts whose windows are all distinct
    are done after one hash set; of the others, few repeated windows are looked
    up directly, many are found by sorting windows with their positions, where
    equal ones become neighbours (both ways give the same positions). The
    covered words are the sum of min(3, gap) over the repeated positions."""
    zero = F.lit(0).cast("long")

    def windows(w):
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.size(w) - 2)

    def covered(p):
        gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, zero, lambda a, g: a + g)

    def by_sort(s):
        return F.array_sort(F.array_compact(F.transform(s, lambda x, i: F.when(
            (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"]), x["p"]))))

    def repeated(s):
        return F.array_distinct(F.array_compact(F.transform(s, lambda x, i: F.when(x == F.get(s, i - 1), x))))

    def count(g):
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p"))))
        few = lambda d: F.array_compact(F.transform(g, lambda x, i: F.when(F.array_contains(d, x), i)))
        some = let(let(F.sort_array(g), repeated), lambda d: F.when(F.size(d) <= 40, let(few(d), covered)).otherwise(
            let(pairs, lambda v: let(by_sort(v), covered))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), zero).otherwise(some)

    return let(words, lambda w: F.when(F.size(w) < 4, zero).otherwise(let(windows(w), count)))


def features(text: Column) -> Column:
    """A struct of the counts the rules use, over the whole text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = let(F.array_remove(F.split(t, SPACE_RE, -1), ""), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    counted = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        out.alias("w"), counted.alias("l"),
        _kept_chars(t, SPACE_RE).alias("word_chars"), _kept_chars(t, r"[^#*$%&|<>]+").alias("n_symbols"),
        _kept_chars(t, r"[^\p{Lu}]+").alias("n_upper"), _kept_chars(t, r"[^\p{Ll}]+").alias("n_lower"),
        _kept_chars(t, r"[^!?|]+").alias("n_marks"))


def _votes() -> Column:
    cases = [f"CASE WHEN {bad or 'false'} THEN -1 WHEN {good or 'false'} THEN 1 ELSE 0 END" for bad, good in RULES.values()]
    return F.expr(f"array({', '.join(cases)})")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the feature columns, ``base_failed`` and ``votes``."""
    out = docs.withColumn("_quality", features(F.col(text_col)))
    at = {"n_words": "_quality.w.n_words", "n_repeat_words": "_quality.w.n_repeat_words",
          "n_lines": "_quality.l.n_lines", "n_dup_lines": "_quality.l.n_dup_lines"}
    out = out.withColumns({c: F.col(at.get(c, f"_quality.{c}")) for c in FEATURES}).drop("_quality")
    return out.withColumns({"base_failed": F.expr(BASE_FAILED), "votes": _votes()})


def posterior(votes: Column, model: Column) -> Column:
    """Probability of "good" for one vote pattern."""
    terms = F.zip_with(votes, model["rules"], lambda v, r: F.log(r["good"][v + 1] / r["bad"][v + 1]))
    odds = F.log(model["prior"] / (1 - model["prior"])) + F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.exp(-odds))


def fit(votes: DataFrame) -> DataFrame:
    """One row (model, patterns) from a table with a column ``votes``.

    ``model.rules`` holds, for each rule and class, the chances that it votes
    bad, abstains or votes good, each count smoothed by one; ``accuracy`` of a
    rule follows as the share of its votes that agree with the class."""
    patterns = votes.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    chances = lambda xs: F.array(*map(F.lit, xs))
    start = F.struct(F.lit(START_PRIOR).alias("prior"), F.array(*[
        F.struct(chances(START).alias("good"), chances(START[::-1]).alias("bad")) for _ in RULES]).alias("rules"))

    def total(xs: Column, f) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))

    def step(model, _):
        scored = F.transform(F.col("patterns"), lambda p: let(posterior(p["votes"], model), lambda q: F.struct(
            p["votes"].alias("votes"), (p["n"] * q).alias("good"), (p["n"] * (1 - q)).alias("bad"))))

        def refit(ps):
            def share(r, side, all_):
                return F.array(*[(total(ps, lambda p, v=v: F.when(p["votes"][r] == v, p[side]).otherwise(0.0)) + 1) / (all_ + 3)
                                 for v in (-1, 0, 1)])
            def rules(all_):
                return F.array(*[F.struct(share(r, "good", all_["good"]).alias("good"), share(r, "bad", all_["bad"]).alias("bad"))
                                 for r in range(len(RULES))])
            sums = F.struct(total(ps, lambda p: p["good"]).alias("good"), total(ps, lambda p: p["bad"]).alias("bad"))
            return let(sums, lambda a: F.struct(((a["good"] + 1) / (a["good"] + a["bad"] + 2)).alias("prior"), rules(a).alias("rules")))
        return let(scored, refit)

    return one.select("patterns", F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), start, step).alias("model"))


def accuracies(model: DataFrame) -> DataFrame:
    """(rule, accuracy): share of the rule's expected votes that agree with the class; null if it never votes."""
    p = F.col("model.prior")
    right = lambda r: p * r["good"][2] + (1 - p) * r["bad"][0]
    wrong = lambda r: p * r["good"][0] + (1 - p) * r["bad"][2]
    rows = F.arrays_zip(F.array(*map(F.lit, RULES)).alias("rule"), F.transform(
        F.col("model.rules"), lambda r: right(r) / (right(r) + wrong(r))).alias("accuracy"))
    return model.select(F.inline(rows).alias("rule", "accuracy"))


def quality_rules(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the counts, ``base_failed``,
    ``posterior`` (rounded to 6 places) and ``kept``."""
    carry = [c for c in (keep or docs.columns) if c.lower() not in {*FEATURES, *RESULT, "votes"}]
    measured = shared_table(measure(docs.select(*{*carry, text_col}), text_col)
                            .select(*carry, *FEATURES, "base_failed", "votes"), "quality")
    model = fit(measured.select("votes"))
    table = model.select(F.explode("patterns").alias("p"), "model").select(
        F.col("p.votes").alias("votes"), F.round(posterior(F.col("p.votes"), F.col("model")), 6).alias("posterior"))
    return (measured.join(F.broadcast(table), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
            .select(*carry, *RESULT))
