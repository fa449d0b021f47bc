"""Secret scans with a random forest against false positives (DataFrame functions only).

Candidates are pieces of text that could be a credential: private key blocks,
providers' fixed forms and signed web tokens, the values (six characters or more)
of assignments to names that hold a word like password or token, with any
white space around the sign, credentials in URLs, and long runs of key
characters with a digit. A forest rates every candidate on its
length, its character transitions, how much of it is covered by frequent
words of the corpus, the name or path before it, and its neighbouring words.

What is kept: forms that prove themselves whatever the forest says; named values
and URL credentials unless there is evidence against them (a placeholder,
nothing but letters or digits) and the forest takes them for false too;
all others if the forest takes them for secrets. ``redact`` replaces what is kept.

The forest is trained on labelled findings: a built-in table (``lessons``: values
of many lengths from a rule, in the contexts of true and of false findings) and a
bounded sample of the corpus's candidates that prove themselves (``TRAIN_ROWS`` at
most, by a hash limit found from counts, so no task sends more than its share).

Candidates are found once and written beside the text; they stay in their
document's row: the forest is written out as one expression over their features,
so nothing is shuffled but the training sample and the word counts for the
dictionary, which are aggregated first.

Defined results: null or empty texts have no candidates; repeated rows get equal
results; null ids are kept; shorter values than six characters and unnamed runs
under 16 are no candidates; extra columns pass through unless named like a result
column (``n_candidates``, ``findings``), which replaces them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, shared_table

TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 15, 6, 11
#: Values of the built-in table, each in all of its contexts.
LESSONS = 60
#: Words of the dictionary: the most frequent ones of the corpus.
DICTIONARY = 2000
REDACTED = "[REDACTED]"
#: What comes before, the candidate, and what follows; a candidate is a key-shaped token or an assigned value.
_NAME = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
_KEYS = r"[A-Za-z0-9+/_\-]"
#: Forms that prove themselves: providers' keys, signed web tokens, private key blocks.
_PROVIDER = (r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[0-9A-Za-z-]{20,}|sk_live_[0-9A-Za-z]{20,}"
             r"|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*)")
_BLOCK = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\\\-]*?-----END [A-Z ]{0,20}PRIVATE KEY-----"
#: A name, wherever it stands in a longer one (DB_PASSWORD, client_secret, secretKey), and the sign of an assignment.
_NAMED = rf"{_NAME}[A-Za-z0-9_\-]{{0,20}}(?:\\?[\"'])?\s*(?::=|=>|==|=|:)\s*(?:\\?[\"'])?"
#: The user's name in a URL with a password, or a URL's only credential.
_URL = rf"://(?!{_PROVIDER})(?:[^\s/:@\"'<>]*:)?"
_ASSIGNED = rf"{_NAMED}(?![A-Za-z0-9_\-]{{0,20}}?{_NAMED})[^\s\"']{{6,}}"
CANDIDATE = (rf"(?:{_BLOCK}|{_ASSIGNED}"
             rf"|{_URL}[^\s/:@\"'<>][^\s/@\"'<>]{{5,}}(?=@)"
             rf"|(?<![A-Za-z0-9]){_PROVIDER}(?![A-Za-z0-9])"
             rf"|(?<!{_KEYS})(?=[A-Za-z+/_\-]*[0-9])(?![+/_\-]+{_PROVIDER})(?!{_KEYS}{{0,60}}?{_ASSIGNED}){_KEYS}{{16,}})")
_AROUND = rf"(\S{{0,40}}?[ \t]?)({CANDIDATE})(?=(\s?\S{{0,40}}))"
_FEATURES = ("length", "digits", "uppers", "lowers", "others", "switches", "repeats", "distinct", "covered", "named", "path", "before", "after",
             "address", "checksum", "uuid")
#: What no credential says of itself.
_PLACEHOLDER = r"(?i)example|placeholder|changeme|change_me|your[_-]|x{6}|\*{3}|^<.*>?$|^\$[{(]|^%[({]|^\{\{"
#: Words before a run that name a checksum or a version, not a credential.
_CHECKSUM = r"(?i)(?:^|[^a-z])(?:commit|sha-?[0-9]*|md5|crc|rev(?:ision)?|hash|checksum|digest|tree|parent|etag|index|blob|merge|uuid|guid|id|version|build)[:=\s\"'(]*$"
_UUID = r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def _value(hit: Column) -> Column:
    """The secret part of a candidate: what follows the assignment, or all of it, without closing marks."""
    return F.regexp_replace(F.regexp_replace(hit, rf"^(?:{_NAMED}|{_URL})", ""), r"[.,;:)\]}>]+$", "")


def _named(hit: Column) -> Column:
    """Whether a name or a URL says that the value is a credential."""
    return hit.rlike(rf"^(?:{_NAMED}|://[^\s/:@]*:)")


def _address(c: Column) -> Column:
    """Whether the candidate is what stands before the sign of a mail address."""
    return c["after"].startswith("@") & ~c["hit"].startswith("://")


def candidates(text: Column) -> Column:
    """array<struct<hit, value, before, after>> of a text, in order."""
    t = F.coalesce(text, F.lit(""))
    before, hit, after = (F.regexp_extract_all(t, F.lit(_AROUND), F.lit(i)) for i in (1, 2, 3))
    found = F.when(t.rlike(CANDIDATE), F.transform(
        F.arrays_zip(before.alias("before"), hit.alias("hit"), after.alias("after")),
        lambda c: F.struct(c["hit"].alias("hit"), _value(c["hit"]).alias("value"), c["before"].alias("before"), c["after"].alias("after"))))
    return F.coalesce(found, F.array().cast("array<struct<hit:string,value:string,before:string,after:string>>"))


def _features(c: Column, dictionary: Column) -> dict[str, Column]:
    v = c["value"]
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    chars = F.split(v, "")
    parts = F.filter(F.split(F.lower(v), r"[^\p{L}]+"), lambda p: F.length(p) >= 3)
    letters = F.aggregate(F.filter(parts, lambda p: F.array_contains(dictionary, p)), F.lit(0), lambda a, p: a + F.length(p))
    switch = r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"
    return {
        "length": n, "digits": _count(v, "[0-9]") / n, "uppers": _count(v, r"\p{Lu}") / n, "lowers": _count(v, r"\p{Ll}") / n,
        "others": _count(v, r"[^0-9\p{L}]") / n, "switches": _count(v, switch) / n, "repeats": _count(v, r"(.)(?=\1)") / n,
        "distinct": F.size(F.array_distinct(chars)).cast("double") / F.least(n, F.lit(40.0)), "covered": letters.cast("double") / n,
        "named": _named(c["hit"]).cast("double"),
        "path": F.concat(c["before"], v).rlike(r"/[^/\s]+/|\\|://|\.[a-z]{2,4}$").cast("double"),
        "before": F.array_contains(dictionary, F.lower(F.regexp_replace(F.trim(c["before"]), r"[^\p{L}]", ""))).cast("double"),
        "after": F.array_contains(dictionary, F.lower(F.regexp_replace(F.trim(c["after"]), r"[^\p{L}]", ""))).cast("double"),
        "address": _address(c).cast("double"), "checksum": c["before"].rlike(_CHECKSUM).cast("double"), "uuid": v.rlike(_UUID).cast("double"),
    }


def _proven(c: Column) -> Column:
    """Forms that no other text has."""
    return c["value"].rlike(rf"^(?:{_PROVIDER}|{_BLOCK})$")


def _against(c: Column) -> Column:
    """Evidence that a candidate is no secret, whatever its name."""
    v = c["value"]
    words = v.rlike(r"^\p{L}*$") & (_count(v, "[a-z](?=[A-Z])") < 3)  # letters alone, but for runs of changing case
    return v.rlike(r"^[0-9_\-]*$") | words | v.rlike(_PLACEHOLDER) | _address(c)


def proof_labels(c: Column) -> Column:
    """1 or 0 where a candidate proves itself, else null."""
    v = c["value"]
    named = _named(c["hit"])
    checksum = ~named & (v.rlike(_UUID) | (c["before"].rlike(_CHECKSUM) & v.rlike(r"^[0-9A-Fa-f\-]+$")) | v.rlike(r"^/?(?:[a-z_\-]+/){2,}[a-z_\-]*[0-9]*$"))
    true = named & v.rlike(r"\p{L}") & (v.rlike("[0-9]") | (_count(v, "[a-z](?=[A-Z])") >= 3))
    return F.when(_proven(c), 1.0).when(_against(c) | checksum, 0.0).when(true, 1.0)


def lessons(spark) -> DataFrame:
    """Labelled findings (hit, value, before, after, label): for i = 0, 1, ... values of 6 to 60 characters made of digests of i,
    in the contexts of true findings (names, URLs, loose keys of mixed case) and of false ones (checksums after their names,
    ids, numbers, paths, file names, times, words, placeholders)."""
    i, text = F.col("id"), F.col("id").cast("string")
    mixed = F.regexp_replace(F.concat(F.base64(F.unhex(F.sha2(text, 256))), F.base64(F.unhex(F.sha2(F.concat(text, F.lit("b")), 256)))), "[+/=]", "")
    # the first digit and letter of a value come early, so the shortest are true ones too
    short = F.concat(F.substring(F.translate(mixed, "0123456789", "abcdefghij"), 1, 2), (i % 10).cast("string"), mixed)
    size = (6 + i % 55).cast("int")
    value = F.left(short, size)
    hexed, sha1 = F.left(F.sha2(text, 256), 12 + 4 * (i % 14).cast("int")), F.sha1(text)
    marked = F.concat(F.left(value, F.lit(5)), F.element_at(F.array(*[F.lit(x) for x in "@!&.$"]), (i % 5 + 1).cast("int")), F.substring(value, 6, 60))
    uuid = F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    words = F.array_join(F.transform(F.sequence(F.lit(0), i % 3 + 1), lambda k: F.element_at(
        F.array(*[F.lit(w) for w in ("service", "static", "images", "module", "chapter", "report", "default")]), ((k + i) % 7 + 1).cast("int"))), "/")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    true = [join("password = ", value, " end"), join('client_secret: "', value, '"'), join("DB_PASSWORD=", marked), join("'secretKey' => '", value, "',"),
            join("api_key=", value, "\n"), join("token := ", hexed), join('auth_token = "', sha1, '" and'), join("postgres://user:", marked, "@host/db"),
            join("access_key=", F.left(F.translate(mixed, "0123456789", "QrStUvWxYz"), 16 + (i % 40).cast("int"))),
            join("key ", F.left(short, 24 + (i % 37).cast("int")), " used"), join("PRIMARY_TOKEN1=", F.lower(value))]
    false = [join("commit ", sha1, " by"), join("sha256: ", F.sha2(text, 256)), join("id ", uuid, " of"), join("see /usr/", words, "/v", (i % 90).cast("string"), " there"),
             join("call 0", F.left(F.conv(F.left(F.sha1(text), F.lit(12)), 16, 10), 9 + (i % 9).cast("int")), "4711000 now"),
             join(words, "/img_2024010", (i % 9).cast("string"), "_", text, "_large.jpg"), join("at 2024-01-01T0", (i % 9).cast("string"), "-00-00-000000Z then"),
             join("password: ", F.replace(words, F.lit("/"), F.lit("")), " field"), join("token = your_token_", text), join("revision=", hexed, " tree"),
             join("file_name_with_many_parts_", text, "_and_more ok"), join("api_key = <your-key-", text, ">"), join("md5 (", F.md5(text), ")"),
             join("/opt/", words, "/release-", text, "/bin-x86-64")]
    lines = spark.range(LESSONS).select(F.explode(F.array(*[F.struct(t.alias("text"), F.lit(1.0).alias("label")) for t in true],
                                                          *[F.struct(t.alias("text"), F.lit(0.0).alias("label")) for t in false])).alias("line"))
    return lines.select(F.explode(candidates(F.col("line.text"))).alias("c"), "line.label").select("c.*", "label")


def _top(counted: DataFrame, n: int) -> DataFrame:
    """Rows of (w, count) that hold the ``n`` largest counts, and few others: a limit on the count, found from a histogram."""
    step = F.floor(F.log2("count") * 16)
    size, least = 0, None
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("count").alias("least")).collect(), key=lambda r: -r.step):
        size, least = size + r.n, r.least
        if size >= n:
            break
    return counted.limit(0) if least is None else counted.where(F.col("count") >= least)


def dictionary_words(docs: DataFrame, text_col: str) -> list[str]:
    """The corpus's most frequent words of three letters and more (counted over all texts; ties by word)."""
    word = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("w")).where(F.length("w") >= 3)
    counted = shared_table(word.groupBy("w").agg(F.count("*").alias("count")).where("count > 1"), "word-counts")
    return [r.w for r in _top(counted, DICTIONARY).orderBy(F.desc("count"), "w").limit(DICTIONARY).collect()]


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` distinct labelled findings, those of the smallest hashes: the limit comes from counts of 4096 ranges."""
    one = labelled.where("label IS NOT NULL").select("hit", "value", "before", "after", "label").distinct()
    one = one.withColumn("_part", F.pmod(F.xxhash64("hit", "before", "after"), F.lit(4096)))
    size = limit = 0
    for r in sorted(one.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        if size + r["count"] > rows:
            break
        size, limit = size + r["count"], r["_part"] + 1
    return one.where(F.col("_part") < limit).drop("_part")


def _tree(lines: list[str]):
    """The next subtree of a printed tree: a class, or (feature, threshold, left, right)."""
    line = lines.pop(0)
    if m := re.fullmatch(r"Predict: (\S+)", line):
        return float(m[1])
    m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
    left = _tree(lines)
    lines.pop(0)  # Else (...)
    return int(m[1]), float(m[2]), left, _tree(lines)


def fit(sample: DataFrame):
    """Spark's forest from rows with the feature columns and ``label``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    ready = VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(sample).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(ready)


def written(model) -> list:
    """The trees of a forest, as nested tuples."""
    return [_tree([x.strip() for x in t.toDebugString.splitlines()[1:] if x.strip()]) for t in model.trees]


def rating(forest: list, c: Column, dictionary: Column) -> Column:
    """Share of the trees that take candidate ``c`` for a secret."""
    def votes(f):
        def walk(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(f[_FEATURES[t[0]]] <= t[1], walk(t[2])).otherwise(walk(t[3]))
        total = walk(forest[0])
        for t in forest[1:]:
            total = total + walk(t)
        return total / len(forest)
    return let(F.struct(*[x.alias(k) for k, x in _features(c, dictionary).items()]), votes)


def kept(c: Column) -> Column:
    """Whether a rated candidate is a finding."""
    return _proven(c) | (c["rating"] >= 0.5) | (_named(c["hit"]) & ~_against(c))


def scan(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``n_candidates`` and ``findings`` (array of hit, value and rating of the candidates kept).

    ``labelled``: rows hit, value, before, after, label that are learned beside ``lessons``; by default the candidates of
    ``docs`` that prove themselves."""
    own = [c for c in docs.columns if c.lower() not in ("n_candidates", "findings")]
    dictionary = F.split(F.lit(" ".join(dictionary_words(docs, text_col))), " ")
    # one struct for the caller's columns: no name of theirs meets one of ours
    found = shared_table(docs.select(F.struct(*own).alias("own"), candidates(F.col(text_col)).alias("found")), "secret-candidates")
    if labelled is None:
        each = found.select(F.explode("found").alias("c"))
        labelled = each.select("c.*", proof_labels(F.col("c")).alias("label"))
    rows = _sample(labelled, TRAIN_ROWS).unionByName(lessons(docs.sparkSession))
    c = F.struct("hit", "value", "before", "after")
    sample = rows.select(F.col("label").cast("double").alias("label"), *[x.alias(k) for k, x in _features(c, dictionary).items()])
    forest = written(fit(shared_table(sample, "secret-findings").coalesce(1)))
    rated = F.transform("found", lambda x: F.struct(x["hit"].alias("hit"), x["value"].alias("value"), x["after"].alias("after"),
                                                    rating(forest, x, dictionary).alias("rating")))
    shown = F.transform(F.filter(rated, kept), lambda x: F.struct(x["hit"], x["value"], x["rating"]))
    return found.select("own.*", F.size("found").cast("long").alias("n_candidates"), shown.alias("findings"))


def redact(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """The text with every occurrence of every finding's value replaced, longer values first."""
    values = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["value"])), lambda a, b: F.length(b) - F.length(a))
    return scanned.withColumn(text_col, F.when(F.size("findings") > 0, F.aggregate(
        F.filter(values, lambda v: v != ""), F.col(text_col), lambda t, v: F.replace(t, v, F.lit(REDACTED)))).otherwise(F.col(text_col)))
