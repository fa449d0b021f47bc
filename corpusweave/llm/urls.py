"""URL filters that see through redirects (DataFrame functions only).

1. Rules. A rule (host, path, verdict) fits a URL on its host or a subdomain
   whose path starts with the rule's; the longest fitting rule decides. Rules
   are met by equi-joins alone: each host's suffixes against the rule hosts,
   then the path cut to each length that the rule host has.
2. Links. A page's head names other URLs of itself: ``<link rel=canonical>`` is
   a canonical link, ``<meta http-equiv=refresh>`` a redirect; a table of
   redirects (``source``, ``target``, from a crawl's 30x records) adds to them.
   Relative targets are resolved against the page's URL.
3. Aliases. Connected components over these links (URLs that differ only in
   scheme, default port, an empty path or fragment are one node).
4. Verdicts. A URL's own rule decides: an explicit allow holds whatever its
   aliases are. Without a rule it is blocked if any alias is blocked by a rule,
   whether that alias was crawled or only linked; else it is allowed.

Repeated URLs are judged once, and no group is collected: a URL, host or link
target with a third of all rows is aggregated map-side and joined.

Defined results: null URLs, and those without ``://``, have empty host and path,
no rule and no aliases, and are allowed; null and empty html has no links; links
in comments, scripts, styles and after ``<body`` do not count, nor do empty,
``javascript:`` and other targets without a host; dot segments are not resolved;
repeated rows and null ids are judged like any other; equally long rules: allow
first, then the smaller rule text; empty tables give empty results. ``keep``
columns pass through; one that is named like a result column is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_table
from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("host", "path", "rule", "verdict")
#: White space of HTML and the value of an attribute, quoted or not.
_S = r"[\x20\x09-\x0D]"
_VALUE = rf"""{_S}*={_S}*("[^"]*"|'[^']*'|[^\x20\x09-\x0D"'>]+)"""


def lower(c: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """One name for a resource: host without default port, path ('/' if empty) and query. Null without a host."""
    host = F.nullif(F.regexp_replace(host_of(url), r"\.?(:80|:443|:)?\z", ""), F.lit(""))
    rest = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), r"^(?=[?]|\z)", "/")
    return F.concat(host, rest)


def rules(spark: SparkSession, lines: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (host, path, verdict) tuples."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).alias(c) for v, c in zip(line, ("host", "path", "verdict"))]) for line in lines])))


def _attribute(name: str) -> Column:
    got = F.regexp_extract("tag", rf"""(?i)[\x20\x09-\x0D"'/]{name}{_VALUE}""", 1)
    return F.replace(F.trim(F.translate(F.regexp_replace(got, r"""^["']|["']$""", ""), "\t\n\x0b\x0c\r", "     ")), F.lit("&amp;"), F.lit("&"))


def resolved(links: DataFrame) -> DataFrame:
    """(source, target) with every ``target`` as an absolute URL, seen from ``source``; those that name no host go."""
    source, target = F.col("source"), F.col("target")
    # in steps, so that no step repeats the work of the one before
    df = links.withColumns({"_path": path_of(source), "_scheme": F.regexp_extract(source, r"^([^:/?#]*):", 1),
                            "_site": F.nullif(F.regexp_extract(source, r"^[^:/?#]*://[^/?#]*", 0), F.lit(""))})
    df = df.withColumns({"_folder": F.when(F.col("_path") == "", "/").otherwise(F.regexp_extract("_path", r"^(.*/)", 1))})
    absolute = (F.when(target.rlike(r"(?i)^https?://[^/?#]"), target)
                .when(F.col("_site").isNull() | (target == "") | target.rlike(r"^(//[/?#]|//$|[^/?#]*:)"), None)
                .when(target.rlike(r"^//"), F.concat("_scheme", F.lit(":"), target))
                .when(target.rlike(r"^/"), F.concat("_site", target))
                .when(target.rlike(r"^[?]"), F.concat("_site", "_path", target))
                .when(target.rlike(r"^#"), F.concat("_site", "_path"))
                .otherwise(F.concat("_site", "_folder", F.regexp_replace(target, r"^(\./)+", ""))))
    return df.select("source", absolute.alias("target")).where("target IS NOT NULL")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) URLs of the canonical links and refresh redirects in the pages' heads."""
    text = F.col(html)
    some = pages.where(text.rlike("(?i)canonical|http-equiv") & F.col(url).isNotNull()).select(F.col(url).alias("source"), text.alias("_html"))
    head = F.regexp_replace("_html", r"(?s)<!--.*?-->", " ")
    head = F.regexp_replace(head, r"(?is)<(script|style)[\x20\x09-\x0D>].*?</(script|style)", " ")
    head = F.regexp_extract(head, r"(?is)^(.*?)(<body[\x20\x09-\x0D>/]|$)", 1)
    tags = some.select("source", F.explode(F.regexp_extract_all(head, F.lit(r"(?i)<(?:link|meta)[\x20\x09-\x0D/][^>]*>"), 0)).alias("tag"))
    tags = tags.withColumns({"_link": F.col("tag").rlike("(?i)^<link"), "_rel": lower(_attribute("rel")), "_href": _attribute("href"),
                             "_equiv": lower(_attribute("http-equiv")), "_content": _attribute("content")})
    wanted = F.regexp_extract("_content", rf"""(?i)^[0-9.]*{_S}*[;,]{_S}*url{_S}*={_S}*["']?([^"']*)""", 1)
    target = F.when(F.col("_link") & F.array_contains(F.split("_rel", " +"), "canonical"), F.col("_href")).when(
        ~F.col("_link") & (F.col("_equiv") == "refresh"), wanted)
    # written, so that the html is read once and each step stays small
    return resolved(shared_table(tags.select("source", target.alias("target")).where("target != ''").distinct(), "page-links")).distinct()


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the distinct (host, path) of ``urls`` that a rule fits."""
    rules = rules.select(lower("host").alias("r_host"), F.col("path").alias("r_path"), "verdict").where("r_host != ''")
    lengths = rules.select("r_host", F.length("r_path").alias("r_length")).distinct()
    part = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, i, F.size(part)), "."))
    hosts = urls.select("host").where("host != ''").distinct().withColumn("r_host", F.explode(F.array_distinct(suffixes)))
    fitting = urls.select("host", "path").distinct().join(hosts.join(lengths, "r_host"), "host").where(F.length("path") >= F.col("r_length"))
    fitting = fitting.withColumn("r_path", F.expr("substring(path, 1, r_length)")).join(rules, ["r_host", "r_path"])
    rule = F.concat("r_host", "r_path")
    best = F.min(F.struct((-F.length(rule)).alias("l"), (F.col("verdict") != "allow").alias("v"), rule.alias("rule"), "verdict")).alias("best")
    return fitting.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def url_verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html",
                 keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of every row of ``pages`` with host, path, rule and verdict."""
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    clash = [c for c in keep if c.lower() in RESULTS]
    if clash:
        raise ValueError(f"columns {clash} are named like results")
    u = F.col(url)
    place = lambda c: [F.coalesce(host_of(c), F.lit("")).alias("host"), F.coalesce(path_of(c), F.lit("")).alias("path")]
    rows = pages.select(F.struct(*keep).alias("own"), *place(u), node_of(u).alias("node"))

    links = [page_links(pages, url, html)] if html else []
    links += [redirects.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL")] if redirects is not None else []
    if links:
        both = links[0] if len(links) == 1 else links[0].union(links[1])
        both = shared_table(both, "links").withColumns({"a": node_of(F.col("source")), "b": node_of(F.col("target"))}).where("a IS NOT NULL AND b IS NOT NULL")
        linked = both.select(*place(F.col("source")), F.col("a").alias("node")).union(both.select(*place(F.col("target")), F.col("b").alias("node")))
        roots = components(both.select("a", "b"))
    else:
        spark = pages.sparkSession
        linked, roots = rows.select("host", "path", "node").limit(0), spark.createDataFrame([], "node string, root string")
    nodes = rows.select("host", "path", "node").where("node IS NOT NULL").union(linked).distinct()
    judged = shared_table(judge(nodes, rules), "judged-urls")

    # one row for each class that a rule blocks, and for each node of such a class
    blocked = nodes.join(judged.where("verdict = 'block'").select("host", "path"), ["host", "path"], "left_semi").select("node").distinct()
    classes = blocked.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct()
    aliases = roots.join(classes, "root").select("node").union(classes.select(F.col("root").alias("node"))).distinct().withColumn("blocked", F.lit(True))
    return (rows.join(judged, ["host", "path"], "left").join(aliases, "node", "left")
            .select("own.*", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict")))
