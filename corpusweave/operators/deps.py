"""Third-party dependency audit over many repositories at once.

All tables carry ``repo``; the stdlib and alias tables are fixed-size and
broadcast; everything else is anti/semi joins and distinct.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.text import py_strip

# Folders never counted as local packages, path parts that
# exclude a file from the scan, and import name -> distribution name.
EXCLUDED_DIRS = ("tests", "venv", ".venv", "__pycache__", ".git", "data")
SCAN_EXCLUDED_PARTS = ("tests", "venv", ".venv")
IMPORT_TO_PACKAGE = {
    "flask": "flask", "jwt": "pyjwt", "yaml": "pyyaml", "PIL": "pillow", "cv2": "opencv-python",
    "sklearn": "scikit-learn", "dotenv": "python-dotenv", "bcrypt": "bcrypt", "requests": "requests",
    "pytest": "pytest",
}


def stdlib_names() -> list[str]:
    """Standard-library top-level module names of the running Python."""
    return sorted(sys.stdlib_module_names)


def local_modules(sources: DataFrame) -> DataFrame:
    """sources(repo, path repo-relative) -> (repo, module): stems of root
    ``*.py`` files and root folders holding any ``*.py``, minus excluded and
    dot names."""
    parts = F.split(F.col("path"), "/")
    first = parts[0]
    root_file = F.size(parts) == 1
    name = F.when(root_file, F.regexp_replace(first, r"\.py$", "")).otherwise(first)
    py = sources.where(F.col("path").endswith(".py"))
    return (py.select("repo", name.alias("module"), first.alias("_first"))
              .where(~F.col("_first").isin(*EXCLUDED_DIRS) & ~F.col("_first").startswith("."))
              .select("repo", "module").distinct())


def third_party(spark, sources: DataFrame, import_modules: DataFrame) -> DataFrame:
    """import_modules(repo, path, module) of absolute imports (parse
    failures already yield none) -> (repo, package) distinct."""
    parts = F.split(F.col("path"), "/")
    excluded = F.exists(parts, lambda p: p.isin(*SCAN_EXCLUDED_PARTS))  # parts below the root only (Q17)
    imp = import_modules.where(~excluded).select("repo", "module").distinct()  # few rows reach the joins, even of a hot repo
    std = F.broadcast(spark.createDataFrame([(n,) for n in stdlib_names()], "module string"))
    alias = F.broadcast(spark.createDataFrame(list(IMPORT_TO_PACKAGE.items()), "module string, package string"))
    loc = local_modules(sources)
    kept = imp.join(std, "module", "left_anti").join(loc, ["repo", "module"], "left_anti")
    return (kept.join(alias, "module", "left")
                .select("repo", F.coalesce("package", "module").alias("package")).distinct())


def requirement_name(line: F.Column) -> F.Column:
    """D3 name rule: text before '==', then '>=', then '<=' of the stripped
    line, lower-cased."""
    s = py_strip(line)
    for sep in ("==", ">=", "<="):
        s = F.substring_index(s, sep, 1)
    return F.lower(s)


def parse_requirements(lines: DataFrame) -> DataFrame:
    """D3: lines(repo, pos, line) -> + name (null for blank and '#' lines)."""
    listed = (py_strip(F.col("line")) != "") & ~F.col("line").startswith("#")
    return lines.withColumn("name", F.when(listed, requirement_name(F.col("line"))))


#: State of a repository's requirement file: none, one without listed names, one with names.
ABSENT, EMPTY, PRESENT = "absent", "empty", "present"


def requirement_files(repos: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """(repo, file_state) for every repository. ``files`` has a row (repo) for each requirement file that exists, whatever it
    holds; ``lines`` are the lines of those files. Combined map-side, so a repository of any size is one row a task."""
    listed = parse_requirements(lines).where(F.col("name").isNotNull())
    facts = (repos.select("repo", F.lit(False).alias("_file"), F.lit(False).alias("_name"))
             .union(files.select("repo", F.lit(True), F.lit(False))).union(listed.select("repo", F.lit(True), F.lit(True))))
    r = facts.groupBy("repo").agg(F.bool_or("_file").alias("_file"), F.bool_or("_name").alias("_name"))
    return r.select("repo", F.when(F.col("_name"), PRESENT).when(F.col("_file"), EMPTY).otherwise(ABSENT).alias("file_state"))


def _missing(scanned: DataFrame, names: DataFrame) -> DataFrame:
    return scanned.select("repo", "package").distinct().join(
        names.select("repo", F.col("name").alias("_name")), (F.col("_name") == F.lower("package")) & scanned["repo"].eqNullSafe(names["repo"]), "left_anti")


def missing_packages(scanned: DataFrame, lines: DataFrame, repos: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """D4, in long form: (repo, reason_code, rank, package), one row a package and one with a null package for a repository
    that has none to name. REQUIREMENTS_CREATED: no file, all scanned packages; REQUIREMENTS_UP_TO_DATE: nothing is
    missing, the names listed; REQUIREMENTS_UPDATED: the missing packages (a file without names lists none). ``rank``
    numbers a repository's packages in order. ``files`` defaults to the repositories that have lines. No list of a
    repository is collected; statuses come from ``bool_or`` over facts."""
    names = parse_requirements(lines).where(F.col("name").isNotNull()).select("repo", "name").distinct()
    state = requirement_files(repos, files if files is not None else lines.select("repo").distinct(), lines)
    miss = _missing(scanned, names)
    some = state.select("repo", "file_state", F.lit(False).alias("_miss")).unionByName(
        miss.select("repo", F.lit(None).cast("string").alias("file_state"), F.lit(True).alias("_miss")))
    status = some.groupBy("repo").agg(F.max("file_state").alias("_state"), F.bool_or("_miss").alias("_miss")).where("_state IS NOT NULL")
    code = (F.when(F.col("_state") == ABSENT, "REQUIREMENTS_CREATED").when(F.col("_miss"), "REQUIREMENTS_UPDATED")
            .otherwise("REQUIREMENTS_UP_TO_DATE"))
    status = status.select("repo", code.alias("reason_code"))
    # which list a status names
    named = miss.select("repo", F.lit(True).alias("_of_miss"), "package").unionByName(
        names.select("repo", F.lit(False).alias("_of_miss"), F.col("name").alias("package")))
    j = status.join(named, (status["repo"].eqNullSafe(named["repo"])) & (F.col("_of_miss") == (F.col("reason_code") != "REQUIREMENTS_UP_TO_DATE")),
                    "left").select(status["repo"], "reason_code", "package")
    return _ranked(j)


def _ranked(rows: DataFrame) -> DataFrame:
    """Numbers packages within a repository: ranks inside ranges of first characters, each from what the ranges before hold."""
    ranged = rows.withColumn("_range", F.coalesce(F.substring("package", 1, 2), F.lit("")))
    counts = ranged.groupBy("repo", "_range").agg(F.count("package").alias("_n"))
    before = Window.partitionBy("repo").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("repo").alias("_repo"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("repo", "_range").orderBy("package"))
    j = ranged.withColumn("_own", own).join(counts, F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("_range") == F.col("_of")))
    return j.select("repo", "reason_code", F.when(F.col("package").isNotNull(), F.col("_own") + F.col("_before")).cast("long").alias("rank"), "package")


def clean_requirements(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """Non-blank lines with ``kept``; a line is removed when its lower
    name (D3 rule, Q18) is a local module; comment lines pass through."""
    req = parse_requirements(lines).where(py_strip(F.col("line")) != "")
    loc = local_modules(sources).select("repo", F.lower("module").alias("name"), F.lit(True).alias("_local")).distinct()
    j = req.join(loc, ["repo", "name"], "left")
    return j.select("repo", "pos", "line", F.col("_local").isNull().alias("kept"))


def clean_status(cleaned: DataFrame, scanned: DataFrame, lines: DataFrame, repos: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """D5 per repository: (repo, reason_code, rank, entry). A repository with a file is REQUIREMENTS_CLEANED, with a row for each
    distinct line removed, or REQUIREMENTS_ALREADY_CLEAN, with a null entry; without a file it gets what D4 gives."""
    files = files if files is not None else lines.select("repo").distinct()
    state = requirement_files(repos, files, lines)
    facts = state.select("repo", "file_state", F.lit(False).alias("_gone")).unionByName(
        cleaned.where("NOT kept").select("repo", F.lit(None).cast("string").alias("file_state"), F.lit(True).alias("_gone")))
    status = facts.groupBy("repo").agg(F.max("file_state").alias("_state"), F.bool_or("_gone").alias("_gone")).where("_state IS NOT NULL")
    status = status.where(F.col("_state") != ABSENT).select(
        "repo", F.when(F.col("_gone"), "REQUIREMENTS_CLEANED").otherwise("REQUIREMENTS_ALREADY_CLEAN").alias("reason_code"))
    gone = cleaned.where("NOT kept").select("repo", F.col("line").alias("package")).distinct()
    own = _ranked(status.join(gone, "repo", "left"))
    created = missing_packages(scanned, lines, repos, files).where(F.col("reason_code") == "REQUIREMENTS_CREATED")
    return own.unionByName(created).withColumnRenamed("package", "entry")
