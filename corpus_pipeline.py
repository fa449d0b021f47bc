"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

1. quality rules: documents that the rules reject go;
2. n-gram Jaccard join: one document of each group of near copies stays (the one with the smallest id);
3. benchmark decontamination: contaminated documents go;
4. secret scans: findings are replaced in the text;
5. byte-level BPE: the texts become token ids.

``ORACLE_SQL`` is None: SQL cannot state the forest of stage 4 nor the merges of stage 5. ``tests/llm`` holds
every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm import bpe, secrets
from corpusweave.llm.common import shared_table
from corpusweave.llm.decontam import decontaminate
from corpusweave.llm.jaccard import jaccard_components
from corpusweave.llm.quality import quality_rules
from corpusweave.session import ship_package

#: Near copies: shingles of five words, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def _whole(docs: DataFrame) -> DataFrame:
    """The rows as one column beside the text, so no column of theirs meets one of an operator's."""
    return docs.select(F.struct(*docs.columns).alias("document"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(_whole(docs), keep=["document"]).where("kept").select("document.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words belong to no group and stay."""
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        key, keyed = "doc_id", docs
    else:  # null or repeated ids: rows get numbers of their own
        key = "_row"
        keyed = shared_table(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    groups = jaccard_components(keyed, key, "text", SHINGLE_WORDS, SIMILARITY_PERCENT)
    stay = groups.where(F.col(key) == F.col("component_id")).select(key)
    return keyed.join(stay, key, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontaminate(_whole(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where("NOT contaminated").select("document.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(secrets.scan(_whole(docs))).select("document", "text", F.size("findings").alias("found"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("found") > 0, F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(
        F.col("document")["n_chars"])} if "n_chars" in docs.columns else {"text": F.col("text")}
    return out.select(*[new[c].alias(c) if c in new else F.col("document")[c].alias(c) for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    df = bpe.round_trip(docs.select("doc_id", "text"), vocab)
    return df.select("doc_id", "ids", *[c.alias(k) for k, c in bpe.digests(df).items()])


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination),
          ("secret scans", secret_scan), ("byte-level BPE", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
