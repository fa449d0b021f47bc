"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, packing, secrets, toxicity, urls, warc
from .common import documents, fold, shared_path, shared_table
from .decontam import decontaminate
from .divergence import divergence
from .jaccard import jaccard_components
from .language_model import lm_scores
from .quality import quality_rules
from .sharding import shuffle_key, stratified_shards

N_SHARDS = 24
END_ID = 2


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), keep=["doc_id"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", "source", (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    return (stratified_shards(rows, "source", shuffle_key(F.col("doc_id"), F.col("text_crc32")), N_SHARDS)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed_documents(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), END_ID, 49408)
    rows = rows.select(F.col("id").alias("doc_id"), "part", "chunk", "first",
                       F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return packing.with_starts(shared_table(rows, "packed-rows")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    vocab = bpe.vocabulary(_tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), vocab).select("doc_id", "ids")
    df = bpe.decode(ids, vocab)
    return df.select("doc_id", *[c.alias(k) for k, c in bpe.digests(df).items()])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select(F.col("id").alias("doc_id"), (fold("id", toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"), "score", "predicted")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    # parsed once: assembling reads the records several times
    captures = warc.assemble(shared_table(warc.read_archives(spark, path, with_payload=False), "warc-records"))
    return captures.select("page_id", "payload_bytes", F.col("response.payload_digest").alias("payload_digest"),
                           F.col("response.type").alias("record_type"), "refers_to")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return secrets.redact(found).select(
        "doc_id", "n_candidates", F.size("findings").cast("long").alias("n_findings"),
        F.transform("findings", lambda f: f["value"]).alias("secret_values"), F.sha2(F.col("text").cast("binary"), 256).alias("redacted_sha256"))


#: Fixed rules of the URL query: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return urls.url_verdicts(pages, urls.rules(spark, URL_RULES), keep=["page_id"])


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model")
    rows = alignment.aligned(documents(spark, sf_dir), a, b, keep=["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    rows = shared_table(rows.select("doc_id", *alignment.COUNTS, digest, "pairs", "times"), "aligned")
    return alignment.link_scores(rows, alignment.width(b))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_lm_scores": op6_lm_scores,
    "op7_sharding": op7_sharding,
    "op8_token_files": op8_token_files,
    "op9_secrets": op9_secrets,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_url_filters": op11_url_filters,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_alignment": op13_token_alignment,
}
