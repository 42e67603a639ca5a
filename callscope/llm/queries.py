"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import chat, decontaminate, hard_negatives, knn, license_scan, oracles, packing, pii, quality, repair, simhash, token_counts, url_filter, warc
from callscope.llm.common import shared_path, stage, with_package
from callscope.session import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema)
    return chat.read_back(*chat.prefix_tree(conversations.unionByName(added)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The rules that the query judges by.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair.report(repair.damaged(conversations)).withColumnRenamed("conv_id", "found")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = shared_path(spark, "archives")
    warc.write_archives(pages, path)
    records = warc.with_originals(stage(warc.read_archives(spark, path, with_payload=False), "headers"))
    kind = pages.schema["page_id"].dataType.simpleString()
    source = lambda c: warc.unquoted(F.col(c)).cast(kind)
    return records.select(source("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", source("refers_to").alias("refers_to"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    embeddings = table(spark, sf_dir, "embeddings").withColumn("label", relabelled)
    return hard_negatives.mine(embeddings, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: with_package(f) for f in (
    op1_packing,
    op2_decontamination,
    op3_token_counts,
    op4_chat_formatting,
    op5_simhash,
    op6_topk,
    op7_license_scan,
    op8_quality,
    op9_url_filter,
    op10_pii,
    op11_conversation_repair,
    op12_warc,
    op13_hard_negatives,
)}
ORACLE = {
    "op6_topk": oracles.topk(),
    "op7_license_scan": oracles.license_scan(),
    "op9_url_filter": oracles.url_filter(URL_RULES),
    "op12_warc": oracles.warc(),
    "op13_hard_negatives": oracles.hard_negatives(),
}
