"""The registered queries of these operators over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalgrid.llm.audio_fingerprint import align, synthetic_media
from tidalgrid.llm.decontaminate import decontaminate
from tidalgrid.llm.line_dedup import line_dedup
from tidalgrid.llm.ngram_join import ngram_jaccard_join
from tidalgrid.llm.packing import pack
from tidalgrid.llm.secret_scan import digest, secret_scan
from tidalgrid.llm.substring_dedup import substring_dedup
from tidalgrid.llm.token_counts import prefix_table
from tidalgrid.llm.toxicity import toxicity
from tidalgrid.llm.warc_audit import fixity_audit

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_scan(table(spark, sf_dir, "documents")))


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica in which every thousandth page has one wrong byte."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = F.overlay("html", F.lit("#"), F.lit(10), F.lit(1))
    replica = pages.withColumn("html", F.when(F.col("page_id") % 1000 == 7, damaged).otherwise(F.col("html")))
    return fixity_audit(pages, replica)


def op9_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(synthetic_media(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    found = [
        op1_token_counts, op2_substring_dedup, op3_line_dedup, op4_ngram_jaccard_join, op5_decontaminate, op6_packing,
        op7_secret_scan, op8_warc_audit, op9_audio_fingerprints, op10_toxicity,
    ]
    return {f.__name__: f for f in found}


OP8_SQL = r"""
WITH r AS (
  SELECT page_id, page_id // 512 AS file_id,
         concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', url,
                chr(13), chr(10), 'WARC-Record-ID: <urn:page:', CAST(page_id AS VARCHAR), '>', chr(13), chr(10),
                'Content-Length: ', CAST(strlen(html) AS VARCHAR), chr(13), chr(10), chr(13), chr(10), html,
                chr(13), chr(10), chr(13), chr(10)) AS rec
  FROM pages)
SELECT page_id, CAST(file_id AS BIGINT) AS file_id,
       CAST(coalesce(sum(strlen(rec)) OVER (PARTITION BY file_id ORDER BY page_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
       CAST(strlen(rec) AS BIGINT) AS record_length, sha256(rec) AS record_sha256,
       CASE WHEN page_id % 1000 = 7 THEN 'corrupt' ELSE 'ok' END AS status
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_warc_audit": OP8_SQL}
