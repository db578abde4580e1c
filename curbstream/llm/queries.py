"""The registered queries of this folder. Each applies its operator to a whole table and derives the digest columns."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstream.llm import block_max, exact_dedup, fingerprints, html_text, jaccard_join, language_id, license_scan, mixing, packing, resampling, shards, substring_dedup, warc
from curbstream.sources.tables import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(table(spark, sf_dir, "documents"))


def op4_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_documents(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(4)) == 2, F.lit(False))
    net = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("found")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write(table(spark, sf_dir, "pages"))
    return warc.parse(warc.read(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.search(block_max.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_substring_dedup, op2_shards, op3_jaccard_join, op4_fingerprints, op4_near_documents, op5_mixing, op6_packing, op7_language_id, op8_license_scan, op9_html_text, op10_exact_dedup, op11_resampling, op12_warc, op13_lexical_search)}
ORACLE: dict[str, str] = {"op5_mixing": mixing.ORACLE, "op10_exact_dedup": OP10_SQL, "op11_resampling": resampling.ORACLE, "op12_warc": warc.ORACLE, "op13_lexical_search": block_max.ORACLE}
