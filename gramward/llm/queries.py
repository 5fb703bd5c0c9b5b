"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramward.llm import bpe, chat, html, langid, packing, simhash, substring, vectors, warc
from gramward.llm.common import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.drop_repeats(docs, counts=True)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(table(spark, sf_dir, "conversations"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (
    op1_embedding_dedup, op2_html_text, op3_byte_bpe, op4_substring_dedup, op5_packing, op6_language_id,
    op7_warc, op8_simhash, op9_chat_preferences, op10_vector_search,
)}
ORACLES: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
        f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
        SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM d LEFT JOIN f ON f.digest = d.digest AND d.n >= 100""",
    "op9_chat_preferences": chat.PREFERENCES_SQL,
}
