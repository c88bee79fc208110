"""The operators over their whole tables, with production parameters, and their SQL where there is some."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext, mixing, neighbours, quality, sentencepiece, simhash, tokencount, tokenids, vectordedup, warc
from .common import scratch, table


def op1_nearest(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    path = tokencount.public("piece_bpe_32k.model")
    both = sentencepiece.round_trip(table(spark, d, "documents").select("doc_id", "text"), path)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


def op3_warc(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "warc")
    warc.write(table(spark, d, "pages"), at)
    return warc.pages(warc.read(spark, at))


def op4_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return vectordedup.near_duplicates(table(spark, d, "embeddings")).withColumnRenamed("id", "vec_id")


def op5_html_text(spark: SparkSession, d: str) -> DataFrame:
    return htmltext.extract(table(spark, d, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    space = quality.fit(docs, table(spark, d, "labels"), ~held_out())
    scored = quality.score(docs, space, keep=False)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_ids(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "tokens")
    tokenids.write(table(spark, d, "documents"), at, tokencount.public("byte_bpe_50k.json"))
    return tokenids.read(spark.read.parquet(at)).withColumnRenamed("id", "doc_id")


def op10_token_counts(spark: SparkSession, d: str) -> DataFrame:
    found = tokencount.token_counts(table(spark, d, "documents"), tokencount.public("word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES = {f.__name__: f for f in (op1_nearest, op2_sentencepiece, op3_warc, op4_embedding_dedup, op5_html_text, op6_quality, op7_simhash, op8_mixing, op9_token_ids, op10_token_counts)}

ORACLE_SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS least FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to FROM r
""",
    "op8_mixing": mixing.ORACLE,
}
