"""A pipeline over ``documents``: reject low quality, drop near duplicates, mix sources, encode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import mixing, quality, sentencepiece, simhash, tokencount
from loomstat.llm.common import quoted, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of the input's documents."""
    space = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, space, to="__score").where("__score >= 0.5").drop("__score")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): that with the
    smallest id, of several with that id the one whose text hashes least, of rows equal in both any one. Rows without an id stay."""
    found = simhash.near_duplicates(docs, words=5, similarity=0.8).where("id is not null")
    kept = found.groupBy("group").agg(F.min(F.struct("id", "hash")).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.hash").alias("__hash"))
    names = docs.columns
    own = docs.where("doc_id is not null").withColumn("__text", F.xxhash64(F.col("text").cast("binary")))
    one = own.join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi").dropDuplicates(["doc_id", "__text"])
    return docs.where("doc_id is null").unionAll(one.select(*[quoted(n) for n in names]))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # whatever a table calls its columns
    safe = docs.toDF(*names.values())
    mixed = mixing.mix(safe, id_col=names["doc_id"], text_col=names["text"], source_col=names["source"], keep=tuple(names.values()))
    copies = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col(n).alias(c) for c, n in names.items()])


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids."""
    return sentencepiece.encode(docs, tokencount.public("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encode_stage),
]

#: The classifier, XXH64 and the encoder are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
