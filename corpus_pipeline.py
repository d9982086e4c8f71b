"""From crawled documents to packed training sequences, in five stages.

Each stage works on what the one before has kept, written as Parquet and read again, so a lost
executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.llm.common import ids_are_keys, with_uid
from plantpulse.llm.jaccard import jaccard_join
from plantpulse.llm.mixing import mixed_documents
from plantpulse.llm.packing import pack_documents
from plantpulse.llm.quality import keep_good
from plantpulse.llm.queries import word_tokenizer
from plantpulse.llm.secrets import redact
from plantpulse.session import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the others go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): that of the smallest doc_id, then text digest.

    Rows that repeat doc_id and text are one document; rows that share a doc_id, or have none, but differ in text are
    different ones. Documents without words are no copies of each other and stay.
    """
    if ids_are_keys(docs):
        found = jaccard_join(docs)
        # the documents that go are far fewer than those that stay
        gone = staged(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id")), "gone")
        return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")
    known = staged(with_uid(docs).dropDuplicates(["__uid"]), "numbered")
    found = jaccard_join(known.select(F.col("__uid").alias("doc_id"), "text"))
    gone = staged(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id")), "gone")
    return known.join(gone, F.col("__uid") == F.col("__id"), "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a placeholder, n_chars counted anew."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weight of its source asks."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 2048 tokens."""
    return pack_documents(docs, word_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packing),
]
# tokens, min-hash blocks and repetition windows have no SQL; tests compare run() with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
