"""The registered queries of the text operators and the SQL they must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.llm import (
    clustering, importance, jaccard, langid, licenses, line_dedup, mixing, packing, quality, secrets, topk, vectors, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.filter(~held))
    found = langid.identify(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score",
                        F.size("spans").cast("long").alias("n_spans"))


def word_tokenizer() -> str:
    """The public vocabulary file; driver and workers find it under the same path."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_units(table(spark, sf_dir, "documents"), line_dedup.PASSAGE)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), shingle_words=3, percent=90)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve(warc.records_of(table(spark, sf_dir, "pages"))))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_langid": op1_langid,
    "op2_packing": op2_packing,
    "op3_vectors": op3_vectors,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_jaccard": op7_jaccard,
    "op8_licenses": op8_licenses,
    "op9_warc": op9_warc,
    "op10_secrets": op10_secrets,
    "op11_topk": op11_topk,
    "op12_importance": op12_importance,
    "op13_clustering": op13_clustering,
}
ORACLES: dict[str, str] = {
    "op4_mixing": mixing.ORACLE,
    "op8_licenses": licenses.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_secrets": secrets.ORACLE,
    "op11_topk": topk.ORACLE,
    "op12_importance": importance.ORACLE,
    "op13_clustering": clustering.ORACLE,
}
