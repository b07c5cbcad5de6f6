"""Registered queries of the training-data operators: whole tables, production parameters."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, byte_bpe, decontaminate, divergence, language, mixing, ngram_join, oracles, passages, quality, repeats, secrets, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", decontaminate.is_contaminated().alias("contaminated"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "quality", "toxic", "quality_own", "toxic_own", "quality_host", "quality_path", "toxic_host", "toxic_path", "keep")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(read(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.learn_cuts(docs))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language.identify(docs, language.learn(docs))
    return out.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = warc.archive(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.similar_documents(read(spark, sf_dir, "documents"), links=False)
    return out.select("doc_id", "n_shingles", "component_id")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.repeated_bytes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.read_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = byte_bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(byte_bpe.decode(F.col("ids"), vocabulary), 256).alias("decoded_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix": op2_mix,
    "op3_nearest": op3_nearest,
    "op4_quality": op4_quality,
    "op5_passages": op5_passages,
    "op6_secrets": op6_secrets,
    "op7_language": op7_language,
    "op8_warc": op8_warc,
    "op9_ngram_join": op9_ngram_join,
    "op10_repeats": op10_repeats,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_divergence": op12_divergence,
    "op13_alignment": op13_alignment,
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": oracles.OP1,
    "op8_warc": oracles.OP8,
    "op9_ngram_join": oracles.OP9,
    "op10_repeats": oracles.OP10,
    "op12_divergence": oracles.OP12,
}
