"""Registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.llm import alignment, bpe, conversations, mixing, neardup, pii, quality, secrets, sharding, tiff, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file: a folder in SCOUTLINE_TOKENIZERS, else the installed package's."""
    folder = os.environ.get("SCOUTLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return pii.with_found(docs).select("doc_id", *(count(k) for k in pii.KINDS), sha256(pii.joined(F.col("_spans"))).alias("base_sha256"), pii.joined(F.concat("_spans", "_words")).alias("spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, similarity=0.8).drop("text_hash")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic").where(toxicity.fold(F.col("id")) != 0)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), (toxicity.fold(F.col("id")) == 0).alias("held_out"), "score", "predicted")


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: pages, then of each its size, layout, and mean and entropy of the samples that were read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    layout = lambda p: F.concat_ws("x", p["width"], p["height"], p["compression"], p["predictor"], F.when(p["tiled"], "tiles").otherwise("strips"))
    read = tiff.tiff_read(tiff.tiff_store(docs)).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "media",
        F.unhex(F.array_join(F.transform("pages", lambda p: F.hex(p["samples"])), "")).alias("payload"),
        F.transform("pages", lambda p: F.concat(layout(p), F.format_string(":%.6f:%.6f", p["mean"], p["entropy"]))).alias("pages"),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.size("pages").cast("string"), F.lit(":"), F.array_join("pages", ",")).alias("feature"),
    )


#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("path"))
    return secrets.scan(docs).withColumnRenamed("id", "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), entropy_share=0.98, max_passes=4.0)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.bpe_encode(docs, path).select("doc_id", "ids")
    return bpe.bpe_decode(ids, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.warc_write(table(spark, sf_dir, "pages"))
    return warc.warc_read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return alignment.digests(docs, a, b, alignment.sizes(b))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_near_duplicates, op4_toxicity, op5_tiff, op6_sharding, op7_secrets, op8_mixing, op9_bpe, op10_warc, op11_alignment, op12_conversations, op13_top_k)}
SQL: dict[str, str] = {"op2_quality": quality.SQL, "op6_sharding": sharding.SQL.replace("{limit}", str(SHARD_BYTES)), "op13_top_k": topk.SQL}
