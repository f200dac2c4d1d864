"""Training-text pipeline over ``documents``: quality rules, near-duplicates, personal data, mixing, BPE.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs.  All but the last return
the columns of ``documents``; extra columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.llm import bpe, mixing, neardup, pii, quality
from scoutline.llm.common import shared_dir
from scoutline.llm.queries import table, vocabulary


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits go from the texts of the others."""
    return _with_length(quality.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id (five-word shingles, similarity 0.8)."""
    return neardup.deduplicate(docs, width=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become their kind in brackets; no document goes."""
    return _with_length(pii.sanitise(docs))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them: the largest source once, smaller ones up to twice, none never."""
    uses = mixing.mixed(docs, entropy_share=0.98, max_passes=2.0, cover=True)
    names = [f"_c{i}" for i in range(len(docs.columns))]  # clashing names of extra columns do no harm
    inner = docs.toDF(*names)
    key, source = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "source"))
    times = uses.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("times"))
    rows = inner.groupBy(key.alias("id2"), source.alias("of2")).agg(F.count(F.lit(1)).alias("rows"))
    same = F.col("id").eqNullSafe(F.col("id2")) & F.col("of").eqNullSafe(F.col("of2"))
    per_row = times.join(rows, same).select("id", "of", F.ceil(F.col("times") / F.col("rows")).cast("int").alias("each"))
    both = inner.join(per_row, key.eqNullSafe(F.col("id")) & source.eqNullSafe(F.col("of")))
    return both.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("each")))).select(*names).toDF(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a check that they decode to its words again."""
    path = vocabulary("word_bpe_49k.json")
    ids = bpe.bpe_encode(docs.select("doc_id", "source", "text"), path).select("doc_id", "source", "ids")
    return bpe.bpe_decode(ids, path).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), F.col("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixing_sources),
    ("bpe", bpe_tokens),
]

#: Shingle hashes and the tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
