"""A training corpus from ``documents``: quality, near duplicates, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bpe import bpe_encode, word_bpe_path
from tallyloom.llm.mixing import repeat_rows
from tallyloom.llm.ngram_join import ngram_jaccard_join
from tallyloom.llm.quality import quality_rules
from tallyloom.llm.storage import shared_table
from tallyloom.llm.suffix_dedup import BYTES, WORDS, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or empty text is under 50 words, so it goes. Every row is judged alone: ids don't matter."""
    return quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the least id, null ids last; rows that share an id, or have none, are told apart."""
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null").isEmpty():
        kept = shared_table(ngram_jaccard_join(docs).where("component_id = _id").select(F.col("_id").alias("doc_id")), "pipeline-kept")
        return docs.join(kept.hint("shuffle_hash"), "doc_id").select(*COLUMNS)
    rows = shared_table(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = ngram_jaccard_join(rows, id_col="__row").select(F.col("_id").alias("__row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row"))
    kept = shared_table(groups.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(least.alias("s")).select("s.__row"), "pipeline-kept")
    return rows.join(kept.hint("shuffle_hash"), "__row").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 400 bytes that also occur elsewhere, and without passages of over 50 words that other documents have.

    What is left empty stays as an empty document; a null text becomes one; rows that share id and text lose what the bytes' rule takes.
    """
    out = suffix_dedup(docs, removed=(BYTES, WORDS), keep_text=True, keep_cols=["doc_id", "lang", "source"])
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources takes them; a null source is one of its own, rows that repeat an id share its draw."""
    return repeat_rows(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mixture, as little-endian unsigned 32-bit integers; a null or empty text has none."""
    out = bpe_encode(docs.select("doc_id", "source", "text"), word_bpe_path()).drop("text")
    return out.select("doc_id", "source", F.expr("cast(length(token_ids) div 4 as bigint)").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), "token_ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Suffix sorting and the seeded mixture have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs, f"pipeline-{name}")
    return docs
