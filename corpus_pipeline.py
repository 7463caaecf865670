"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossalake.llm import byte_bpe, decontamination, language_id, ngram_join, pii
from glossalake.llm.common import scratch, stored
from glossalake.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known; learnt from the labelled ones among them."""
    return language_id.keep_known(docs, language_id.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep, of each group of near copies, the document with the smallest id."""
    return ngram_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold half or more of a benchmark item."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and the terms that disclose it, in the texts."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (comma-joined) and whether decoding them gives the text again."""
    bpe = tokenizer(spark).learn_words(docs)
    ids = F.col("ids")
    encoded = bpe.encode(docs, keep=("text",))
    same = F.sha2(bpe.decode(ids), 256) == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return encoded.select("doc_id", byte_bpe.count_ids(ids).alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("pii", sanitise),
    ("byte_bpe", tokenise),
]
#: The stages train a classifier and join near copies: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; the tables between stages stay in the shared folder until it is cleared."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage stores for itself goes once its result is written
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
