"""The fixed-contract queries: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossalake.llm import alignment, byte_bpe, centroids, decontamination, embedding_dedup, language_id, ngram_join, pii, repetition, secrets, sharding, substring_dedup, toxicity
from glossalake.llm.common import remainder
from glossalake.llm.oracles import ORACLES as ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """All rows of a table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: the size of its set and the class that links lead to. Edges as in ``ngram_join.join``."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a vector: its links, its class, and whether it stays. Edges as in ``embedding_dedup.link``."""
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated ones too; a null id is never held out. Edges as in ``language_id.identify``."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.train(docs.where(~held))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated ones too; a null id is never held out and has no label. Edges as in ``toxicity.score``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where("toxic in (0, 1)").select("doc_id", "toxic").where(~held).distinct()
    model = toxicity.train(docs.join(labels, "doc_id"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document with the counts and places of what is found. Edges as in ``pii.find``."""
    found = pii.find(table(spark, sf_dir, "documents"))
    count = [F.size(secrets.of_kinds(F.col("spans"), (k,))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    spans = F.col("spans")
    return found.select("doc_id", *count, F.sha2(secrets.digest(spans, pii.KINDS).cast("binary"), 256).alias("base_sha256"), secrets.digest(spans).alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item of which it holds half or more. Edges as in ``decontamination.contaminations``."""
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer(spark: SparkSession) -> byte_bpe.Tokenizer:
    """By the vocabulary file that the contract names."""
    import public_tokenizers

    return byte_bpe.Tokenizer(spark, byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document with digests of its ids and of what they decode to. Edges as in ``Tokenizer.encode``."""
    docs = table(spark, sf_dir, "documents")
    bpe = tokenizer(spark).learn_words(docs)
    ids = F.col("ids")
    return bpe.encode(docs).select("doc_id", byte_bpe.count_ids(ids).alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(bpe.decode(ids), 256).alias("decoded_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document with a digest of the words that stay. Edges as in ``substring_dedup.repeated``."""
    left = substring_dedup.remove(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document with its place in 24 shards of nearly equal bytes. Edges as in ``sharding.assign``."""
    docs = table(spark, sf_dir, "documents")
    placed = sharding.assign(docs, sharding.plan(docs, 24))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document with the counts and places of secrets. Edges as in ``secrets.scan``."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = [F.size(secrets.of_kinds(F.col("spans"), (k,))).cast("bigint").alias(f"n_{k}") for k in secrets.BASE]
    spans = F.col("spans")
    return found.select("doc_id", *count, F.sha2(secrets.digest(spans, secrets.BASE).cast("binary"), 256).alias("base_sha256"), secrets.digest(spans).alias("spans"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document with what the rules count and whether it stays. Edges as in ``repetition.rate``."""
    rated = repetition.rate(table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rated.select(*base, *(c for c in repetition.COUNTS if c not in base))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document with its groups and links between the tokens of two vocabularies. Edges as in ``alignment.align``."""
    import public_tokenizers as public

    pair = alignment.Pair(public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model"))
    found = alignment.align(table(spark, sf_dir, "documents"), pair, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a vector with its cluster, its distance and the sums of these. Edges as in ``centroids.cluster``."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_decontamination": op3_decontamination,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sharding": op6_sharding,
    "op7_secret_scan": op7_secret_scan,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_language_id": op10_language_id,
    "op11_quality_rules": op11_quality_rules,
    "op12_token_alignment": op12_token_alignment,
    "op13_centroid_clusters": op13_centroid_clusters,
}
