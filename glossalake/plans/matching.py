"""Similarity and matching queries; difflib has no SQL, so tests compare them with the plain functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossalake.functions.translate import DictionaryTranslator, translate
from glossalake.operators import similarity as E
from glossalake.plans.base import read, registry

QUERIES, ORACLES, query = registry()


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id")


@query()
def similarity_measures(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    return p.select("item_id", *(E.similarity(m)("text", "other").alias(m) for m in ("ratio", "normalized", "penalised", "weighted", "characters_and_words")), E.skip_insertion()("text", "other").alias("skip"))


@query()
def most_similar_item(spark: SparkSession, d: str) -> DataFrame:
    """For every item, whole, the most similar of all other items."""
    return E.best_of_all(read(spark, d, "benchmark").select("item_id", "text"), "item_id", "text", 0.3)


@query()
def closest_item(spark: SparkSession, d: str) -> DataFrame:
    """For every item, whole, the closest of all other items, however far it is."""
    return E.best_of_all(read(spark, d, "benchmark").select("item_id", "text"), "item_id", "text", None)


def _slides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("slide"), F.col("turn").cast("int").alias("place"), "text")
    changed = F.when(F.col("place") % 3 == 0, F.col("text")).when(F.col("place") % 3 == 1, F.upper("text")).otherwise(F.substr("text", F.lit(5)))
    return c, c.select("slide", "place", changed.alias("source"), F.concat(F.lit("T"), F.col("place").cast("string")).alias("target"))


@query()
def matched_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    left, right = _slides(spark, d)
    return E.match_paragraphs(left, right, "slide")


@query()
def matched_boxes(spark: SparkSession, d: str) -> DataFrame:
    left, right = _slides(spark, d)
    return E.match_boxes(left, right.select("slide", "place", F.col("source").alias("text")), "slide")


@query()
def matched_shapes(spark: SparkSession, d: str) -> DataFrame:
    left, right = _slides(spark, d)
    return E.match_shape(left, right.select("slide", "place", F.col("source").alias("text")), "slide")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN '点击' WHEN 'view' THEN '查看' ELSE event_type END AS translation FROM events")
def translated_events(spark: SparkSession, d: str) -> DataFrame:
    words = DictionaryTranslator({"click": "点击", "view": "查看"})
    return translate(read(spark, d, "events").select("event_id", F.col("event_type").alias("text")), words, "English", "Chinese").select("event_id", "translation")
