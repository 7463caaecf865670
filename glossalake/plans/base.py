"""Registering queries, and the stand-ins for the application's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def registry():
    """(queries, oracles, decorator): the decorator takes the SQL, or nothing where SQL can't express the query."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str = ""):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as glossary entries."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("english"), F.col("p_type").alias("chinese"), F.col("p_brand").alias("dutch"),
        F.when(F.col("p_size") > 25, "large").alias("category"), (F.col("p_partkey") % 150).alias("user_id"), (F.col("p_size") % 2 == 0).alias("is_public"),
    )


TRANSLATIONS = "(SELECT p_partkey AS id, p_name AS english, p_type AS chinese, p_brand AS dutch, CASE WHEN p_size > 25 THEN 'large' END AS category, p_partkey % 150 AS user_id, p_size % 2 = 0 AS is_public FROM part)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as users."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("username"), F.col("c_nationkey").alias("role_id"), (F.col("c_custkey") % 100).alias("approver"), F.col("c_mktsegment").alias("segment"))


USERS = "(SELECT c_custkey AS uid, c_name AS username, c_nationkey AS role_id, c_custkey % 100 AS approver, c_mktsegment AS segment FROM customer)"
