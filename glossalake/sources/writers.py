"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossalake.functions.text import strip


def json_lines(df: DataFrame, path: str) -> None:
    """JSON, one row a line; other scripts stay readable."""
    df.write.mode("error").json(path)


def new_version(df: DataFrame, path: str, version: int) -> str:
    """The next state of a table beside the ones before; readers switch when it is whole (_SUCCESS)."""
    to = f"{path}/v{version:08d}"
    df.write.mode("error").parquet(to)
    return to


def latest_version(spark: SparkSession, path: str) -> str:
    """The folder of the highest version that is whole."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(at)]
    return max(str(p) for p in found if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def aligned(df: DataFrame, order: str, first: str, second: str) -> DataFrame:
    """Both columns as single lines, in order: what the two aligned files hold."""
    return df.orderBy(order).select(single_line(F.col(first)).alias(first), single_line(F.col(second)).alias(second))


def single_line(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\r?\n", " "))


def parallel_text(df: DataFrame, order: str, first: str, second: str, path: str) -> None:
    """Two folders of text whose lines match one by one, part by part and in order: one job writes both, a task a part of either."""
    side = F.explode(F.map_from_arrays(F.array(F.lit(first), F.lit(second)), F.array(*(single_line(F.col(c)) for c in (first, second))))).alias("side", "value")
    rows = df.select(F.col(order).alias("__at"), side)
    rows.repartitionByRange("__at").sortWithinPartitions("side", "__at").drop("__at").write.mode("error").partitionBy("side").text(path)
    jvm = df.sparkSession.sparkContext._jvm
    to_path = jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for c in (first, second):
        fs.rename(to_path(f"{path}/side={c}"), to_path(f"{path}/{c}"))


def split_by_level(parsed: DataFrame, path: str) -> None:
    """All entries, and those of errors once more."""
    parsed.write.mode("error").json(f"{path}/all")
    parsed.where(F.col("level").isin("ERROR", "CRITICAL", "FATAL")).write.mode("error").json(f"{path}/errors")
