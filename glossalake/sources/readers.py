"""Readers: catalogues, logs, folders, trees and office files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossalake.operators.slides import pages_of
from glossalake.schemas import ANNOTATIONS, CATALOGUE, CONTENT_LIST, OCR_MAPPING, SCHEMAS


def table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A table in Parquet, with its known schema if it has one."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """A table of a database; with a numeric key, read in parts side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    """The row of a key; the filter reaches the scan."""
    return df.where(F.col(key) == value).limit(1)


def one_by(df: DataFrame, **values) -> DataFrame:
    """The row that has given values, at most one; null means no value. The filter reaches the scan."""
    same = F.lit(True)
    for c, v in values.items():
        same = same & (F.col(c).isNull() if v is None else F.col(c) == v)
    return df.where(same).limit(1)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """file, product, ingredient, path, detail_url from JSON objects keyed by product; one file a row group."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    rows = raw.select("file", F.explode(F.map_entries(F.from_json("value", CATALOGUE))).alias("e"))
    return rows.select("file", F.col("e.key").alias("product"), "e.value.*")


def log_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of a log and its rotated siblings (give both, or a pattern), with the file's name."""
    return spark.read.text(list(paths)).select("value", F.col("_metadata.file_name").alias("file"))


def listing(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """path, length and modification time of files, newest first; contents aren't read. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    if extension:
        files = files.where(F.lower("path").endswith(extension.lower()))
    return files.orderBy(F.desc("modificationTime"), "path")


def storage_used(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and files (empty ones don't count) below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("used"), F.count("*").alias("files"))


def older_than(files: DataFrame, as_of, hours: int) -> DataFrame:
    return files.where(F.col("modificationTime") < as_of - F.make_dt_interval(hours=F.lit(hours)))


def slide_trees(spark: SparkSession, path: str) -> DataFrame:
    """deck (file name) and pages of JSON trees."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("deck"), pages_of(F.col("value")).alias("pages"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row an annotation, with file, user and timestamp."""
    raw = spark.read.text(path, wholetext=True)
    one = raw.select(F.col("_metadata.file_name").alias("file"), F.from_json("value", ANNOTATIONS).alias("a"))
    return one.select("file", F.col("a.user").alias("user"), F.col("a.timestamp").alias("timestamp"), F.posexplode("a.annotations").alias("pos", "x")).select("file", "user", "timestamp", "pos", "x.*")


def ocr_mapping(spark: SparkSession, path: str) -> DataFrame:
    """One row an image, with its slide and place."""
    raw = spark.read.text(path, wholetext=True)
    one = raw.select(F.explode(F.map_entries(F.from_json("value", OCR_MAPPING))).alias("e"))
    return one.select(F.col("e.key").alias("slide"), F.col("e.value.slide_number").alias("slide_number"), F.posexplode("e.value.images").alias("pos", "i")).select("slide", "slide_number", "pos", "i.*")


def ocr_results(spark: SparkSession, path: str, files: str = "*_content_list.json") -> DataFrame:
    """name (the folder) and content list of every content list below path."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(path, wholetext=True)
    return raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("name"), F.from_json("value", CONTENT_LIST).alias("items"))


def parallel_lines(spark: SparkSession, path: str) -> DataFrame:
    """part, line (0-based) and value of one side of aligned files: line numbers count within a part, which is read by one task."""
    raw = spark.read.text(path, wholetext=True)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    lines = F.split(F.regexp_replace("value", r"\n$", ""), "\n")
    return raw.where(F.length("value") > 0).select(part.alias("part"), F.posexplode(lines).alias("line", "value"))


def parallel_pairs(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """The lines of two aligned folders side by side."""
    a, b = (parallel_lines(spark, f"{path}/{c}").withColumnRenamed("value", c) for c in (first, second))
    return a.join(b, ["part", "line"])


def columns_of(df: DataFrame) -> DataFrame:
    """Name, type and nullability of each column."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "name string, type string, nullable boolean")


def profiles(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """name, n_columns, n_rows and has_key (no value of the table's key column is null or comes twice) of each table; counted by Spark, a pass a table."""
    rows = [
        df.agg(F.count("*").alias("n_rows"), F.countDistinct(keys[name]).alias("n")).select(F.lit(name).alias("name"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "n_rows", (F.col("n") == F.col("n_rows")).alias("has_key"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)
