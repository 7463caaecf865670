"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossalake.shared import ARROW_ROWS as ARROW_ROWS
from glossalake.shared import shared_dir
from glossalake.shared import small_batches as small_batches

def inputs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as doc_id and text: other columns, whatever their names, play no part."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """name, or the next longer one that df has no column of, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def short_plans(spark: SparkSession) -> None:
    """Bound what the driver keeps of plans with long literals: the description of each query, which Spark holds for a thousand of them, ends after 64,000 characters."""
    key = "spark.sql.maxPlanStringLength"
    if int(spark.conf.get(key).rstrip("b")) > 64_000:  # the default is shown with its unit
        spark.conf.set(key, "64000")


#: The tables that each open scratch() will delete, the innermost last.
_SCRATCH: list[list[str]] = []


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as a table in the shared folder and read again: the plan is cut there, and a lost executor costs no recomputation of what lies before.

    Within ``scratch`` the table goes at its end, unless it is kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that operators store within it. Write or collect their results before, as these still read the tables."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        del _SCRATCH[next(k for k, x in enumerate(_SCRATCH) if x is made)]  # equal lists aren't the same
        for path in made:
            _delete(spark, path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by stored(), when nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a folder that can't be deleted only takes space
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


#: Bytes of text that a training sample holds, about.
SAMPLE_BYTES = 64 << 20


def sampled(df: DataFrame, most: int, seed: str, text_col: str = "text", most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """About ``most`` rows of df (all, if it has no more) and at most about ``most_bytes`` of text, picked by a hash of their id; at most twice as many rows whatever the ids are."""
    parts, total = 1_000_000, df.count()
    key = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(parts))
    share = parts if total <= most else max(1, most * parts // total)
    size = df.where(key < share).agg(F.sum(F.octet_length(text_col))).first()[0] or 0  # texts are read of the sample alone
    if size > most_bytes:
        share = max(1, share * most_bytes // size)
    return (df if share == parts else df.where(key < share)).limit(2 * most)


def bounded_sample(df: DataFrame, most: int, seed: str) -> list:
    return sampled(df, most, seed).collect()
