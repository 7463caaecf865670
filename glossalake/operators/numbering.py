"""Row numbers over large groups: within blocks of the order, with the counts before them added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: list[str], order: list[str], block: Column, name: str = "place") -> DataFrame:
    """df with the 1-based place of each row of a group by order, a whole key; nulls are a group of their own.

    ``block`` must rise with the order, as a day does with a time: rows are numbered within a group's block, and only
    counts a block meet beyond that. So no task holds a whole group.
    """
    t = df.withColumn("__block", block)
    keys = [*group, "__block"]
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = t.groupBy(*keys).agg(F.count("*").alias("__n")).select(*(F.col(c).alias(f"{c}__c") for c in keys), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}__c")) for c in keys]
    placed = t.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed.join(counts, same).select(*(F.col(c) for c in df.columns), (F.col("__k") + F.col("__before")).alias(name))
