"""Ranks over whole tables without a one-task window: a range sort, and the counts of its partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """rows with their place (from 1, gapless) in the given order of columns; rows that agree in all of them rank in any order.

    What meets in one task are the rows of one range and the partitions' counts, which are broadcast.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    parts = parts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn(name, inside).join(F.broadcast(parts), F.col("_part") == F.col("_p")).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_p", "_before")


def ranked_within(rows: DataFrame, key: str, order: list[str], name: str = "rank") -> DataFrame:
    """rows with their place within each value of key: places over the whole table, less those before the key's first."""
    every = checkpointed(ranked(rows, [key, *order], name))
    first = every.groupBy(F.col(key).alias("_k")).agg((F.min(name) - 1).alias("_before"))
    return every.join(first, F.col(key) == F.col("_k")).withColumn(name, F.col(name) - F.col("_before")).drop("_k", "_before")
