"""A global order without a single-partition window.

Rows are dealt out by range, sorted inside partitions and written to the shared folder, one file
for each partition. That pins the boundaries; what crosses partitions is one row for each, and a
row's number is its place in its file, which the Parquet reader knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.session import partitions_for, stage


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """df with _pid added, rising along the order; equal keys share a partition, written in order."""
    parts = partitions_for(df)
    return stage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()), "ordered", whole=True)


def numbered(df: DataFrame, *order: str, name: str = "_n") -> DataFrame:
    """df with each row's number in the order: 1, 2, ... (ties in any order)."""
    rows = dealt(df, *order)
    counts = rows.groupBy("_pid").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_pid", F.coalesce(before, F.lit(0)).alias("_before"))
    # One row for each partition, whatever the number of rows.
    found = rows.withColumn("_row", F.col("_metadata.row_index")).join(F.broadcast(offsets), "_pid")
    return found.withColumn(name, (F.col("_row") + F.col("_before") + 1).cast("bigint")).drop("_pid", "_row", "_before")
