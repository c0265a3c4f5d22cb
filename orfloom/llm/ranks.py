"""Numbers of rows in a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orfloom.llm import scratch


def numbered(df: DataFrame, order: list[Column], column: str, name: str) -> DataFrame:
    """df with ``column``: 1, 2, 3 ... in the given order; rows that tie get numbers in any order.

    Range partitions are sorted and written once; a row's number is its place in
    its partition behind the rows of the partitions before (one count for each).
    An empty table gives an empty one.
    """
    rows = scratch.table(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    counts = dict(rows.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    offsets = df.sparkSession.createDataFrame(before, "part long, before long")
    place = F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        rows.withColumn("part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "part")
        .withColumn(column, place).drop("part", "before", "_at")
    )
