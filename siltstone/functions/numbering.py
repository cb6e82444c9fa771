"""Numbers for rows in a given order, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import cut


def numbered(df: DataFrame, order: list[str | Column], start: int, column: str) -> DataFrame:
    """df with column: start, start + 1, ... by order. Rows are sorted by ranges; a number a partition comes to the driver."""
    here = F.spark_partition_id()
    rows = cut(df.orderBy(*order).withColumn("_p", here).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(here.cast("long"), 33)))
    sizes = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}
    offsets, at = {}, start
    for p in sorted(sizes):
        offsets[p] = at
        at += sizes[p]
    first = F.element_at(F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]), F.col("_p")) if offsets else F.lit(start)
    return rows.withColumn(column, (F.col("_i") + first).cast("long")).drop("_p", "_i")
