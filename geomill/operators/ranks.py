"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.sources import shared

#: Rows of a range partition.
RANGE_ROWS = 500_000
#: Counts that are broadcast at most: about 20 MB.
BROADCAST_COUNTS = 200_000


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "place", size: str = "n") -> DataFrame:
    """rows with their place in their group, from 0 by ``order``, and the group's size.

    A window by group would put a group into one task. Here rows are sorted by ranges of
    (group, order), and a row's place is its number in its partition plus the group's rows in
    the partitions before: a hot group lies over many partitions. rows are read twice, for
    the ranges and for the sort, so they should be a table. Group and order should be unique
    and not null; equal rows get places in any order.
    """
    keys = [F.col(group), *[F.col(c) for c in order]]
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    at = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    at = shared.written(at, "numbered").withColumn("__part", F.shiftrightunsigned("__at", 33))
    counts = at.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = shared.written(counts.select(group, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias(size)), "counts")
    few = counts.count() <= BROADCAST_COUNTS
    joined = at.join(F.broadcast(counts) if few else counts, [group, "__part"])
    return joined.withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")
