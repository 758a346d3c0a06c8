"""Numbers of rows in a total order, as a parallel prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpointed


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their place in ``order``, from 0.

    Rows are dealt by ranges and sorted there; a row's place is the one in its partition after all rows of the
    partitions before, whose counts (one number a partition) are summed up apart.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    at = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    counts = {r["_part"]: r["count"] for r in at.groupBy("_part").count().collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    # one row a partition
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    return at.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33)).drop("_part", "_id", "_before")
