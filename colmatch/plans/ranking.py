"""Places in a total order without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmatch.plans.shared import materialize


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its 1-based place in ``order``.

    Rows are range-partitioned and sorted, counted per partition, and the counts (one
    per partition) give each partition its offset.
    """
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    placed = materialize(placed, "ranked")
    total, offsets = 0, []
    for r in sorted(placed.groupBy("__p").count().collect(), key=lambda r: r[0]):
        offsets.append((r[0], total))
        total += r[1]
    start = df.sparkSession.createDataFrame(offsets, "__p int, __o long")
    return placed.join(F.broadcast(start), "__p").withColumn(name, F.col("__o") + F.col("__i") + 1).drop("__p", "__i", "__o")
