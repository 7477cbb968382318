"""Profiles that grow with a stream: an extension, as profiles have no stream of their own.

Each micro-batch adds the counts of its values to a table of counts; matchers read
that table as a profile at any time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmatch.sources.profile import ColumnInfo, Profile, as_text


def value_counts(batch: DataFrame, columns: tuple[ColumnInfo, ...]) -> DataFrame:
    """(col_id, value, n) of the rows of one batch of the only table of ``columns``."""
    kinds = {f.name: f.dataType for f in batch.schema.fields}
    cells = F.array(*(F.struct(F.lit(c.col_id).alias("col_id"), as_text(F.col(f"`{c.column}`"), kinds[c.column]).alias("value")) for c in columns))
    return batch.select(F.inline(cells)).where(F.length("value") > 0).groupBy("col_id", "value").agg(F.count(F.lit(1)).alias("n"))


def follow(stream: DataFrame, columns: tuple[ColumnInfo, ...], path: str, checkpoint: str):
    """Start a query that adds every batch's counts to ``path``, each batch once.

    A batch writes a folder of its own, named by its number, so a batch that is run
    again after a failure replaces what it wrote.
    """
    def add(batch: DataFrame, number: int) -> None:
        value_counts(batch, columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def read(spark, path: str, columns: tuple[ColumnInfo, ...]) -> Profile:
    """The profile of all batches so far."""
    raw = spark.read.schema("col_id int, value string, n long, batch long").parquet(path)
    return Profile(columns, raw.groupBy("col_id", "value").agg(F.sum("n").alias("n")))


def union(profiles: list[Profile]) -> Profile:
    """One profile of several with columns numbered alike; counts add up."""
    counts = reduce(DataFrame.unionByName, [p.counts for p in profiles]).groupBy("col_id", "value").agg(F.sum("n").alias("n"))
    return Profile(profiles[0].columns, counts)
