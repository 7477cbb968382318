"""The N best items of every group, by statistics-guided skipping.

1. Equal items of a group are reduced to their best score (map-side combined, so
   a pair delivered very often is one row before it is shuffled).
2. The rows are range-partitioned and sorted by (group, score descending, item)
   and written with small row groups. A range boundary may fall inside a group,
   so a group with a third of all rows is spread over many files.
3. One task per file reads the footer: which groups a row group holds (from the
   least to the largest in sorted order) and its least and largest score. A row group
   of N rows or more of one group bounds this group's N-th score from below; the best
   bound of each group, an aggregate, holds for all files.
4. One task per file visits its row groups in descending maximum score and skips
   those whose maximum is strictly below the current N-th score of every group they
   hold: the bound, or what the task has read since. A row group of several groups
   holds the best rows of all but its first one, so it is read for these.
5. The few candidates left of groups that cross files are ranked once more.

Nothing is collected; a task holds one row group and the candidates it found.
The shared folder must be reachable through ``pyarrow.fs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmatch.plans.shared import materialize, shared_path


def cluster_by_group(df: DataFrame, group: list[str], item: list[str], score: str, path: str,
                     row_group_bytes: int = 128 << 10) -> None:
    """Write ``df`` clustered by group, best scores first, with row-group statistics."""
    order = [*map(F.col, group), F.col(score).desc(), *map(F.col, item)]
    (df.select(*group, *item, score)
       .repartitionByRange(*order).sortWithinPartitions(*order)
       .write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", 64 << 10)
       .option("parquet.page.size.row.check.min", 64).option("parquet.block.size.row.check.min", 64).option("parquet.block.size.row.check.max", 1024)
       .parquet(path))


def row_group_facts(pf, group: list[str], score: str) -> list[tuple[int, int, float, float, tuple | None]]:
    """(index, rows, least score, largest score, the only group or None) of each row group.

    Without statistics a row group may hold any score of any group.
    """
    at = {pf.schema_arrow.names[i]: i for i in range(len(pf.schema_arrow.names))}
    out = []
    for i in range(pf.metadata.num_row_groups):
        meta = pf.metadata.row_group(i)
        stats = {c: meta.column(at[c]).statistics for c in [*group, score]}
        known = {c: s is not None and s.has_min_max for c, s in stats.items()}
        low, top = (stats[score].min, stats[score].max) if known[score] else (float("-inf"), float("inf"))
        one = all(known[c] and stats[c].min == stats[c].max for c in group)
        out.append((i, meta.num_rows, low, top, tuple(stats[c].max for c in group) if one else None))
    return out


def row_groups_to_read(facts: list[tuple], bounds: dict[tuple, float]) -> list[tuple[float, int, tuple | None]]:
    """(largest score, index, only group) in descending order of scores; those below their group's bound are left out."""
    kept = [(top, i, only) for i, _, _, top, only in facts if only is None or top >= bounds.get(only, float("-inf"))]
    return sorted(kept, key=lambda x: (-x[0], x[1]))


def _facts(group: list[str], score: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    facts = row_group_facts(pq.ParquetFile(f), group, score)
                yield pa.RecordBatch.from_pydict({
                    "uri": [uri] * len(facts), "rg": [x[0] for x in facts], "n": [x[1] for x in facts], "low": [float(x[2]) for x in facts], "top": [float(x[3]) for x in facts],
                    "single": [x[4] is not None for x in facts], **{f"g{k}": [None if x[4] is None else x[4][k] for x in facts] for k in range(len(group))}},
                    schema=pa.schema([("uri", pa.string()), ("rg", pa.int64()), ("n", pa.int64()), ("low", pa.float64()), ("top", pa.float64()), ("single", pa.bool_()), *((f"g{k}", pa.string()) for k in range(len(group)))]))

    return read


def row_group_index(files: DataFrame, group: list[str], score: str, n: int) -> DataFrame:
    """uri, rg, n, low, top, single, g0.., bound, read of each row group of the files (uri).

    ``bound``: the best lower bound of its only group's N-th score; ``read`` is false
    where it is above the row group's largest score.
    """
    names = [f"g{k}" for k in range(len(group))]
    schema = "uri string, rg long, n long, low double, top double, single boolean, " + ", ".join(f"{g} string" for g in names)
    facts = materialize(files.mapInArrow(_facts(group, score), schema), "rowgroups")
    bounds = facts.where(F.col("single") & (F.col("n") >= n)).groupBy(*names).agg(F.max("low").alias("bound"))
    return facts.join(bounds, names, "left").withColumn("read", F.col("bound").isNull() | (F.col("top") >= F.col("bound")))


def _best_of_sorted(t: pa.Table, group: list[str], n: int):
    """The first n rows of every group of a row group that is sorted by group."""
    import numpy as np
    import pyarrow.compute as pc

    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for c in group:
        a = t.column(c).combine_chunks()
        if t.num_rows > 1:
            new[1:] |= pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    rank = np.arange(t.num_rows) - np.repeat(starts, np.diff(np.append(starts, t.num_rows)))
    return t.filter(pa.array(rank < n))


def _reader(group: list[str], score: str, n: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            for uri, keep in zip(batch.column("uri").to_pylist(), batch.column("rgs").to_pylist()):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    pf = pq.ParquetFile(f)
                    best: dict[tuple, list[float]] = {}  # of groups that may go on in another row group
                    wanted = set(keep)
                    facts = [x for x in row_group_facts(pf, group, score) if x[0] in wanted]
                    for top, i, only in row_groups_to_read(facts, {}):
                        have = best.get(only, [])
                        if only is not None and len(have) >= n and top < have[n - 1]:
                            continue
                        t = pf.read_row_group(i)
                        if not t.num_rows:
                            continue
                        kept = _best_of_sorted(t, group, n)
                        keys = {tuple(kept.column(c)[j].as_py() for c in group) for j in (0, kept.num_rows - 1)}
                        for key in keys:
                            m = None
                            for c, v in zip(group, key):
                                e = pa.compute.equal(kept.column(c), v)
                                m = e if m is None else pa.compute.and_(m, e)
                            s = kept.filter(m).column(score).to_pylist()
                            best[key] = sorted([*best.get(key, []), *s], reverse=True)[:n]
                        yield from kept.to_batches()

    return read


def top_n_per_group(df: DataFrame, group: list[str], item: list[str], score: str, n: int = 5,
                    row_group_bytes: int = 128 << 10) -> DataFrame:
    """The ``n`` best items of each group as columns group + item + score.

    An item delivered several times counts once, with its best score. Ties go to
    the smaller item columns, ascending by UTF-8 bytes. Rows with a null in a group
    or item column, or a score that is null or NaN, count for nothing; an empty
    table gives an empty table; other columns of ``df`` are ignored, whatever
    their names. A group with fewer than ``n`` items keeps all of them.
    """
    spark = df.sparkSession
    value = F.col(score).cast("double")
    whole = F.lit(True)
    for c in [*group, *item]:
        whole = whole & F.col(c).isNotNull()
    best = (df.where(whole & value.isNotNull() & ~F.isnan(value))
              .groupBy(*group, *item)
              .agg(F.max(F.when(value == 0, F.lit(0.0)).otherwise(value)).alias(score)))
    path = shared_path(spark, "topn")
    cluster_by_group(best, group, item, score, path, row_group_bytes)
    written = spark.read.schema(best.schema).parquet(path)
    files = written.inputFiles()
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in best.schema])
    if not files:
        return spark.createDataFrame([], schema)
    todo = row_group_index(spark.createDataFrame([(f,) for f in files], "uri string").repartition(len(files)), group, score, n)
    todo = todo.where("read").groupBy("uri").agg(F.collect_list("rg").alias("rgs")).repartition(len(files), "uri")
    found = todo.mapInArrow(_reader(group, score, n), schema)
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), *map(F.col, item))
    return found.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")
