"""Tables as profiles: columns as metadata, values as one long relation.

A profile never holds values on the driver. ``counts`` is (col_id, value, n): every
distinct nonempty value of every column with its number of rows, counted in the
column's own type before it is written as text, so a column of few distinct values
shuffles few rows. Names and types of columns are metadata and stay in a list.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmatch.functions.types import DTYPES, InvalidInput, MatchOptions, logical_type
from colmatch.plans.ranking import global_rank


@dataclass(frozen=True)
class ColumnInfo:
    col_id: int
    table_no: int
    table: str
    column: str
    ordinal: int
    dtype: str


@dataclass(frozen=True)
class Profile:
    columns: tuple[ColumnInfo, ...]
    counts: DataFrame  # col_id int, value string, n long

    def persist(self) -> "Profile":
        """Keep the counts for several matchers; they spill to disk."""
        from pyspark import StorageLevel

        return Profile(self.columns, self.counts.persist(StorageLevel.MEMORY_AND_DISK))

    def table(self) -> DataFrame:
        """The columns as a relation."""
        rows = [(c.col_id, c.table_no, c.table, c.column, c.ordinal, c.dtype) for c in self.columns]
        return self.counts.sparkSession.createDataFrame(rows, "col_id int, table_no int, table string, column string, ordinal int, dtype string")

    def pairs(self) -> DataFrame:
        """Column pairs of different tables, earlier table first."""
        a, b = F.broadcast(self.table()), self.table()
        x = a.select(*(F.col(c).alias(f"{c}_a") for c in a.columns))
        y = b.select(*(F.col(c).alias(f"{c}_b") for c in b.columns))
        return y.join(x, F.col("table_no_a") < F.col("table_no_b"))

    def named(self, scored: DataFrame) -> DataFrame:
        """``scored`` (a, b, ...) with the four names in place of a and b."""
        ids = F.broadcast(self.table().select("col_id", "table", "column"))
        x = ids.select(F.col("col_id").alias("a"), F.col("table").alias("source_table"), F.col("column").alias("source_column"))
        y = ids.select(F.col("col_id").alias("b"), F.col("table").alias("target_table"), F.col("column").alias("target_column"))
        rest = [c for c in scored.columns if c not in ("a", "b")]
        return scored.join(x, "a").join(F.broadcast(y), "b").select("source_table", "source_column", "target_table", "target_column", *rest)


def as_text(col: Column, dtype: T.DataType) -> Column:
    """A value as text: floats in their shortest form, NaN as null."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        x = F.abs(col)
        long = F.regexp_replace(F.regexp_replace(col.cast("double").cast("decimal(38,17)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
        power = F.regexp_replace(F.regexp_replace(col.cast("string"), r"\.0E", "E"), "E", "e")
        text = F.when((x >= 1e-3) & (x < 1e7) | (x == 0), col.cast("string")).when((x >= 1e-4) & (x < 1e16), long).otherwise(power)
        return F.when(~F.isnan(col), text)
    return col.cast("string")


def validate(names: list[tuple[str, list[str]]]) -> None:
    """Nonempty unique table names, nonempty unique column names in each table."""
    seen = set()
    for table, cols in names:
        if not table:
            raise InvalidInput("a table name is empty")
        if table in seen:
            raise InvalidInput(f"two tables are named {table}")
        seen.add(table)
        if any(not c for c in cols):
            raise InvalidInput(f"table {table}: a column name is empty")
        if len(set(cols)) != len(cols):
            raise InvalidInput(f"table {table}: a column name is there twice")


def from_dataframes(tables: dict[str, DataFrame] | list[tuple[str, DataFrame]], dtypes: dict[tuple[str, str], str] | None = None) -> Profile:
    """The profile of named DataFrames over any source; columns are read in their own type.

    Null, NaN and empty values are left out. ``dtypes`` overrides declared types.
    """
    named = list(tables.items()) if isinstance(tables, dict) else list(tables)
    validate([(n, df.columns) for n, df in named])
    if not named:
        raise InvalidInput("no tables")
    infos: list[ColumnInfo] = []
    cells: dict[str, tuple[T.DataType, list[DataFrame]]] = {}  # by type, over all tables: an aggregate for each type
    for no, (name, df) in enumerate(named):
        by_type: dict[str, list[tuple[int, str, T.DataType]]] = {}
        for i, f in enumerate(df.schema.fields):
            kind = (dtypes or {}).get((name, f.name)) or logical_type(f.dataType)
            infos.append(ColumnInfo(len(infos), no, name, f.name, i, kind))
            if isinstance(f.dataType, T.NullType):
                continue
            wide = T.LongType() if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)) else f.dataType
            by_type.setdefault(wide.simpleString(), []).append((infos[-1].col_id, f.name, wide))
        for key, group in by_type.items():
            row = F.array(*(F.struct(F.lit(i).alias("col_id"), F.col(f"`{c.replace('`', '``')}`").cast(t).alias("value")) for i, c, t in group))
            cells.setdefault(key, (group[0][2], []))[1].append(df.select(F.inline(row)).where(F.col("value").isNotNull()))
    parts: list[DataFrame] = []
    for dtype, frames in cells.values():
        counted = reduce(DataFrame.unionByName, frames).groupBy("col_id", "value").agg(F.count(F.lit(1)).alias("n"))
        parts.append(counted.select("col_id", as_text(F.col("value"), dtype).alias("value"), "n").where(F.length("value") > 0))
    spark = named[0][1].sparkSession
    empty = spark.createDataFrame([], "col_id int, value string, n long")
    return Profile(tuple(infos), reduce(DataFrame.unionByName, parts) if parts else empty)


def from_fields(spark: SparkSession, tables: list[tuple[str, list[tuple[str, str, list[str]]]]]) -> Profile:
    """The profile of small in-memory tables: (table, [(column, dtype, samples)])."""
    validate([(t, [c for c, _, _ in cols]) for t, cols in tables])
    infos, rows = [], []
    for no, (t, cols) in enumerate(tables):
        for i, (c, dtype, samples) in enumerate(cols):
            infos.append(ColumnInfo(len(infos), no, t, c, i, dtype))
            rows += [(infos[-1].col_id, s) for s in samples or [] if s]
    df = spark.createDataFrame(rows, "col_id int, value string")
    return Profile(tuple(infos), df.groupBy("col_id", "value").agg(F.count(F.lit(1)).alias("n")))


def sample_evenly(df: DataFrame, group: str, order: str, limit: int | None) -> DataFrame:
    """Of each group's L rows, in ``order``, those at places floor(k L / limit) for k < limit.

    None keeps all rows and 0 none; a group with at most ``limit`` rows stays whole.
    Places come from one range-partitioned sort, so a column is no task of its own.
    """
    if limit is None:
        return df
    if limit < 0:
        raise InvalidInput("a sample size must not be negative")
    if limit == 0:
        return df.limit(0)
    placed = global_rank(df, [F.col(group), F.col(order)], "__r")
    begin = placed.groupBy(group).agg(F.min("__r").alias("__s"), F.count(F.lit(1)).alias("__l"))  # a row per group
    ranked = placed.join(begin, group).withColumn("__i", F.col("__r") - F.col("__s"))
    k = F.expr(f"CAST((CAST(__i AS DECIMAL(38,0)) * {limit} + __l - 1) div __l AS BIGINT)")  # the only k that can lead here
    place = F.expr(f"CAST((CAST(__k AS DECIMAL(38,0)) * __l) div {limit} AS BIGINT)")
    kept = ranked.withColumn("__k", k).where((F.col("__l") <= limit) | ((F.col("__k") < limit) & (place == F.col("__i"))))
    return kept.select(*df.columns)


def infer_types(counts: DataFrame) -> DataFrame:
    """col_id, dtype from all values: boolean, integer, float or text. Dates are never inferred."""
    v = F.lower(F.trim("value"))
    exact = F.col("value")
    whole = exact.rlike(r"^[+-]?[0-9]+$")
    number = exact.try_cast("decimal(38,0)")
    least, most = (F.lit(x).cast("decimal(38,0)") for x in ("-9223372036854775808", "18446744073709551615"))
    integer = whole & number.between(least, most)
    real = exact.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & (F.abs(exact.try_cast("double")) <= F.lit(1.7976931348623157e308))
    flags = counts.groupBy("col_id").agg(
        F.bool_and(v.isin("true", "false")).alias("b"), F.bool_and(F.coalesce(integer, F.lit(False))).alias("i"), F.bool_and(F.coalesce(real, F.lit(False))).alias("f"))
    return flags.select("col_id", F.when(F.col("b"), "boolean").when(F.col("i"), "integer").when(F.col("f"), "float").otherwise("text").alias("dtype"))


def with_inferred_types(p: Profile) -> Profile:
    """Types from the values, for sources that declare none; columns without values are unknown."""
    found = {r.col_id: r.dtype for r in infer_types(p.counts).collect()}
    return Profile(tuple(ColumnInfo(c.col_id, c.table_no, c.table, c.column, c.ordinal, found.get(c.col_id, "unknown")) for c in p.columns), p.counts)


def to_json(p: Profile, samples: int = 0) -> str:
    """The columns as JSON, each with its ``samples`` first distinct values by bytes; others stay where they are."""
    held: dict[int, list[str]] = {}
    if samples:
        first = p.counts.withColumn("r", F.row_number().over(Window.partitionBy("col_id").orderBy("value"))).where(F.col("r") <= samples)
        for r in first.orderBy("col_id", "value").collect():
            held.setdefault(r.col_id, []).append(r.value)
    return json.dumps([{"table": c.table, "name": c.column, "data_type": c.dtype, "ordinal": c.ordinal, "samples": held.get(c.col_id, [])} for c in p.columns])


def from_json(spark: SparkSession, text: str) -> Profile:
    """The profile that ``to_json`` wrote; missing samples are none, unknown types an error."""
    tables: dict[str, list[tuple[str, str, list[str]]]] = {}
    for c in sorted(json.loads(text), key=lambda c: c["ordinal"]):
        if c["data_type"] not in DTYPES:
            raise InvalidInput(f"column {c['name']}: unknown type {c['data_type']}")
        tables.setdefault(c["table"], []).append((c["name"], c["data_type"], c.get("samples", [])))
    order = list(dict.fromkeys(c["table"] for c in json.loads(text)))
    return from_fields(spark, [(t, tables[t]) for t in order])


def sampled_profile(p: Profile, tables: list[tuple[str, DataFrame]], options: MatchOptions, order: str | None = None) -> Profile:
    """``p`` with the counts of evenly spaced values only; types stay those of all values.

    ``order``: a column that fixes the order of rows; without it rows are numbered as
    they are read, which is stable for a single file only.
    """
    if options.instance_sample_size is None:
        return p
    ids = {(c.table, c.column): c.col_id for c in p.columns}
    parts = []
    for name, df in tables:
        keyed = df.withColumn("__at", F.col(f"`{order}`") if order else F.monotonically_increasing_id())
        cells = F.array(*(F.struct(F.lit(ids[name, f.name]).alias("col_id"), as_text(F.col(f"`{f.name}`"), f.dataType).alias("value")) for f in df.schema.fields))
        long = keyed.select("__at", F.inline(cells)).where(F.length("value") > 0)
        parts.append(sample_evenly(long, "col_id", "__at", options.instance_sample_size).select("col_id", "value"))
    kept = reduce(DataFrame.unionByName, parts).groupBy("col_id", "value").agg(F.count(F.lit(1)).alias("n"))
    return Profile(p.columns, kept)
