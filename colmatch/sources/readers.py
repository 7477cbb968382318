"""Readers for CSV, JSON and rows, and the JSON form of results."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmatch.functions.types import InvalidInput


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 with a header, comma and double quotes; every column text, empty cells null.

    A row of another width than the header is an error.
    """
    head = spark.read.csv(path, header=False, multiLine=True, quote='"', escape='"', enforceSchema=True).limit(1).collect()
    if not head:
        raise InvalidInput(f"{path}: no header")
    names = [v or "" for v in head[0]]
    if any(not n for n in names) or len(set(names)) != len(names):
        raise InvalidInput(f"{path}: column names must be nonempty and unique")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", nullValue="", emptyValue="")


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of flat objects; columns by name, all text as written, missing and null cells null.

    A nested value is an error that names the column.
    """
    df = spark.read.json(path, multiLine=True, primitivesAsString=True, mode="FAILFAST")
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            raise InvalidInput(f"{path}: column {f.name} is nested")
    return df.select(*(F.col(f"`{n}`") for n in sorted(df.columns)))


def from_rows(spark: SparkSession, headers: list[str], rows: list[list[str | None]]) -> DataFrame:
    """Rows of nullable text; each as wide as the headers."""
    for i, r in enumerate(rows):
        if len(r) != len(headers):
            raise InvalidInput(f"row {i} has {len(r)} cells, not {len(headers)}")
    return spark.createDataFrame([tuple(v or None for v in r) for r in rows], T.StructType([T.StructField(h, T.StringType()) for h in headers]))


def from_path(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """JSON by its extension in any case, else CSV; larger files than ``max_bytes`` are refused unread."""
    if max_bytes is not None:
        local = path.removeprefix("file://")
        length = os.path.getsize(local) if os.path.exists(local) else spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
        if length is None or length > max_bytes:
            raise InvalidInput(f"{path}: {length} bytes; the limit is {max_bytes}")
    return from_json(spark, path) if path.lower().endswith(".json") else from_csv(spark, path)


def results_json(matches: DataFrame) -> str:
    """The ranked matches as one JSON document, for the command line; results of that size only."""
    rows = matches.select("source_table", "source_column", "target_table", "target_column", "score", *(["details"] if "details" in matches.columns else [])).collect()
    out = []
    for r in rows:
        entry = {"pair": {k: r[k] for k in ("source_table", "source_column", "target_table", "target_column")}, "score": r["score"]}
        if "details" in r and r["details"]:
            entry["details"] = dict(r["details"])
        out.append(entry)
    return json.dumps({"matches": out}, indent=2, ensure_ascii=False)
