"""Queries of the general data-preparation problems (nested records, drifting schemas)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colmatch.operators import drift, nested
from colmatch.plans.shared import spread, table

# the array levels of an event: kind of row, path below the event, field
LEVELS = [
    ("party", "eventRouting.originatingParties", "partyCode"),
    ("document", "shipmentDetails.documentReference", "type"),
    ("additional_document", "shipmentDetails.additionalDocumentReferences", "type"),
]


def _tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """The events of all messages and a child table per array level that any payload has; those of LEVELS always."""
    m = spread(table(spark, sf_dir, "raw_messages").select("message_id", "payload"))
    return nested.child_tables(m, "message_id", "payload", records_key="events", always=["$", *(f"$[].{path}" for _, path, _ in LEVELS)], element="element")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties and document references of every event of every message."""
    tables, parts = _tables(spark, sf_dir), []
    for kind, path, field in LEVELS:
        rows = tables[f"$[].{path}[]"].where("is_object")
        value = F.coalesce(F.try_variant_get("element", f"$.{field}", "string"), F.lit(""))
        parts.append(rows.select("message_id", F.get("places", F.lit(0)).alias("event_pos"), F.lit(kind).alias("kind"), F.col("ordinal").alias("item_pos"), value.alias("code_value")))
    return reduce(DataFrame.unionByName, parts)


def _links(level: str, t: DataFrame) -> list[Column]:
    return [F.lit(level).alias("level"), *(t[c] for c in ("message_id", "row_key", "parent_key", "ordinal", "is_object"))]


def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all rows of the event table and of the child tables that p2_found reads."""
    tables = _tables(spark, sf_dir)
    parts = [tables[x].select(_links(x, tables[x])) for x in ("$[]", *(f"$[].{path}[]" for _, path, _ in LEVELS))]
    return reduce(DataFrame.unionByName, parts)


def p2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and scalar fields (a JSON object of texts) of all rows of all array levels that the payloads have."""
    parts = []
    for level, t in _tables(spark, sf_dir).items():
        if level != "$":
            fields = [t[f"`{c.replace('`', '``')}`"] for c in t.columns if c not in ("message_id", "row_key", "parent_key", "ordinal", "places", "is_object", "element")]
            parts.append(t.select(*_links(level, t), (F.to_json(F.struct(*fields)) if fields else F.lit("{}")).alias("fields")))
    return reduce(DataFrame.unionByName, parts)


def p2_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged schema of all payloads: path, kind and number of occurrences."""
    return nested.infer_schema(table(spark, sf_dir, "raw_messages"), "payload")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header changes of every visit file."""
    return drift.header_changes(table(spark, sf_dir, "visit_files"), table(spark, sf_dir, "visit_rows"))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visit rows in one table, each column of the common type of its declarations."""
    t = drift.unify(table(spark, sf_dir, "visit_files"), table(spark, sf_dir, "visit_rows"), typed=True)
    return t.withColumn("unconverted", F.to_json("unconverted"))


QUERIES = {"p2_found": p2_found, "p2_tables": p2_tables, "p2_levels": p2_levels, "p2_schema": p2_schema, "p3_found": p3_found, "p3_unified": p3_unified}
# payloads unwrapped and checked, then their events with places, then the objects and arrays of an event
_EVENTS = """w0 AS (SELECT message_id, payload AS d FROM raw_messages WHERE json_valid(payload)),
        w1 AS (SELECT message_id, CASE WHEN json_type(d) = 'VARCHAR' THEN d ->> '$' ELSE d END AS d FROM w0), w2 AS (SELECT message_id, CASE WHEN json_valid(d) AND json_type(d) = 'VARCHAR' THEN d ->> '$' ELSE d END AS d FROM w1 WHERE json_valid(d)),
        docs AS (SELECT message_id, d::JSON AS d FROM w2 WHERE json_valid(d) AND json_type(d) <> 'VARCHAR'),
        tops AS (SELECT message_id, CASE WHEN json_type(d) = 'OBJECT' AND list_contains(json_keys(d), 'events') THEN json_extract(d, '$.events') ELSE d END AS e FROM docs),
        evs AS (SELECT message_id, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS event_pos FROM (
          SELECT message_id, CASE json_type(e) WHEN 'ARRAY' THEN json_extract(e, '$[*]') WHEN 'OBJECT' THEN [e] END AS es FROM tops)),
        ev AS (SELECT * FROM evs WHERE json_type(e) <> 'NULL'),
        lists AS (""" + " UNION ALL ".join(
    f"SELECT message_id, event_pos, '{kind}' AS kind, '$[].{path}[]' AS level, '{field}' AS field, json_extract(e, '$.{path}') AS v FROM ev" for kind, path, field in LEVELS) + """),
        its AS (SELECT * EXCLUDE (v, xs), unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS item_pos FROM (
          SELECT *, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'OBJECT' THEN [v] END AS xs FROM lists)),
        it AS (SELECT * FROM its WHERE json_type(x) <> 'NULL')"""

SQL: dict[str, str] = {
    "p2_found": f"""WITH {_EVENTS} SELECT message_id, event_pos, kind, item_pos, coalesce(json_extract_string(x, '$.' || field), '') AS code_value FROM it WHERE json_type(x) = 'OBJECT'""",
    "p2_tables": f"""WITH {_EVENTS} SELECT '$[]' AS level, message_id, message_id || '/$[]:' || event_pos AS row_key, message_id::VARCHAR AS parent_key, event_pos AS ordinal, json_type(e) = 'OBJECT' AS is_object FROM ev
        UNION ALL SELECT level, message_id, message_id || '/$[]:' || event_pos || '/' || level || ':' || item_pos, message_id || '/$[]:' || event_pos, item_pos, json_type(x) = 'OBJECT' FROM it""",
    "p2_schema": """WITH RECURSIVE w0 AS (SELECT payload AS d FROM raw_messages WHERE json_valid(payload)), w1 AS (SELECT CASE WHEN json_type(d) = 'VARCHAR' THEN d ->> '$' ELSE d END AS d FROM w0),
        w2 AS (SELECT CASE WHEN json_type(d) = 'VARCHAR' THEN d ->> '$' ELSE d END AS d FROM w1 WHERE json_valid(d)),
        t(path, v) AS (SELECT '$', d::JSON FROM w2 WHERE json_valid(d) AND json_type(d) <> 'VARCHAR' UNION ALL
          SELECT path || u.k, u.x FROM (SELECT path, unnest(CASE json_type(v)
            WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'k': '.' || k, 'x': json_extract(v, '$."' || k || '"')})
            WHEN 'ARRAY' THEN list_transform(json_extract(v, '$[*]'), lambda x: {'k': '[]', 'x': x}) ELSE [] END) AS u FROM t))
        SELECT path, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS kind, count(*) AS n FROM t GROUP BY ALL""",
}
