"""Schemas that drift between files: changes per file, and one consistent table.

Inputs: ``files`` (file_id, site, extract_no, declared_fields) and ``rows``
(file_id, row_no, cells). A file is compared with the preceding extract of its
site. Fields are matched by name; a field that lost its name is looked for among
the new ones by its values in the records that both files hold. Records are
aligned without a declared key: rows that agree in the values of discriminating
fields of the same name are the same record. All of this is joins on (file,
value), so neither a site nor a file has to fit into one task. The edit script of
a file pair is then the cheapest one between the two header trees, and scripts
compile into the projection of each file.

Nulls: a file without header or site gives no change; null cells are no evidence;
repeated rows count once per alignment; names that repeat within a header after
trimming keep their first place only. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmatch.functions.expressions import let
from colmatch.functions.names import trigram_similarity
from colmatch.operators.tree_edit import FORBIDDEN, Node, edit_script
from colmatch.plans.shared import materialize

# Spellings of the declared types.
SPELLINGS = {
    "boolean": ["boolean", "bool", "bit", "logical"],
    "integer": ["integer", "int", "bigint", "smallint", "tinyint", "long", "short", "int2", "int4", "int8", "int32", "int64", "serial", "bigserial"],
    "float": ["float", "double", "double precision", "real", "float4", "float8", "float32", "float64"],
    "decimal": ["decimal", "numeric", "number", "dec", "money"],
    "text": ["text", "string", "varchar", "char", "nvarchar", "nchar", "character", "character varying", "clob", "str", "varchar2"],
    "date": ["date"],
    "timestamp": ["timestamp", "datetime", "timestamptz", "timestamp_ntz", "datetime2", "timestamp without time zone", "timestamp with time zone"],
}

CHANGES = "file_id long, change_kind string, name_before string, name_after string"


def field_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""))


def field_type(name: Column) -> Column:
    """The project's type of a declared one; an unknown spelling stands for itself."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("unknown")))), r"\s*\([^)]*\)", ""))
    out = F.when(bare.isin(SPELLINGS["text"]), F.lit("text"))
    for kind, names in SPELLINGS.items():
        if kind != "text":
            out = out.when(bare.isin(names), F.lit(kind))
    return out.otherwise(bare)


def plain_value(value: Column, kind: Column) -> Column:
    """A cell apart from its way of writing: numbers without trailing zeros, times without a zero clock."""
    v = F.lower(F.trim(value))
    short = lambda x: F.when(x.contains("."), F.regexp_replace(x, r"(?:\.0*|(\.[0-9]*?)0+)$", "$1")).otherwise(x)
    bare = F.when(F.substring(v, 1, 1).isin("+", "-", "0"), F.regexp_replace(F.regexp_replace(v, r"^\+", ""), r"^(-?)0+([0-9])", "$1$2")).otherwise(v)
    number = F.when(v.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), short(bare))
    science = F.when(v.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?e[+-]?[0-9]+$"), short(v.try_cast("double").try_cast("decimal(38,6)").cast("string")))
    clock = F.when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[t ][0-9:.]+z?$"), F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "t", " "), r"z$", ""), r"( 00:00(:00)?)?(\.0+)?$", ""))
    truth = F.when(kind == "boolean", F.when(v.isin("true", "t", "yes", "y", "1"), F.lit("true")).when(v.isin("false", "f", "no", "n", "0"), F.lit("false")))
    return F.coalesce(truth, number, science, clock, v)


def current_extracts(files: DataFrame) -> DataFrame:
    """One file of each site and extract_no, the one with the smallest id, and its predecessor (or null)."""
    one = (files.where(F.col("site").isNotNull() & F.col("extract_no").isNotNull() & F.col("declared_fields").isNotNull())
                .groupBy("site", "extract_no").agg(F.min("file_id").alias("file_id")))
    return one.withColumn("prev_id", F.lag("file_id").over(Window.partitionBy("site").orderBy("extract_no")))


def headers(files: DataFrame) -> DataFrame:
    """file_id, header: array of (name, type, pos) by first occurrence of each name."""
    numbered = F.transform("declared_fields", lambda x, i: F.struct(field_name(x["name"]).alias("name"), field_type(x["data_type"]).alias("type"), i.alias("pos")))
    first = let(numbered, lambda all_: let(F.transform(all_, lambda y: y["name"]), lambda names: F.filter(
        all_, lambda x: x["pos"] == F.array_position(names, x["name"]).cast("int") - 1)))
    return files.select("file_id", first.alias("header"))


def value_evidence(pairs: DataFrame, rows: DataFrame, least_distinct: float = 0.5) -> DataFrame:
    """file_id, evidence: array of (before, after, same, both) for lost and new names of each pair.

    ``pairs``: file_id, prev_id, before and after (headers). ``both`` counts the
    aligned records with a value on both sides, ``one`` those with one on one side only.
    """
    names = lambda h: F.transform(h, lambda x: x["name"])
    p = (pairs.withColumn("lost", F.array_except(names(F.col("before")), names(F.col("after"))))
              .withColumn("new", F.array_except(names(F.col("after")), names(F.col("before"))))
              .where((F.size("lost") > 0) & (F.size("new") > 0)))
    kept = F.array_intersect(names(F.col("before")), names(F.col("after")))
    sides = (p.select(F.col("prev_id").alias("of_file"), "file_id", F.lit(0).alias("side"), F.col("before").alias("header"), kept.alias("kept"), F.col("lost").alias("odd"))
              .unionByName(p.select(F.col("file_id").alias("of_file"), "file_id", F.lit(1).alias("side"), F.col("after").alias("header"), kept.alias("kept"), F.col("new").alias("odd"))))

    def cell(h: Column) -> Column:  # hashes of the value and of its day, null for an empty cell
        v = plain_value(F.get(F.col("cells"), h["pos"]), h["type"])
        return let(v, lambda x: F.struct(h["name"].alias("name"), F.when(x != "", F.xxhash64(x)).alias("v"),
                                         F.when(h["type"].isin("date", "timestamp"), F.xxhash64(F.substring(x, 1, 10))).alias("day"), h["type"].alias("type")))

    of = rows.select(F.col("file_id").alias("of_file"), "cells").where(F.col("cells").isNotNull())
    told = (sides.join(of, "of_file")
                 .select("file_id", "side", F.xxhash64("of_file", "cells").alias("row_key"), "kept", "odd", F.transform("header", cell).alias("cells"))
                 .select("file_id", "side", "row_key",
                         F.transform(F.filter("cells", lambda c: F.array_contains("kept", c["name"]) & c["v"].isNotNull()), lambda c: F.struct(F.xxhash64(c["name"]).alias("name"), c["v"].alias("value"))).alias("kept"),
                         F.transform("odd", lambda n: F.get(F.filter("cells", lambda c: c["name"] == n), F.lit(0)).dropFields("name")).alias("odd"))
                 .dropDuplicates(["file_id", "side", "row_key"]))
    told = materialize(told, "cells")
    values = told.select("file_id", "side", "row_key", F.inline("kept"))
    # a value that both files hold once tells which record is which; repeated ones never meet
    held = lambda side: F.count_if(F.col("side") == side).alias(f"n{side}")
    row = lambda side, name: F.max(F.when(F.col("side") == side, F.col("row_key"))).alias(name)
    per = values.groupBy("file_id", "name", "value").agg(held(0), held(1), row(0, "row_a"), row(1, "row_b"))
    keen = (per.groupBy("file_id", "name").agg(*(F.sum(f"n{i}").alias(f"s{i}") for i in (0, 1)), *(F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in (0, 1)))
               .where(" and ".join(f"d{i} > 0 and d{i} >= {least_distinct} * s{i}" for i in (0, 1))).select("file_id", "name"))
    fields = keen.groupBy("file_id").agg(F.collect_set("name").alias("keen"))  # names of one header
    votes = (per.where("n0 = 1 and n1 = 1").join(fields, "file_id").where("array_contains(keen, name)")
                .groupBy("file_id", "row_a", "row_b").agg(F.count(F.lit(1)).alias("votes"), F.first(F.size("keen")).alias("keen")))
    best = votes.groupBy("file_id", "row_b").agg(F.max(F.struct("votes", "row_a", "keen")).alias("m")).select("file_id", "row_b", "m.*")
    # two fields must agree, if there are two that tell records apart
    aligned = best.where("votes >= least(keen, 2)").select("file_id", "row_a", "row_b")
    met = (aligned.join(told.where("side = 0").select("file_id", F.col("row_key").alias("row_a"), F.col("odd").alias("xs")), ["file_id", "row_a"])
                  .join(told.where("side = 1").select("file_id", F.col("row_key").alias("row_b"), F.col("odd").alias("ys")), ["file_id", "row_b"]))
    each = F.flatten(F.transform("xs", lambda x, i: F.transform("ys", lambda y, j: F.struct(i.alias("i"), j.alias("j"), x.alias("x"), y.alias("y")))))
    x, y = F.col("x"), F.col("y")
    days = (x["type"] != y["type"]) & (x["day"] == y["day"])
    counted = met.select("file_id", F.inline(each)).groupBy("file_id", "i", "j").agg(
        F.count_if((x["v"] == y["v"]) | F.coalesce(days, F.lit(False))).alias("same"), F.count_if(x["v"].isNotNull() & y["v"].isNotNull()).alias("both"),
        F.count(x["v"]).alias("n_before"), F.count(y["v"]).alias("n_after")).where("both > 0")
    named = counted.join(p.select("file_id", "lost", "new"), "file_id").select("file_id", F.struct(
        F.get("lost", F.col("i")).alias("before"), F.get("new", F.col("j")).alias("after"), "same", "both", "n_before", "n_after").alias("e"))
    return named.groupBy("file_id").agg(F.collect_list("e").alias("evidence"))


def _scripts(agree: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file_id, before, after, evidence in zip(b.file_id, b.before, b.after, b.evidence):
                known = {(e["before"], e["after"]): e for e in (evidence if evidence is not None else [])}

                def rename(p, q, x, y, known=known):
                    e = known.get((x.name, y.name))
                    if e is None or e["same"] < agree * e["both"]:
                        return FORBIDDEN
                    fill = max(e["n_before"], e["n_after"])  # a renamed field is empty in the same records
                    if e["same"] < 2 and fill > 2:
                        return FORBIDDEN
                    tie = 1e-3 * (x.type != y.type) + 1e-4 * (1.0 - trigram_similarity(x.name, y.name))  # between equal evidence
                    return 1.0 - e["same"] / e["both"] + 0.5 * (1.0 - e["both"] / fill) + tie

                tree = lambda h: Node("", "struct", tuple(Node(f["name"], f["type"]) for f in h))
                for e in edit_script(tree(before), tree(after), rename)[1]:
                    out.append((file_id, e.kind, e.before, e.after))
            yield pd.DataFrame(out, columns=["file_id", "change_kind", "name_before", "name_after"])

    return run


def header_changes(files: DataFrame, rows: DataFrame, agree: float = 0.8) -> DataFrame:
    """Each change of a file's header against the preceding extract of its site.

    file_id, change_kind (added, removed, renamed, retyped), name_before,
    name_after. ``agree``: least share of aligned records whose values must be equal
    for a rename. Between renames of equal evidence the one within a type and the more
    similar name is taken.
    """
    heads = headers(files)
    chain = current_extracts(files).where(F.col("prev_id").isNotNull())
    pairs = (chain.join(heads.select("file_id", F.col("header").alias("after")), "file_id")
                  .join(heads.select(F.col("file_id").alias("prev_id"), F.col("header").alias("before")), "prev_id")
                  .select("file_id", "prev_id", "before", "after"))
    pairs = materialize(pairs, "pairs")
    found = pairs.join(value_evidence(pairs, rows), "file_id", "left")
    return found.select("file_id", "before", "after", "evidence").mapInPandas(_scripts(agree), CHANGES)


def unified_names(files: DataFrame, changes: DataFrame) -> DataFrame:
    """file_id, pos, name, type, unified: the name under which each field goes in the consistent table.

    A field goes by the last name it has in its site; later renames are followed
    until none applies, a join per step (at most as many as one field's renames).
    """
    chain = current_extracts(files).select("site", "extract_no", "file_id")
    fields = (headers(files).join(files.select("file_id", "site", "extract_no"), "file_id")
              .select("file_id", "site", "extract_no", F.explode("header").alias("h"))
              .select("file_id", "site", "extract_no", "h.pos", "h.name", "h.type"))
    moves = (changes.where("change_kind = 'renamed'").join(chain, "file_id")
             .select("site", F.col("extract_no").alias("at"), F.col("name_before").alias("unified"), F.col("name_after").alias("next")))
    now = fields.withColumn("unified", F.col("name")).withColumn("since", F.col("extract_no"))
    while True:
        step = now.join(moves, ["site", "unified"], "left")
        first = (step.withColumn("at", F.when(F.col("at") > F.col("since"), F.col("at")))
                     .groupBy("file_id", "site", "extract_no", "pos", "name", "type", "unified", "since")
                     .agg(F.min(F.when(F.col("at").isNotNull(), F.struct("at", "next"))).alias("m")))
        moved = materialize(first.select("file_id", "site", "extract_no", "pos", "name", "type",
                                         F.coalesce("m.next", "unified").alias("unified"), F.coalesce("m.at", "since").alias("since"), F.col("m").isNotNull().alias("moved")), "names")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now.select("file_id", "pos", "name", "type", "unified")


# What a column of each type becomes.
CASTS = {"integer": "bigint", "decimal": "decimal(38,10)", "float": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp"}


def common_type(kinds: set[str]) -> str:
    """The narrowest type that holds all values of the declared ones; text where there is none."""
    numbers: set[str] = set()
    for wider in ("integer", "decimal", "float"):
        numbers.add(wider)
        if kinds <= numbers:
            return wider
    if kinds <= {"date", "timestamp"}:
        return "date" if kinds == {"date"} else "timestamp"
    return "boolean" if kinds == {"boolean"} else "text"


def unify(files: DataFrame, rows: DataFrame, changes: DataFrame | None = None, max_fields: int = 2_000, typed: bool = False) -> DataFrame:
    """All rows in one table: file_id, row_no and a column per unified field, in plain writing.

    The projection of a file is its list of (place, unified name, type), compiled from
    its site's scripts and joined on file_id; no row is compared with another. With
    ``typed`` a column has the common type of all files' declarations; a value that
    isn't of this type is kept as text in the map ``unconverted``, by column.
    ``max_fields`` bounds the merged header that the driver holds; more is an error.
    """
    names = unified_names(files, header_changes(files, rows) if changes is None else changes)
    held = names.groupBy("unified").agg(F.collect_set("type").alias("types")).limit(max_fields + 1).collect()
    if len(held) > max_fields:
        raise ValueError(f"merged header: more than {max_fields} fields")
    merged = {r.unified: common_type(set(r.types)) for r in sorted(held)}
    plan = (names.groupBy("file_id", "unified").agg(F.min(F.struct("pos", "type")).alias("p"))
                 .groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("unified", "p"))).alias("plan")))
    value = lambda e: plain_value(F.get("cells", e["value"]["pos"]), e["value"]["type"])
    named = (rows.select("file_id", "row_no", "cells").join(plan, "file_id")
                 .select("file_id", "row_no", F.map_from_entries(F.transform(F.map_entries("plan"), lambda e: F.struct(e["key"], value(e)))).alias("named")))
    text = {n: F.col("named")[F.lit(n)] for n in merged}
    if not typed:
        return named.select("file_id", "row_no", *(v.alias(n or "unnamed") for n, v in text.items()))
    cast = {n: text[n].try_cast(CASTS[t]) if t != "decimal" else F.when(~text[n].rlike(r"[.][0-9]{11}"), text[n].try_cast(CASTS[t])) for n, t in merged.items() if t in CASTS}
    odd = F.map_filter(F.create_map(*(x for n in cast for x in (F.lit(n), F.when(cast[n].isNull(), F.nullif(text[n], F.lit("")))))) if cast else F.create_map().cast("map<string,string>"), lambda k, v: v.isNotNull())
    extra = "unconverted"
    while extra in merged:
        extra += "_"
    return named.select("file_id", "row_no", *(cast.get(n, v).alias(n or "unnamed") for n, v in text.items()), odd.alias(extra))
