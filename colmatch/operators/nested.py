"""Deeply nested JSON records as flat tables that keep parent-child links.

``parse`` checks and unwraps the text and gives a VARIANT; ``infer_schema`` merges
the shapes of all records; ``child_tables`` turns every array level into a table
whose rows carry the parent's surrogate key and their ordinal. Each text is checked
and parsed once: the VARIANT is written with the record's shapes, from which both the
merged schema and all tables are read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmatch.plans.shared import materialize


class _Number(str):
    """The text of a number, as it stands in the document."""


def _refuse(name: str):
    raise ValueError(name)


_decoder = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse)


def decode_strict(text: str | None):
    """The document in ``text``; a JSON string holding JSON text is read as that text.

    Raises ValueError for anything that is not one complete JSON document.
    """
    if text is None:
        raise ValueError("null")
    while True:
        try:
            value = _decoder.decode(text)
        except RecursionError as e:
            raise ValueError("nested too deeply") from e
        if type(value) is not str:
            return value
        text = value


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Complete documents with every number as the string of its digits; null for others."""

    def one(text):
        try:
            return json.dumps(decode_strict(text), separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return texts.map(one, na_action="ignore").astype(object).where(texts.notna(), None)


_canonical_once = canonical_json.asNondeterministic()  # else the planner copies it into filters and checks every text twice


def parse(text: Column) -> Column:
    """The document as VARIANT; null where the text is null, blank or not complete JSON.

    Numbers are kept as the string of their digits, so no value changes its
    spelling. A document nested deeper than the JSON library allows counts as damaged.
    """
    return F.try_parse_json(_canonical_once(text))


def as_object(v: Column) -> Column:
    """The variant as map of its fields, or null if it is no object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """The elements of an array; an object in place of an array is its only element."""
    whole = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce(whole, F.when(as_object(v).isNotNull(), F.array(v)))


def explode_level(parent: DataFrame, elements: Column, pos: str, item: str) -> DataFrame:
    """One row per non-null element, with its 0-based place among all elements."""
    return (parent.select("*", F.posexplode(elements).alias(pos, item))
                  .where(F.col(item).isNotNull() & ~F.is_variant_null(F.col(item)))
                  .withColumn(pos, F.col(pos).cast("long")))


def _escaped(key: str) -> str:
    """The key as a step of a path that is taken apart again; ordinary keys stay."""
    return re.sub(r"[%.\[\]]", lambda m: f"%{ord(m[0]):02X}", key) or "%"


def _unescaped(step: str) -> str:
    return "" if step == "%" else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), step)


def _shapes(value, step: Callable[[str], str] = str) -> dict[tuple[str, str], int]:
    """How often each (path, kind) is in a document."""
    seen: dict[tuple[str, str], int] = {}
    todo = [("$", value)]
    while todo:
        path, v = todo.pop()
        kind = ("object" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None
                else "boolean" if isinstance(v, bool) else "number" if isinstance(v, _Number) else "string")
        seen[path, kind] = seen.get((path, kind), 0) + 1
        if kind == "object":
            todo += [(f"{path}.{step(k)}", x) for k, x in v.items()]
        elif kind == "array":
            todo += [(f"{path}[]", x) for x in v]
    return seen


def _records(v, key: str) -> list:
    """Elements at the top-level ``key``; without it those of the top-level array, or the top-level object."""
    if isinstance(v, dict) and key in v:
        v = v[key]
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else []


def _told(records_key: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b.iloc[:, 0], b.iloc[:, 1]):
                try:
                    v = decode_strict(t)
                    v = v if records_key is None else _records(v, records_key)
                    out.append((i, json.dumps(v, separators=(",", ":")), [f"{kind} {path}" for path, kind in _shapes(v, _escaped)]))
                except (ValueError, TypeError, RecursionError):
                    continue
            yield pd.DataFrame({c: pd.Series([x[k] for x in out], dtype=object) for k, c in enumerate(("id", "doc", "shapes"))})

    return run


def parsed_once(df: DataFrame, id_col: str, text: str, records_key: str | None = None) -> DataFrame:
    """id, doc (VARIANT), shapes of every complete document, written to the shared folder.

    With ``records_key`` a document stands for the array of its records: the elements
    at that key, without it those of the top-level array, or the top-level object.
    """
    kind = df.schema[id_col].dataType.simpleString()
    known = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    told = known.mapInPandas(_told(records_key), f"id {kind}, doc string, shapes array<string>")
    return materialize(told.select("id", F.try_parse_json("doc").alias("doc"), "shapes").where(F.col("doc").isNotNull()), "documents")


def infer_schema(df: DataFrame, text: str) -> DataFrame:
    """The merged schema: path, kind (object, array, string, number, boolean, null) and count.

    Array levels end in ``[]``; an object where other records have an array is
    counted at the array's path as well, see ``child_tables``.
    """

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for t in b.iloc[:, 0]:
                try:
                    seen.update(_shapes(decode_strict(t)))
                except (ValueError, TypeError):
                    continue
            yield pd.DataFrame([(p, k, n) for (p, k), n in seen.items()], columns=["path", "kind", "n"])

    return (df.select(text).mapInPandas(shapes, "path string, kind string, n long")
              .groupBy("path", "kind").agg(F.sum("n").alias("n")))


class _Tables(Mapping):
    """Tables by path, each planned when it is first asked for: deep levels cost nothing to those who need others."""

    def __init__(self, levels: list[str], make: Callable[[str], DataFrame]):
        self._levels, self._make, self._made = levels, make, {}

    def __getitem__(self, level: str) -> DataFrame:
        if level not in self._made:
            if level not in self._levels:
                raise KeyError(level)
            self._made[level] = self._make(level)
        return self._made[level]

    def __iter__(self) -> Iterator[str]:
        return iter(self._levels)

    def __len__(self) -> int:
        return len(self._levels)


def child_tables(df: DataFrame, id_col: str, text: str, max_paths: int = 10_000, records_key: str | None = None, only: list[str] | None = None, always: list[str] | None = None,
                 element: str | None = None) -> Mapping[str, DataFrame]:
    """A table per array level of the merged schema, keyed by its path, and ``$`` for the root.

    Each has ``id_col``, ``row_key`` (surrogate key), ``parent_key`` (that of the
    row one level up; null at the root), ``ordinal`` (0-based place in the array),
    ``places`` (the ordinals from the top down to this row), ``is_object`` and the
    level's scalar fields as strings, named by their path below the level joined with
    ``_``; scalar elements are the field ``value``. A field named like a link column or,
    but for case, like another field gets a trailing ``_``. An object in place
    of an array is its only element; null elements give no row but keep their place.
    Null documents, null ids' documents and damaged texts give no rows. In paths the
    characters ``%.[]`` of a key are percent-escaped; an empty key is ``%``.

    ``records_key``: see ``parsed_once``; the root is then the array of records.
    ``always``: paths that are arrays whatever the records have. What is above them stays an
    object where it is one: an array there makes a level of its own, which leaves their rows alone.
    ``only``: paths that are arrays, in place of all that the records have; what is
    nested in other arrays is left out. ``element``: a further column, the row's element as
    VARIANT. ``max_paths`` bounds the merged schema that the driver holds; more is an error.
    """
    docs = parsed_once(df, id_col, text, records_key)
    rows = docs.select(F.explode("shapes").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).limit(max_paths + 1).collect()
    if len(rows) > max_paths:
        raise ValueError(f"merged schema: more than {max_paths} paths")
    found = [tuple(r.s.split(" ", 1)) for r in rows]
    arrays = set(only if only is not None else always or [])
    above = {up for p in always or [] for up in _prefixes(p)} - arrays  # stay objects

    def merged(path: str) -> str:  # fields of an object in place of an array belong to its elements
        out = "$"
        for part in _parts(path):
            if out in arrays and out not in above and part != "[]":
                out += "[]"
            out += part if part == "[]" else f".{part}"
        return out

    if only is None:  # where a path comes to lie depends on arrays of fewer names only
        for path in sorted((p for kind, p in found if kind == "array"), key=lambda p: sum(x != "[]" for x in _parts(p))):
            arrays.add(merged(path))
    kinds: dict[str, set[str]] = {p: {"array"} for p in arrays}
    for kind, path in found:
        kinds.setdefault(merged(path), set()).add(kind)
    levels = {"$", *(p + "[]" for p in arrays)}
    links = {id_col, "row_key", "parent_key", "ordinal", "places", "is_object", "__item", *([element] if element else [])}

    def level_of(path: str) -> str:
        while path not in levels:
            path = path[:-2] if path.endswith("[]") else path.rpartition(".")[0]
        return path

    scalars: dict[str, list[str]] = {x: [] for x in levels}
    for p, k in kinds.items():
        rest = p[len(level_of(p)):]
        if k & {"string", "number", "boolean"} and "[]" not in rest:
            scalars[level_of(p)].append(rest)
    no_place = F.array().cast("array<bigint>")
    frames = {"$": docs.select(F.col("id").alias(id_col), F.col("id").cast("string").alias("row_key"), F.lit(None).cast("string").alias("parent_key"), F.lit(0).cast("long").alias("ordinal"), no_place.alias("places"), F.col("doc").alias("__item"))}

    def frame(level: str) -> DataFrame:
        if level not in frames:
            up = level_of(level[:-2])
            at = _below(F.col("__item"), level[len(up):-2])
            whole = F.try_variant_get(at, "$", "array<variant>") if level[:-2] in above else items(at)
            children = explode_level(frame(up).select(id_col, F.col("row_key").alias("parent_key"), "places", whole.alias("__all")), F.col("__all"), "ordinal", "__e")
            frames[level] = children.select(id_col, F.concat_ws("/", "parent_key", F.concat(F.lit(level + ":"), "ordinal")).alias("row_key"), "parent_key", "ordinal", F.array_append("places", F.col("ordinal")).alias("places"), F.col("__e").alias("__item"))
        return frames[level]

    def made(level: str) -> DataFrame:
        item = F.col("__item")
        cols, used = [item.alias(element)] if element else [], {x.lower() for x in links}
        for s in sorted(scalars[level]):
            name = "_".join(map(_unescaped, _steps(s))).replace(".", "_") or "value"
            while name.lower() in used:
                name += "_"
            used.add(name.lower())
            value = F.try_variant_get(_below(item, s), "$", "string")
            cols.append((value if s else F.when(items(item).isNull(), value)).alias(name))
        return frame(level).select(id_col, "row_key", "parent_key", "ordinal", "places", as_object(item).isNotNull().alias("is_object"), *cols)

    return _Tables(sorted(levels, key=lambda x: (x.count("[]"), x)), made)


def _prefixes(path: str) -> list[str]:
    """The paths above ``path``, without the path itself."""
    out = ["$"]
    for part in _parts(path):
        out.append(out[-1] + (part if part == "[]" else f".{part}"))
    return out[:-1]


def _parts(path: str) -> list[str]:
    out: list[str] = []
    for step in path[1:].split("."):
        name = step.rstrip("[]") if step.endswith("[]") else step
        if name:
            out.append(name)
        out += ["[]"] * ((len(step) - len(name)) // 2)
    return out


def _steps(rest: str) -> list[str]:
    return [x for x in rest.split(".") if x]


def _below(item: Column, rest: str) -> Column:
    """What is at the path ``rest`` of objects in the variant, as VARIANT."""
    path, out = "", item
    for key in map(_unescaped, _steps(rest)):
        if re.fullmatch(r"\w[^'?]*", key):
            path += f"['{key}']"
            continue
        if path:  # a key that a path can't name
            path, out = "", F.try_variant_get(out, "$" + path, "variant")
        out = F.try_element_at(as_object(out), F.lit(key))
    return F.try_variant_get(out, "$" + path, "variant") if path else out
