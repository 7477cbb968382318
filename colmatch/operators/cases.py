"""Labelled cases of suggestions: loading, gate counts and ranking accuracy.

A case is a small JSON document (name, source, target, answers) written by people;
decisions and rankings are DataFrames, counted by aggregates.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colmatch.functions.types import DTYPES, InvalidInput

# The keys of a case and what an answer of each kind holds.
CASE_KEYS, FIELD_KEYS = {"name", "source", "target", "answers"}, {"name", "data_type", "samples"}
ANSWER_KEYS = {"match": {"kind", "source", "target"}, "no_match": {"kind", "source"}, "ambiguous": {"kind", "source", "targets"}}
ANSWERS = "case string, source string, category string, targets array<string>"


@dataclass(frozen=True)
class Case:
    name: str
    source: list[tuple[str, str, list[str]]]
    target: list[tuple[str, str, list[str]]]
    answers: list[tuple[str, str, list[str]]]  # (source, kind, targets)
    fingerprint: str  # SHA-256 of the document


def _only(d: object, keys: set[str], need: set[str], where: str) -> dict:
    if not isinstance(d, dict) or set(d) - keys or need - set(d):
        raise InvalidInput(f"{where}: keys must be {', '.join(sorted(keys))}")
    return d


def _fields(raw: object, side: str) -> list[tuple[str, str, list[str]]]:
    out = []
    for f in _only(raw, {"fields"}, {"fields"}, side)["fields"]:
        f = _only(f, FIELD_KEYS, {"name", "data_type"}, side)
        if f["data_type"] not in DTYPES:
            raise InvalidInput(f"{side}: unknown type {f['data_type']}")
        out.append((f["name"], f["data_type"], list(f.get("samples", []))))
    names = [n for n, _, _ in out]
    if any(not n.strip() for n in names) or len(set(names)) < len(names):
        raise InvalidInput(f"{side}: an empty or repeated field name")
    return out


def parse_case(text: str) -> Case:
    """A case from its JSON; unknown keys, unknown fields and sources without exactly one answer are errors."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise InvalidInput(str(e)) from e
    raw = _only(raw, CASE_KEYS, CASE_KEYS, "case")
    source, target = _fields(raw["source"], "source"), _fields(raw["target"], "target")
    if not raw["name"].strip() or not source or not raw["answers"]:
        raise InvalidInput("a case needs a name, source fields and answers")
    sources, targets = {n for n, _, _ in source}, {n for n, _, _ in target}
    answers = []
    for a in raw["answers"]:
        kind = a.get("kind") if isinstance(a, dict) else None
        if kind not in ANSWER_KEYS:
            raise InvalidInput(f"unknown answer {kind}")
        a = _only(a, ANSWER_KEYS[kind], ANSWER_KEYS[kind], "answer")
        to = [a["target"]] if kind == "match" else list(a.get("targets", []))
        if a["source"] not in sources or set(to) - targets or len(set(to)) < len(to) or kind == "ambiguous" and len(to) < 2:
            raise InvalidInput(f"the answer for {a['source']} names unknown, repeated or too few fields")
        answers.append((a["source"], kind, to))
    if sorted(s for s, _, _ in answers) != sorted(sources):
        raise InvalidInput("every source field needs exactly one answer")
    return Case(raw["name"], source, target, answers, hashlib.sha256(text.encode()).hexdigest())


def load_cases(folder: str) -> list[Case]:
    """All cases of a folder by file name; two of one name are an error."""
    out = [parse_case(f.read_text(encoding="utf-8")) for f in sorted(Path(folder).glob("*.json"))]
    if len({c.name for c in out}) < len(out):
        raise InvalidInput("two cases have one name")
    return out


def answers(spark: SparkSession, cases: list[Case]) -> DataFrame:
    """case, source, category, targets of all answers."""
    return spark.createDataFrame([(c.name, *a) for c in cases for a in c.answers], ANSWERS)


def gate_counts(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """category, total, correct, incorrect_automatic, incorrect_ambiguity; category is null for all together.

    ``decisions``: case, source, decision (match, ambiguous, no_match), target,
    targets; ``truth``: see ``answers``. A source without a decision counts as
    no_match. An ambiguity is right if it names the expected targets, in any order.
    """
    d = decisions.select("case", "source", "decision", "target", "targets")
    t = truth.select("case", "source", "category", F.col("targets").alias("wanted"))
    kind = F.coalesce("decision", F.lit("no_match"))
    named = F.when(kind == "match", F.array("target")).when(kind == "ambiguous", F.col("targets")).otherwise(F.array().cast("array<string>"))
    right = (kind == F.col("category")) & (F.array_sort(named) == F.array_sort("wanted"))
    seen = t.join(d, ["case", "source"], "left").select("category", right.alias("right"), kind.alias("kind"))
    return seen.rollup("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("right").alias("correct"),
        F.count_if(~F.col("right") & (F.col("kind") == "match")).alias("incorrect_automatic"), F.count_if(~F.col("right") & (F.col("kind") == "ambiguous")).alias("incorrect_ambiguity"))


def ranking_counts(ranked: DataFrame, truth: DataFrame, cutoff: float = 0.5, k: int = 5) -> DataFrame:
    """One row: sources by category, automatic ones, and hits at places 1 and ``k``.

    ``ranked``: case, source, target, score. A source is automatic if its best target
    reaches ``cutoff``; ties go to the smaller target by bytes.
    """
    w = Window.partitionBy("case", "source").orderBy(F.col("score").desc(), "target")
    top = (ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).groupBy("case", "source")
                 .agg(F.min_by("target", "place").alias("first"), F.max("score").alias("best"), F.collect_set("target").alias("near")))
    seen = truth.join(top, ["case", "source"], "left")
    auto = F.coalesce(F.col("best") >= cutoff, F.lit(False))
    is_, near = (lambda c: F.col("category") == c), F.coalesce("near", F.array().cast("array<string>"))
    hit = F.coalesce(F.array_contains("targets", F.col("first")), F.lit(False))
    met = F.size(F.array_intersect("targets", near))
    return seen.agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(is_("match")).alias("matches"), F.count_if(is_("no_match")).alias("no_matches"), F.count_if(is_("ambiguous")).alias("ambiguous"),
        F.count_if(auto).alias("automatic"), F.count_if(is_("match") & auto & hit).alias("true_positives"), F.count_if(is_("match") & hit).alias("top1_correct"),
        F.count_if(is_("match") & (met > 0)).alias(f"recall_at{k}_correct"), F.count_if(is_("no_match") & auto).alias("no_match_automatic"), F.count_if(is_("ambiguous") & auto).alias("ambiguous_automatic"),
        F.count_if(is_("ambiguous") & (met > 0)).alias(f"ambiguous_any_at{k}"), F.count_if(is_("ambiguous") & (met == F.size("targets"))).alias(f"ambiguous_all_at{k}"))
