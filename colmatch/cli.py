"""Command line: match two files and print the ranked pairs as JSON.

    python -m colmatch.cli ALGORITHM SOURCE TARGET [options] [--] [SOURCE_NAME TARGET_NAME]

``--option name=value`` sets a setting of the matcher (``--option threshold=0.7``), once
for each. ``--assignment`` selects one to one, from ``--threshold`` up. With
``--bounded`` or any limit option the run is bounded: inputs are capped in bytes, values are
sampled, and work limits are checked first. Errors go to stderr with status 1.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
from dataclasses import fields

from colmatch.functions.types import InvalidConfig, MatchError, MatchOptions, WorkLimits

ALGORITHMS = ["coma", "coma_instances", "cupid", "distribution", "jaccard", "jaccard_exact", "flooding"]
# Defaults of bounded runs.
BOUNDS = {"max_input_bytes": 8 << 20, "sample_size": 1000, "max_assignment_dimension": 1024, "max_matrix_cells": 1_048_576, "max_clustering_variables": 4096,
          "max_clustering_constraints": 262_144, "max_jaccard_comparisons": 10_000_000}
ASSIGNMENTS = {"none": None, "rectangular": "rectangular", "rectangular-threshold-aware": "rectangular_aware"}
ONLY_FOR = {"max_jaccard_comparisons": "jaccard", "max_clustering_variables": "distribution", "max_clustering_constraints": "distribution"}


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise InvalidConfig(message)


def parse(argv: list[str]) -> argparse.Namespace:
    flags = [a.split("=")[0] for a in argv[: argv.index("--")] if a.startswith("--")] if "--" in argv else [a.split("=")[0] for a in argv if a.startswith("--")]
    twice = sorted({f for f in flags if flags.count(f) > 1 and f != "--option"})
    if twice:
        raise InvalidConfig(f"{twice[0]} is given twice")
    p = _Parser(prog="colmatch", allow_abbrev=False)
    p.add_argument("algorithm", choices=ALGORITHMS)
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("names", nargs="*")
    p.add_argument("--one-to-one", action="store_true")
    p.add_argument("--option", action="append", default=[])
    p.add_argument("--bounded", action="store_true")
    p.add_argument("--assignment", choices=list(ASSIGNMENTS), default="none")
    p.add_argument("--threshold", type=float)
    for name in BOUNDS:
        p.add_argument("--" + name.replace("_", "-"), type=int)
    a = p.parse_args(argv)
    if len(a.names) not in (0, 2):
        raise InvalidConfig("give both table names or none")
    for name, prefix in ONLY_FOR.items():
        if getattr(a, name) is not None and not a.algorithm.startswith(prefix):
            raise InvalidConfig(f"--{name.replace('_', '-')} doesn't apply to {a.algorithm}")
    for name in BOUNDS:
        if (getattr(a, name) or 0) < 0:
            raise InvalidConfig(f"--{name.replace('_', '-')} must not be negative")
    a.settings = settings(a.algorithm, a.option)
    if a.threshold is not None and (a.assignment == "none" and not a.one_to_one or not math.isfinite(a.threshold)):
        raise InvalidConfig("--threshold is a finite cutoff of an assignment")
    if a.max_assignment_dimension is not None and a.assignment == "none" and not a.one_to_one:
        raise InvalidConfig("--max-assignment-dimension needs an assignment")
    a.bounded = a.bounded or any(getattr(a, name) is not None for name in BOUNDS)
    return a


def settings(algorithm: str, given: list[str]) -> dict:
    """The matcher's settings by name, in the type of their defaults."""
    from colmatch.operators import matchers

    kind = {"coma_instances": "coma", "jaccard_exact": "jaccard"}.get(algorithm, algorithm)
    default = {f.name: f.default for f in fields(getattr(matchers, kind.capitalize())) if isinstance(f.default, (bool, int, float, str))}
    out: dict = {"use_instances": True} if algorithm == "coma_instances" else {"distance": "exact"} if algorithm == "jaccard_exact" else {}
    for text in given:
        name, eq, value = text.partition("=")
        if not eq or name not in default or name in out:
            raise InvalidConfig(f"--option {text}: unknown, doubled or without a value")
        to = type(default[name])
        try:
            out[name] = {"true": True, "false": False}[value] if to is bool else to(value)
        except (KeyError, ValueError) as e:
            raise InvalidConfig(f"--option {text}: not of type {to.__name__}") from e
    return out


def run(argv: list[str]) -> str:
    a = parse(argv)
    from pyspark.sql import SparkSession

    from colmatch.operators import matchers, results
    from colmatch.sources import profile, readers

    spark = SparkSession.builder.appName("colmatch").config("spark.ui.enabled", "false").getOrCreate()
    limit = {n: (getattr(a, n) if getattr(a, n) is not None else d) for n, d in BOUNDS.items()} if a.bounded else {}
    names = a.names or [os.path.splitext(os.path.basename(p))[0] for p in (a.source, a.target)]
    tables = [(n, readers.from_path(spark, p, limit.get("max_input_bytes"))) for n, p in zip(names, (a.source, a.target))]
    p = profile.with_inferred_types(profile.from_dataframes(tables))
    if a.bounded:
        p = profile.sampled_profile(p, tables, MatchOptions(limit["sample_size"]))
    work = WorkLimits(**{k: v for k, v in limit.items() if k not in ("max_input_bytes", "sample_size")}) if a.bounded else None
    kind = a.algorithm.split("_")[0].capitalize()
    found = matchers.match_profile(p, getattr(matchers, kind)(**a.settings), work)
    method = ASSIGNMENTS[a.assignment] or ("rectangular" if a.one_to_one else None)
    if method:
        found = results.one_to_one(found, method, a.threshold, limits=work)
    return readers.results_json(results.ranked(found))


def main() -> None:
    try:
        print(run(sys.argv[1:]))
    except MatchError as e:
        print(e, file=sys.stderr)
        sys.exit(1)


if __name__ == "__main__":
    main()
