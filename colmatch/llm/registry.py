"""All queries of this package and their SQL."""

from __future__ import annotations

import importlib

_MODULES = ["topn", "terms", "entities", "setjoin", "bpe", "packing", "language"]


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(importlib.import_module(f"colmatch.llm.queries_{m}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(importlib.import_module(f"colmatch.llm.queries_{m}").SQL)
    return out
