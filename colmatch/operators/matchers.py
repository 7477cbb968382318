"""One interface for all matchers, and the batch entry points.

    match_tables({"orders": orders, "customer": customer}, Jaccard("exact"), sample_size=None)

A matcher is a small frozen object with its settings; ``match`` takes a profile and
returns named pairs with a score. Own matchers subclass ``Matcher``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmatch.functions.types import InvalidConfig, InvalidInput, MatchOptions, WorkLimits
from colmatch.operators import coma, cupid, distribution, flooding, jaccard, results
from colmatch.operators.lexicon import Lexicon
from colmatch.sources import profile
from colmatch.sources.profile import Profile


class Matcher(ABC):
    """Scores the column pairs of a profile."""

    @abstractmethod
    def match(self, p: Profile, limits: WorkLimits | None = None) -> DataFrame:
        """source_table, source_column, target_table, target_column, score, and details where there are any."""


class EmbeddingProvider(Protocol):
    """Vectors of texts; called on batches of distinct values, on executors."""

    def encode(self, values: list[str]) -> list[list[float]]: ...


def embed(p: Profile, provider: EmbeddingProvider) -> DataFrame:
    """value, vector of every distinct value of the profile; each value is encoded once, however many columns hold it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = b["value"].tolist()
            vectors = provider.encode(values) if values else []
            if len(vectors) != len(values):
                raise InvalidConfig(f"the provider gave {len(vectors)} vectors for {len(values)} values")
            yield pd.DataFrame({"value": values, "vector": [[float(x) for x in v] for v in vectors]})

    return p.counts.select("value").distinct().mapInPandas(run, "value string, vector array<double>")


@dataclass(frozen=True)
class Jaccard(Matcher):
    distance: str = "levenshtein"
    threshold: float = 0.8
    alpha: float = 1.0
    beta: float = 1.0
    provider: EmbeddingProvider | None = None

    def match(self, p: Profile, limits: WorkLimits | None = None) -> DataFrame:
        vectors = embed(p, self.provider) if self.provider is not None else None
        return jaccard.jaccard(p, self.distance, self.threshold, self.alpha, self.beta, vectors, limits)


@dataclass(frozen=True)
class Coma(Matcher):
    max_n: int = 0
    use_instances: bool = False
    use_schema: bool = True
    delta: float = 0.15
    threshold: float = 0.0
    instance_weight: float = 1.0

    def match(self, p: Profile, limits: WorkLimits | None = None) -> DataFrame:
        return coma.coma(p, self.max_n, self.use_instances, self.use_schema, self.delta, self.threshold, self.instance_weight)


@dataclass(frozen=True)
class Cupid(Matcher):
    lexicon: Lexicon | None = None
    leaf_w_struct: float = 0.2
    w_struct: float = 0.2
    th_accept: float = 0.7
    th_high: float = 0.6
    th_low: float = 0.35
    c_inc: float = 1.2
    c_dec: float = 0.9
    th_ns: float = 0.7

    def match(self, p: Profile, limits: WorkLimits | None = None) -> DataFrame:
        return cupid.cupid(p, self.lexicon, **{k: v for k, v in vars(self).items() if k != "lexicon"})


@dataclass(frozen=True)
class Distribution(Matcher):
    threshold1: float = 0.15
    threshold2: float = 0.15
    quantiles: int = 256
    bloom: bool = False

    def match(self, p: Profile, limits: WorkLimits | None = None) -> DataFrame:
        return distribution.distribution_based(p, self.threshold1, self.threshold2, self.quantiles, self.bloom, limits)


@dataclass(frozen=True)
class Flooding(Matcher):
    policy: str = "inverse_average"
    formula: str = "c"
    matcher: str = "prefix_suffix"

    def match(self, p: Profile, limits: WorkLimits | None = None) -> DataFrame:
        return flooding.similarity_flooding(p, self.policy, self.formula, self.matcher)


def match_profile(p: Profile, matcher: Matcher, limits: WorkLimits | None = None) -> DataFrame:
    """The matcher's pairs; a pair delivered twice or a score outside 0..1 is an error."""
    return results.checked(matcher.match(p, limits))


def match_tables(tables: dict[str, DataFrame] | list[tuple[str, DataFrame]], matcher: Matcher, options: MatchOptions | None = None, limits: WorkLimits | None = None, order: str | None = None) -> DataFrame:
    """Match at least two named tables on evenly spaced values of each column.

    ``options``: how many values a column keeps (1,000 unless said otherwise; None
    keeps all). ``order``: the column that fixes the order of rows for sampling.
    """
    named = list(tables.items()) if isinstance(tables, dict) else list(tables)
    if len(named) < 2:
        raise InvalidInput("at least two tables are required")
    p = profile.sampled_profile(profile.from_dataframes(named), named, options or MatchOptions(), order)
    return match_profile(p, matcher, limits)


def match_all(tables: dict[str, DataFrame] | list[tuple[str, DataFrame]], matcher: Matcher, limits: WorkLimits | None = None) -> DataFrame:
    """Match at least two named tables on all their values."""
    return match_tables(tables, matcher, MatchOptions(None), limits)


def match_schemas(spark: SparkSession, source: list[tuple[str, str, list[str]]], target: list[tuple[str, str, list[str]]], matcher: Matcher) -> DataFrame:
    """Match two lists of fields (name, type, samples) as the tables aaa and bbb; they are validated here."""
    return match_profile(profile.from_fields(spark, [("aaa", source), ("bbb", target)]), matcher)
