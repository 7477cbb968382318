"""Logical types, settings and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The logical types of a column.
DTYPES = ["unknown", "boolean", "integer", "float", "decimal", "text", "date", "timestamp"]


class MatchError(Exception):
    """Base of all errors of this library."""


class InvalidInput(MatchError):
    pass


class InvalidConfig(MatchError):
    pass


class AlgorithmError(MatchError):
    pass


class WorkLimitExceeded(AlgorithmError):
    pass


def logical_type(dtype: T.DataType) -> str:
    """The logical type of a Spark type; nested, binary and interval types are refused."""
    groups = [
        (T.BooleanType, "boolean"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"),
        ((T.FloatType, T.DoubleType), "float"), (T.DecimalType, "decimal"), (T.DateType, "date"),
        ((T.TimestampType, T.TimestampNTZType), "timestamp"), ((T.StringType, T.CharType, T.VarcharType), "text"), (T.NullType, "unknown"),
    ]
    for kinds, name in groups:
        if isinstance(dtype, kinds):
            return name
    raise InvalidInput(f"a column of type {dtype.simpleString()} can't be matched")


@dataclass(frozen=True)
class Config:
    """Decision rules of suggestions."""

    min_score: float = 0.72
    ambiguity_margin: float = 0.05
    max_candidates: int = 5

    def __post_init__(self) -> None:
        for name in ("min_score", "ambiguity_margin"):
            v = getattr(self, name)
            if not 0.0 <= v <= 1.0:
                raise InvalidConfig(f"{name} must be between 0 and 1")
        if self.max_candidates < 0:
            raise InvalidConfig("max_candidates must not be negative")


@dataclass(frozen=True)
class MatchOptions:
    """``instance_sample_size``: values kept per column, evenly spaced; None keeps all, 0 none."""

    instance_sample_size: int | None = 1000


@dataclass(frozen=True)
class WorkLimits:
    """Largest workloads of checked matching; None is unlimited."""

    max_matrix_cells: int | None = None
    max_jaccard_comparisons: int | None = None
    max_assignment_dimension: int | None = None
    max_clustering_variables: int | None = None
    max_clustering_constraints: int | None = None


def check_work(operation: str, count: int, limit: int | None) -> None:
    """Refuse ``count`` units of work above ``limit``."""
    if count < 0:
        raise WorkLimitExceeded(f"{operation}: the workload can't be counted")
    if limit is not None and count > limit:
        raise WorkLimitExceeded(f"{operation}: {count} exceeds the limit of {limit}")
