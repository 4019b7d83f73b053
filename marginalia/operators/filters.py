"""Predicates: optional criteria folded into one conjunction, which Catalyst pushes to the scan where it can."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.paths import depth, glob_to_regex, is_glob


def conjunction(criteria: Sequence[Column | None]) -> Column:
    """All criteria that are given; true if none is."""
    return reduce(and_, [c for c in criteria if c is not None], F.lit(True))


def disjunction(criteria: Sequence[Column]) -> Column:
    return reduce(or_, criteria, F.lit(False))


def equals(**wanted: object) -> Column:
    """Equality for every argument that isn't None."""
    return conjunction([F.col(k) == v for k, v in wanted.items() if v is not None])


def among(column: str, values: Sequence | None) -> Column | None:
    """IN-list; null rows fail it, an empty list asks for nothing."""
    return F.coalesce(F.col(column).isin(list(values)), F.lit(False)) if values else None


def between(column: str, low: float | None = None, high: float | None = None, strict: bool = True) -> Column | None:
    """Inclusive range; a null value fails if strict, else passes."""
    if low is None and high is None:
        return None
    test = conjunction([F.col(column) >= low if low is not None else None, F.col(column) <= high if high is not None else None])
    return F.coalesce(test, F.lit(not strict))


def contains_text(column: str, needle: str, mode: str = "substring", case_sensitive: bool = False) -> Column:
    """substring, regex or whole word."""
    if mode == "substring":
        return F.contains(F.col(column), F.lit(needle)) if case_sensitive else F.contains(F.lower(column), F.lit(needle.lower()))
    body = rf"\b\Q{needle}\E\b" if mode == "word" else needle
    return F.col(column).rlike(body if case_sensitive else "(?i)" + body)


def tool_calls(is_call: Column, *criteria: Column | None) -> Column:
    """Criteria on tool calls alone: other rows pass, a call with an unknown field fails."""
    return ~is_call | F.coalesce(conjunction(criteria), F.lit(False))


def in_scope(path: str, scopes: Sequence[str]) -> Column:
    """The path begins with any literal scope or matches any glob among them; no scopes, no limit."""
    if not scopes:
        return F.lit(True)
    return disjunction([F.col(path).rlike(glob_to_regex(s)) if is_glob(s) else F.col(path).startswith(s) for s in scopes])


def file_filter(df: DataFrame, extensions: Sequence[str] = (), max_depth: int | None = None, pattern: str | None = None, modified: tuple[int, int] | None = None) -> DataFrame:
    """Files by extension, depth, name pattern and time of change."""
    return df.where(conjunction([
        F.lower("extension").isin([e.lower().lstrip(".") for e in extensions]) if extensions else None, depth(F.col("path")) <= max_depth if max_depth is not None else None,
        F.col("path").rlike("(?i)" + pattern) if pattern else None, F.col("modified").between(*modified) if modified else None,
    ]))


def batch_results(df: DataFrame, only_successful: bool = False, only_failed: bool = False, **wanted: object) -> DataFrame:
    """Results of a batch by success and by any of their other fields; both kinds of success at once leave none."""
    return df.where(conjunction([F.col("success") if only_successful else None, ~F.col("success") if only_failed else None, equals(**wanted)]))


def by_name_or_id(df: DataFrame, wanted: str, id_column: str, name_column: str) -> DataFrame:
    """The row whose id is wanted, else the one of that name, whatever its case."""
    by_id = F.col(id_column).cast("string") == wanted
    return df.where(by_id | (F.lower(name_column) == wanted.lower())).orderBy(F.when(by_id, 0).otherwise(1), id_column).limit(1)
