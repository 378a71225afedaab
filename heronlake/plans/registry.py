"""All queries by name, with their oracle SQL and the survey rows they cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heronlake.sources.adapters import ORACLE_VIEWS, Tables

FLAGSHIP = "story_coverage_split"
_QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None, str]] = {}


def query(covers: str, sql: str | None = None):
    """Register a function of :class:`Tables`; *sql* follows the adapter views in a WITH clause
    (begin with ", name AS (...)" for more of them)."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if f.__name__ in _QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        _QUERIES[f.__name__] = (f, sql, covers)
        return f

    return add


def _load() -> None:
    from heronlake.plans import contents, coverage, editorial, feedback, homepage, ingest, judging, landing, lifecycle, matching, merging, queues, ranking, reports, similarity, stats, streams, texts, upkeep, wording  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: f"WITH RECURSIVE {ORACLE_VIEWS}\n{sql}" for name, (_, sql, _) in _QUERIES.items() if sql}


def coverage() -> dict[str, str]:
    """Survey rows by query."""
    _load()
    return {name: covers for name, (_, _, covers) in _QUERIES.items()}
