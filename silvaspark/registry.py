"""The registered queries and the SQL that must give the same rows, filled by the catalogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silvaspark.jobs.fixtures import CYL, PTS, cylinders, points

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, source: Callable, job: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over the points or the cylinders of the stand; sql begins where their common table expressions end."""
    QUERIES[name] = lambda spark, sf_dir: job(source(spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH RECURSIVE {PTS if source is points else CYL}{sql if sql.startswith(',') else ' ' + sql}"


def register_both(name: str, job: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over the cylinders and the points."""
    QUERIES[name] = lambda spark, sf_dir: job(cylinders(spark, sf_dir), points(spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH RECURSIVE {PTS}, {CYL}{sql if sql.startswith(',') else ' ' + sql}"
