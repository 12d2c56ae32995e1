"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import matching, performance, scalars, scores, streams

GROUPS = (scalars, scores, performance, matching, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for group in GROUPS for name, q in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for group in GROUPS for name, q in group.SQL.items()}
