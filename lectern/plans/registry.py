"""Named queries with their inventory ids and, where SQL can express them, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers the decorated plan under its own name for the inventory ids it covers."""

    def add(plan: Plan) -> Plan:
        if plan.__name__ in QUERIES:
            raise ValueError(f"query {plan.__name__} is registered twice")
        QUERIES[plan.__name__] = Query(plan.__name__, tuple(ids.split()), plan, sql)
        return plan

    return add
