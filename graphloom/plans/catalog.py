"""Registry of runnable queries: name, Spark plan and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.model import Graph

Plan = Callable[[Graph], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return register


def load() -> None:
    from graphloom.plans import aggregates, composites, eventplans, graphplans, joins, projectplans, rules, search, sinks, sourceplans, texts  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from graphloom.session import ship

    load()

    def bound(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return plan(Graph(spark, folder))

        return run

    return {name: bound(plan) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(SQL)
