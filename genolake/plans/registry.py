"""The register of queries: each over views (or tables), with its SQL over the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from genolake.plans.derive import VIEWS, cte, view
from genolake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *names: str, sql: str | None = None):
    """Register ``f(view, ...)`` over these views (or tables), with its SQL over the same names."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, n) if n in VIEWS else table(spark, sf_dir, n) for n in names])

        QUERIES[name] = run
        if sql is not None:
            views = [n for n in names if n in VIEWS]
            ORACLES[name] = (cte(*views) + (", " if sql.lstrip().startswith("+") else "") + sql.lstrip().removeprefix("+")) if views else sql.lstrip().removeprefix("+")
        return f

    return add
