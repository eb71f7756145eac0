"""Every operator as a named query on the driver's tables, with the same result stated in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; the session runs in UTC so that both engines agree on times."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        run.__name__ = f"query_{name}"
        run.__doc__ = f.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def load_all() -> None:
    """Import all query modules."""
    from trackloom.registry import (  # noqa: F401
        edits,
        files,
        points,
        quantiles,
        satellites,
        sentences,
        terrain,
    )
