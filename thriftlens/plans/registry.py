"""Names of the queries, each with the SQL that its result is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftlens.plans.binding import Market, checked

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, view: str | None = None, sql: str | None = None):
    """Registers ``fn(market)``. ``sql`` is put behind the views named in ``view``; a query without
    SQL is checked by brute force in the tests."""

    def add(fn: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Market(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = checked(view, sql) if view else sql.strip()
        return fn

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Every double column at ``places`` decimals, without negative zeros."""
    return df.select(
        *[
            (F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )
