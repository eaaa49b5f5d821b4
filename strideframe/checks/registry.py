"""Registered queries: the Spark side, the checking SQL and the rounding of doubles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from strideframe.checks.oracle_tables import with_ctes
from strideframe.checks.warehouse import Warehouse

DIGITS = 6


@dataclass(frozen=True)
class Query:
    build: Callable[[Warehouse], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, build: Callable[[Warehouse], DataFrame], sql: str | None = None,
             rounded: str = "") -> None:
    """`rounded` names the double columns of the SQL side; on the Spark side every double is
    rounded alike, because sums differ in the last digits with the order of addition."""
    if name in REGISTRY:
        raise ValueError(f"query {name} is registered twice")
    REGISTRY[name] = Query(build, with_ctes(sql, rounded) if sql else None)


def round_doubles(df: DataFrame) -> DataFrame:
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), DIGITS) + F.lit(0.0) for c in doubles})


def runnable(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: round_doubles(query.build(Warehouse(spark, sf_dir)))
