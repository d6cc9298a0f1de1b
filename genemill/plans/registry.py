"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genemill.operators.distributed import release
from genemill.plans.standins import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables)` under a name, with its reference SQL when SQL can say it."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release()  # tables an earlier query kept
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Round the floating columns, so that the order of additions does not show."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "double":
            c = F.round(c, special.get(f.name, places)).alias(f.name)
        out.append(c)
    return df.select(*out)
