"""Registered queries of the survey operators, each with the same query in DuckDB SQL.

A query is declared with the columns of its result: name:type with s text, i integer,
d real (rounded to 6 decimals, NaN as NULL), b boolean. Both sides are cast alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import DUCK, Survey

_SPARK = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}
_DUCK = {"s": "VARCHAR", "i": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def shaped(df: DataFrame, spec: str) -> DataFrame:
    def one(item: str):
        name, kind = item.split(":")
        c = F.col(name).cast(_SPARK[kind])
        return (F.round(F.when(~F.isnan(c), c), 6) + F.lit(0.0) if kind == "d" else c).alias(name)

    return df.select(*map(one, spec.split()))


def shaped_sql(sql: str, spec: str) -> str:
    def one(item: str) -> str:
        name, kind = item.split(":")
        c = f'"{name}"::{_DUCK[kind]}'
        return (f"round(CASE WHEN NOT isnan({c}) THEN {c} END, 6) + 0.0::DOUBLE" if kind == "d" else c) + f' AS "{name}"'

    return f"SELECT {', '.join(map(one, spec.split()))} FROM (\n{sql}\n) AS q"


def query(name: str, spec: str, sql: str | None = None, ctes: str = "", recursive: bool = False):
    """Registers f(survey) under `name`; sql reads the views of DUCK and further ctes."""

    def add(f: Callable[[Survey], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: shaped(f(Survey(spark, sf_dir)), spec)
        if sql:
            ORACLE[name] = shaped_sql(f"WITH {'RECURSIVE ' if recursive else ''}{DUCK}{', ' + ctes if ctes else ''}\n{sql}", spec)
        return f

    return add


def labelled(v: Survey) -> DataFrame:
    """raw_file, ping_idx, labels of the merged label map."""
    from ..operators.slices import merge_categories

    return merge_categories(v.annotation, (1, 27, 6009))


def load() -> None:
    """Imports the modules that declare queries."""
    from . import query_aggregates, query_functions, query_jobs, query_joins, query_slices  # noqa: F401
