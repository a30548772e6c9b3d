"""All named queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import forms, knowledge, learning, lifecycle, reading, retrieval, streams, structure

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (retrieval, forms, structure, learning, knowledge, lifecycle, reading, streams)


def queries() -> dict[str, Query]:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
