"""Every registered query and the SQL that it is compared with.

A module's QUERIES maps a name to (function of the folder's tables, SQL or None).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.testdata import Tables
from . import extras, imports, introductions, layouts, lifecycle, lists, masters, matching, matrix, orders, saves, screens, sellin, sellout, sheets, stores, workbooks

MODULES = (sellin, lifecycle, imports, sellout, introductions, layouts, matching, masters, sheets, lists, stores, orders, workbooks, matrix, screens, saves, extras)


def _all() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for module in MODULES:
        if double := found.keys() & module.QUERIES.keys():
            raise ValueError(f"registered twice: {sorted(double)}")
        found |= module.QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
