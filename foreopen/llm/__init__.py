"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query, module, and whether the module states the query in SQL.
OPERATORS = (
    ("op1_embeddings", "embeddings", True),
    ("op2_langid", "langid", False),
    ("op3_mixing", "mixing", True),
    ("op4_simhash", "simhash", False),
    ("op5_urls", "urls", False),
    ("op6_token_counts", "token_counts", False),
    ("op7_quality", "quality", False),
    ("op8_line_dedup", "line_dedup", True),
    ("op9_spotsigs", "spotsigs", False),
    ("op10_pieces", "pieces", False),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"{__name__}.{module}"), name) for name, module, _ in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {name: importlib.import_module(f"{__name__}.{module}").ORACLE for name, module, sql in OPERATORS if sql}
