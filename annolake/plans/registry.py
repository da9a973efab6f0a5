"""The registered queries of the annotation operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annolake.plans import annotation, evaluation, spatial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (evaluation, annotation, spatial):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
