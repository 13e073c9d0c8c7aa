"""All core queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _all():
    import importlib

    found = {}
    for name in ("corpus", "dialogue", "relational", "benches", "harness", "training", "generators"):
        found |= importlib.import_module(f"talkmill.queries.{name}").QUERIES
    return found


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Reject reasons of the corpus per source, strict and permissive."""
    return _all()["reject_reasons"][0](spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for name, (function, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
