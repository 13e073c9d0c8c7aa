"""Operators for preparing training data; nothing outside this folder imports it."""

from __future__ import annotations


def queries():
    """All pN_ queries of this subpackage by name."""
    from talkmill.llm import registry

    return registry.queries()


def oracle_sql():
    """SQL for those of the queries that SQL can express."""
    from talkmill.llm import registry

    return registry.oracle_sql()
